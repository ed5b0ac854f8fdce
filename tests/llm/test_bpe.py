import hashlib
import random

import pytest
from tokenizers import Tokenizer

from timberline.llm.bpe import Bpe, bpe_round_trip, default_vocabulary


@pytest.fixture(scope="module")
def both():
    path = default_vocabulary()
    with open(path, "rb") as f:
        return Bpe(f.read(), 5000), Tokenizer.from_file(path)


def test_same_as_the_library(both):
    own, library = both
    r = random.Random(7)
    alphabets = [(32, 126), (0, 32), (0xA0, 0x2FFF), (0x3000, 0xD7FF), (0x10000, 0x1FFFF)]
    texts = ["", " ", "\n\n x", "<|endoftext|>", "a<|endoftext|>b <|endo", "it's we'LL", "x" * 5000, "ab " * 3000, "\x1c\x85   x"]
    for _ in range(400):
        low, high = r.choice(alphabets)
        texts.append("".join(chr(r.randint(low, high)) if r.random() < 0.8 else r.choice(" \n\t'") for _ in range(r.randint(1, 60))))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "same text", "z"), (3, "same text", "z"), (None, "a" * 20000, None)]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), default_vocabulary())
    assert got.columns == ["doc_id", "ids", "decoded"]
    by = {}
    for x in got.collect():
        by.setdefault(x.doc_id, []).append((bytes(x.ids), x.decoded))
    assert by[1] == by[2] == [(b"", "")]
    assert by[3][0] == by[3][1] and by[3][0][1] == "same text"
    assert by[None][0][1] == "a" * 20000


def test_empty_table(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), default_vocabulary()).count() == 0


def test_query(spark):
    from timberline.llm.bpe import op1_bpe

    library = Tokenizer.from_file(default_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op1_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
