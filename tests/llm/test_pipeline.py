import hashlib
from collections import Counter

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_lines import brute as repeated_lines
from tests.llm.test_minhash import brute as groups
from timberline.llm.bpe import default_vocabulary
from timberline.llm.common import stored
from timberline.llm.lines import LEAST
from timberline.llm.mixing import ORACLE_SQL


def test_like_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{d}/documents.parquet").collect() if r.text and any(c.isalpha() for c in r.text)]
    gone = repeated_lines([(r.doc_id, r.text) for r in docs], LEAST)
    kept = []
    for r in docs:
        lines = r.text.split("\n")
        left = [x for k, x in enumerate(lines) if ((False, r.doc_id, k), x) not in gone]
        if len(left) == len(lines) or "".join(left).strip(" \t\n\v\f\r"):
            kept.append((r.doc_id, r.source, "\n".join(left)))
    spaced = [(i, t.translate(str.maketrans("\n\t\r\v\f", "     "))) for i, _, t in kept]
    first = {w[1] for w in groups(spaced)}
    table = pd.DataFrame([r for r in kept if r[0] in first], columns=["doc_id", "source", "text"])
    con = duckdb.connect()
    con.register("documents", table)
    copies = {r[0]: r[4] // r[1] if r[1] else None for r in con.sql(ORACLE_SQL).fetchall()}
    library, want = Tokenizer.from_file(default_vocabulary()), Counter()
    for i, _, text in table.itertuples(index=False):
        ids = library.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(text.encode()).hexdigest()] += copies[i] or 0
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect())
    assert got == +want and len(got) > 50


def test_stages_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 0


def test_long_texts_and_ties(spark):
    """A very long text goes through whole; of documents that tie in everything but their ids one stays."""
    words = [f"{a}{b}{c}" for a in ("wal", "for", "mer", "tin") for b in ("ber", "sto", "ling", "dra") for c in ("en", "ing", "ar", "ous")]
    long = " ".join(words[(i * 7 + i // 64) % 64] + ("\n" if i % 50 == 49 else "") for i in range(120_000))
    same = "the same text of some words that two documents have from their first to their very last word"
    rows = [(1, long, "en", "s", 1, "x"), (2, same, "en", "s", 2, "x"), (3, same.upper() + "\nand one line more", "en", "t", 3, "x"), (4, same, "en", "t", 2, "x"), (5, "other words altogether here, for the sake of it", "en", "t", 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stored(stage(spark, df, ""), name)
    left = {r.doc_id: r.text for r in df.collect()}
    assert {1, 2, 3, 5} == set(left) and left[2] == same and len(left[1]) > 1000 and set(left[1].split()) <= set(words)
    out = corpus_pipeline.STAGES[4][1](spark, df, "").collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "the and of a text with enough letters here and there", "en", "s", 1, "x")] * 2 + [(None, None, None, None, None, None), (2, "", None, "s", 0, "y"), (3, "words of another kind, quite other words than before", None, None, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        df.collect()
    assert {r.doc_id for r in df.collect()} <= {1, 3}
