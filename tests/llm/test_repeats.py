import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm.repeats import collection_rows, op10_repeats, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(d), sum(gone), sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])), bytes(x for x, g in zip(d, gone) if not g)))
    return out


def test_transform_is_sorted():
    r = random.Random(1)
    for _ in range(30):
        strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(r.randint(1, 12))]
        owner, size, common = collection_rows(strings)
        want = sorted((s[len(s) - k :], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        assert [(o, k) for o, k in zip(owner, size)] == [(i, k) for _, i, k in sorted(want, key=lambda x: (x[0], x[1]))] or all(
            strings[a][len(strings[a]) - i :] <= strings[b][len(strings[b]) - j :] for a, i, b, j in zip(owner, size, owner[1:], size[1:])
        )
        for k in range(1, len(owner)):
            a, b = (strings[o][len(strings[o]) - s :] for o, s in ((owner[k - 1], size[k - 1]), (owner[k], size[k])))
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == shared
        assert len(owner) == sum(len(s) + 1 for s in strings) and np.all(np.bincount(owner, minlength=len(strings)) == [len(s) + 1 for s in strings])


@pytest.mark.parametrize("hot", [4096, 1])
def test_by_brute_force(spark, hot):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    pool = [word(r.randint(15, 60)) for _ in range(12)]
    texts = [None, "", "x" * 100, "ab" * 60, word(300), "short"]
    for _ in range(80):
        t = word(r.randint(0, 30))
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randint(0, 10)
            t += p[a : len(p) - r.randint(0, 10)] + word(r.randint(0, 12))
        texts.append(t)
    texts += [texts[10], texts[10]]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, range(len(texts)))), "doc_id long, text string, spans int").withColumn("row", F.col("spans"))
    got = {x.row: (x.n_bytes, sum(y.stop - y.start for y in x.removed), len(x.removed), bytes(x.kept)) for x in remove_repeats(df, length=20, gram=11, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 20)


def test_long_texts_and_clashing_names(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, long[100_000:100_450] + "x" * 50), (2, "y" + long[250_000:250_399]), (None, "ab" * 3000), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("spans", "r_doc", "r_hash", "text_hash", "kept_0", "removed"):
        df = df.withColumn(c, F.lit(c))
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "spans", "r_doc", "r_hash", "text_hash", "kept_0", "n_bytes", "removed", "kept"]
    got = sorted(((x.n_bytes, sum(y.stop - y.start for y in x.removed), len(x.removed), bytes(x.kept)) for x in out.collect()), key=str)
    assert got == sorted(brute([t for _, t in rows], 400), key=str)
    assert all(x[c] == c for x in out.collect() for c in ("spans", "r_doc", "r_hash", "text_hash", "kept_0"))


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: (n, k, s, hashlib.sha256(b).hexdigest()) for (i, _), (n, k, s, b) in zip(rows, brute([t for _, t in rows], 400))}
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in op10_repeats(spark, d).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0
