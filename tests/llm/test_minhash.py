import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timberline.llm.minhash import near_duplicates, occurrences, op5_minhash, shingles, signatures, stage_minhash


def multiset(text):
    w = (text or "").split(" ")
    w = [x for x in w if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    sets = [multiset(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        k = top(i)
        least[k] = min(least.get(k, (True, 0)), (d is None, d or 0))
    return [least[top(i)] for i in range(len(rows))]


def made(r, n):
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.choice([3, 30, 60, 150]))]
            w += w[:12] * r.choice([0, 0, 5])
        rows.append((i, " ".join(w)))
    return rows


def test_register_agreement_is_weighted_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    a, b = r.integers(1, 40, 60), r.integers(1, 40, 60)
    row = np.repeat([0, 1], 60)
    got = signatures(row, np.concatenate([h, h]), np.concatenate([a, b]), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5


def test_signature_is_the_same_alone_and_in_a_full_step():
    r = np.random.default_rng(2)
    n = 3000
    sizes = r.choice([1, 3, 8, 20, 60], n)
    row = np.repeat(np.arange(n), sizes)
    h = r.integers(0, 1 << 62, len(row), dtype=np.uint64)
    weight = r.choice([1, 1, 1, 2, 7, 40], len(row))
    full = signatures(row, h, weight, n, 100)
    for few in (np.arange(1), np.arange(5, 25), np.arange(100, 600)):
        held = (row >= few[0]) & (row <= few[-1])
        alone = signatures(row[held] - few[0], h[held], weight[held], len(few), 100)
        assert np.array_equal(alone.view(np.uint64), full[few].view(np.uint64))


def test_shingles_count_like_brute_force():
    texts = [None, "", "a", "a b c d e", "a b c d e a b c d e a b c d e", "x  y\n z", " ".join("ab" * 40)]
    row, h = shingles(pa.array(texts))
    first, number = occurrences(row, h)
    want = [sorted(multiset((t or "").replace("\n", " ")).values()) for t in texts]
    weight = np.diff(np.append(first, len(row)))
    assert [sorted(weight[row[first] == i].tolist()) for i in range(len(texts))] == want and number.max() >= 1


def test_by_brute_force(spark):
    rows = made(random.Random(5), 250)
    want = brute(rows)
    got = {x.doc_id: (x.class_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i, _ in rows] == [w[1] for w in want]
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_dense_groups_by_brute_force(spark, monkeypatch):
    from timberline.llm import minhash

    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"edit{i}x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [w[1] for w in brute(rows)]


def test_odd_rows(spark):
    long = "a b c d e f g " * 20000
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (8, "one two"), (9, "one two"), (None, "one two"), (None, "alone in the world of nulls"), (None, long), (None, long + "h"), (3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    left = stage_minhash(spark, df, "")
    assert left.columns == df.columns
    stay = sorted((str(x.doc_id), len(x.text or "")) for x in left.collect())
    one_of = [sorted([("5", 0), ("6", 0), ("7", 2), ("8", 7), ("None", 27), ("3", 5), ("None", n)]) for n in (len(long), len(long) + 1)]
    assert stay in one_of
    assert near_duplicates(df.limit(0)).count() == 0


def test_few_words_in_a_step():
    for n in range(8):
        alone = " ".join("abcdefgh"[:n])
        for texts in ([alone], [alone, None, "", " "], [alone, "x y z " * 500], ["q", alone, "r"]):
            row, h = shingles(pa.array(texts))
            for i, t in enumerate(texts):
                own = shingles(pa.array([t]))[1] if t else np.zeros(0, np.uint64)
                assert np.array_equal(h[row == i], own) and len(own) == sum(multiset(t).values())
    assert shingles(pa.array([], pa.string()))[0].size == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text.replace("\n", " ").replace("\t", " ").replace("\r", " ")) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: w[1] for (i, _), w in zip(rows, brute(rows))}
    got = {x.doc_id: x.class_id for x in op5_minhash(spark, d).collect()}
    assert got == want
