import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm.vectors import near_vectors, op4_vectors, plan_lists


def brute(rows, cosine=0.95):
    unit = []
    for _, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        unit.append(x / np.linalg.norm(x) if x is not None and len(x) and np.isfinite(x).all() and np.any(x) else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out, group = [], [-1] * n
    for i in range(n):
        if group[i] < 0:
            todo, group[i] = [i], i
            while todo:
                for j in links[todo.pop()]:
                    if group[j] < 0:
                        group[j] = i
                        todo.append(j)
    least = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(n) if group[i] == g) for g in group}
    for i, (v, _) in enumerate(rows):
        c = None if least[group[i]][0] else least[group[i]][1]
        out.append((v, len(links[i]), c, v == c))
    return sorted(out, key=str)


def made(n, seed, noise):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 64))
    big = np.concatenate([base, base[:40] + r.normal(size=(40, 64)) * noise, base[0] + r.normal(size=(150, 64)) * 0.02, base[0] + r.normal(size=(30, 64)) * noise, base[1:5], base[1:5] * 2])
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(big)]


@pytest.mark.parametrize("hot", [None, 8])
def test_by_brute_force(spark, hot):
    rows = made(500, 3, 0.2)
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [1.0] * 3), (9005, [2.0] * 3), (None, [1.0] * 3), (9006, []), (9007, [None] + [1.0] * 63), (17, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit("clash"))
    assert sorted(map(tuple, near_vectors(df, hot=hot).collect()), key=str) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(x.vec_id, list(x.embedding)) for x in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op4_vectors(spark, d).collect()), key=str) == brute(rows)


def test_lists_reach_the_recall():
    for n in (10, 10_000, 10_000_000):
        bits, lists, _ = plan_lists(n, 0.95)
        assert 2**bits <= max(16, n) and 2 <= lists < 400


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_is_measured(spark, n):
    """Planted pairs at and just above the threshold, where the analytic bound on misses is worst."""
    r = np.random.default_rng(n)
    base = r.normal(size=(n, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.normal(size=(n // 3, 32))
    other -= (other * base[: n // 3]).sum(axis=1, keepdims=True) * base[: n // 3]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = np.where(np.arange(n // 3) % 2, 0.9502, r.uniform(0.93, 0.97, n // 3))[:, None]
    x = np.concatenate([base, cosine * base[: n // 3] + np.sqrt(1 - cosine**2) * other])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {v.vec_id: v.n_links for v in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found, all_ = sum(got.values()), int(want.sum())
    assert all(got[i] <= want[i] for i in got) and all_ > n // 3 and found >= 0.998 * all_


def test_long_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(6, 20000))
    x[1], x[3] = x[0] * 3 + 0.01, -x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
