import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.llm.mixing import ORACLE_SQL, mix, mix_plan, op3_mixing, stage_mixing, targets, word_count


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(ORACLE_SQL).fetchall()}
    rows = op3_mixing(spark, d).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert want[r.doc_id] == (r.size, r.source_size, r.target, r.taken)
    source = {r[0]: r[1] for r in con.sql("select doc_id, source from documents").fetchall()}
    taken, goal = {}, {}
    for r in rows:
        s = source[r.doc_id]
        taken[s], goal[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    if sf == "sf0.01":
        assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in goal)


def test_targets_fill_to_caps(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, None: 0, "d": 50, "e": 700}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    want, free, total = {}, set(names), sum(sizes.values())
    while True:
        share = total / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            total -= want[s]
        free -= over
    want |= {s: share * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, "", None), (3, "x " * 50000, "t"), (4, "y", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    sized = df.select("doc_id", "source", word_count().alias("size"))
    got = mix(df, mix_plan(sized)).collect()
    assert len(got) == 6 and {r.size for r in got if r.source is None} == {0}
    assert all(r.taken <= 3 * r.size for r in got)
    assert stage_mixing(spark, df, "").columns == df.columns
    empty = df.limit(0)
    assert mix(empty, mix_plan(empty.select("doc_id", "source", word_count().alias("size")))).count() == 0


def test_clashing_names(spark):
    rows = [(i, "a b c d e f"[: 2 * (i % 6) + 1], f"s{i % 3}") for i in range(90)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = plain
    for c in ("_u", "_s", "_target", "__s", "copies"):
        df = df.withColumn(c, F.lit("clash"))
    plan = mix_plan(plain.select("doc_id", "source", word_count().alias("size")))
    both = [{r.doc_id: r.taken for r in mix(x, plan).collect()} for x in (plain, df)]
    assert both[0] == both[1] and {r._u for r in mix(df, plan).collect()} == {"clash"}
