import random

from pyspark.sql import functions as F

from timberline.llm.lines import LEAST, dedup_lines, op9_lines, stage_lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, least):
    lines = [((d is None, d or 0, k), x) for d, t in rows for k, x in enumerate((t or "").split("\n")) if len(x) >= least]
    first = {}
    for at, x in sorted(lines):
        first.setdefault(x, at)
    best = {x: min(first[y] for y in first if within_one(x, y)) for x in first}
    return {(at, x) for at, x in lines if at > best[x]}


def check(spark, rows, least):
    gone = brute(rows, least)
    want = []
    for d, t in rows:
        keep = [x for k, x in enumerate((t or "").split("\n")) if ((d is None, d or 0, k), x) not in gone]
        want.append((d, None if t is None else "\n".join(keep)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dropped", F.lit("clash"))
    got = [(r.doc_id, r.text) for r in dedup_lines(df, least=least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_by_brute_force(spark):
    r = random.Random(4)
    rows, pool = [], ["".join(r.choice("aabé ") for _ in range(r.randint(0, 9))) for _ in range(40)]
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(pool)
            if x and r.random() < 0.5:
                p = r.randrange(len(x))
                x = r.choice([x[:p] + x[p + 1 :], x[:p] + "z" + x[p:], x[:p] + "y" + x[p + 1 :], x + "w"])
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    check(spark, rows, 4)


def test_odd_rows(spark):
    long = "x" * 30000
    base = "a line of more than forty code points, it is ü"
    rows = [(3, None), (1, ""), (2, base), (2, base), (2, base + "\nother"), (9, base[1:] + "\n" + base + "\n" + base), (None, base.replace("f", "g", 1)), (5, long + "\n" + long[1:]), (6, "short\nshort")]
    check(spark, rows, LEAST)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(1, base, 7), (2, base, 8), (3, "", 9)], "doc_id long, text string, n_lines int")
    assert sorted((r.doc_id, r.n_lines) for r in stage_lines(spark, df, "").collect()) == [(1, 7), (3, 9)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    gone = brute(rows, LEAST)
    got = op9_lines(spark, d).collect()
    assert sum(r.n_dropped for r in got) == len(gone) > 0 and len(got) == len(rows)
    assert {r.doc_id for r in got if r.n_dropped} == {at[1] for at, _ in gone}


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\n\nü\nOne"), (2, "All rights reserved.\n\n \nTwo"), (3, "All rights reserved\n\n \nü\n\r"), (4, "\r\nü"), (5, " " * 50), (6, " " * 50)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n \nTwo", 1), 3: ("\n \n\r", 2), 4: ("\r", 1), 5: (" " * 50, 0), 6: ("", 1)}


def test_short_lines_by_brute_force(spark):
    r = random.Random(8)
    rows = [(d, "\n".join("".join(r.choice("abcdefghijklmnopqé") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12]))) for _ in range(r.randint(0, 5)))) for d in range(60)]
    check(spark, rows + [(d + 100, t) for d, t in rows[::3]], LEAST)


def test_null_ids_and_clashing_names(spark):
    """Rows without an id keep apart by their texts; columns of any name pass through."""
    rows = [(None, f"line number {i % 3} of some length\nown {i} {'abcdefgh'[i % 8] * 9} line") for i in range(40)] + [(4, "line number 1 of some length"), (4, "other text\nline number 2 of some length")]
    check(spark, rows, LEAST)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("drops", "d_doc", "d_hash", "text_hash", "kept_0"):
        df = df.withColumn(c, F.lit(c))
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped", "dropped"]
    assert all(r[c] == c for r in out.collect() for c in ("drops", "d_doc", "d_hash", "text_hash", "kept_0"))
