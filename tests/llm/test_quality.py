import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.llm.quality import ORACLE_SQL, RATIO, op7_quality, quality_counts, quality_limits, quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_by_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", "\n\n", " a", "a a a a", "\x1c\x85 x y", "z" * 70000, "dup\n\ndup\n dup\ndup\r\ndup\r"]
    texts += ["".join(r.choice(["ab", "é", " ", "\n", "#", "<", "\t", "a b c ", "\v", "漢"]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {x.doc_id: tuple(x[n] for n in NAMES) for x in quality_counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    q = con.sql(ORACLE_SQL)
    got = op7_quality(spark, d)
    assert sorted(got.columns) == sorted(q.columns)
    assert sorted(map(tuple, got.select(*q.columns).collect())) == sorted(q.fetchall())


def test_verdicts(spark):
    r = random.Random(5)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(120))
    rows = [(i, prose(), "en", None) for i in range(300)] + [(1000, " ".join(w + "###" for w in prose().split()), "en", None), (1001, None, None, "s"), (1002, "few words", "en", "s"), (1003, " ".join("x" * 40 + str(i) for i in range(90)), "en", None), (7, prose(), None, None), (7, prose(), None, None)]
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(1000, 1004))
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def fence(values, power, ratio):
    """The lower and upper fence by sorting, to a bucket's precision."""
    v = sorted(values)
    low, high = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75))
    away = max(ratio, high / low) ** power
    return low / away, high * away


def test_limits_follow_the_data(spark):
    r = random.Random(6)

    def prose(n, symbols, width):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(width, width + 3))) + "#" * (r.random() < symbols) for _ in range(n))

    kinds = {"code": (0.5, 3), "news": (0.0, 4), "talk": (0.02, 2)}
    rows = [(k * 1000 + i, prose(r.randint(60, 400), *kinds[s]), "en", s) for k, s in enumerate(kinds) for i in range(150)]
    rows += [(9000 + i, prose(100, 0.5, 3), "en", "news") for i in range(3)] + [(9100 + i, prose(100, 0.5, 3), "en", "code") for i in range(3)]
    rows += [(9200 + i, prose(80, 0.0, 4), "fr", "few") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = quality_counts(df)
    limits = {x.g_source: x for x in quality_limits(counts).collect()}
    assert limits["few"].depth == 0 and {limits[s].depth for s in kinds} == {2}
    assert limits["code"].most_symbols > 5 * limits["talk"].most_symbols > 5 * 1.5 * limits["news"].most_symbols
    assert limits["news"].most_word_length > limits["code"].most_word_length > limits["talk"].most_word_length
    held = counts.collect()
    for s in kinds:
        own = [x for x in held if x.source == s]
        for name, got, (low, high) in (
            ("symbols", limits[s], fence([(x.n_symbols + 1) / (x.n_words + 1) for x in own], 2, 2)),
            ("word_length", limits[s], fence([x.word_chars / x.n_words for x in own], 4, 1.08)),
        ):
            assert abs(math.log(got[f"most_{name}"] / high)) < 10 * math.log(RATIO) and abs(math.log(got[f"least_{name}"] / low)) < 10 * math.log(RATIO)
    kept = {x.doc_id: x.kept for x in quality_rules(df).collect()}
    assert all(v for k, v in kept.items() if k < 9000) and all(kept[9100 + i] for i in range(3)) and not any(kept[9000 + i] for i in range(3))
    assert all(kept[9200 + i] for i in range(20))


def test_sketches_merge(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["ab", "cde", "f#"]) + str(r.randrange(10**6)) for _ in range(60 + i % 90)), "en", f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    alone = quality_limits(quality_counts(df.withColumn("source", F.lit("all")))).first()
    merged = quality_limits(quality_counts(df), least=200).collect()
    assert len(merged) == 3 and {x.depth for x in merged} == {1}
    assert all(x[c] == alone[c] for x in merged for c in x.asDict() if c.startswith(("least_", "most_")))


def test_odd_rows(spark):
    long = "word and other things " * 40000
    rows = [(1, long, None, None), (1, long, None, None), (None, None, "en", None), (2, "", "en", "s"), (3, "one", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("kept", "rate", "bucket", "g_lang", "total", "most_symbols"):
        df = df.withColumn(c, F.lit("clash"))
    got = quality_rules(df).collect()
    assert sorted((str(x.doc_id), x.n_words, x.base_failed, x.kept) for x in got) == [("1", 160000, True, False)] * 2 + [("2", 0, True, False), ("3", 1, True, False), ("None", 0, True, False)]
