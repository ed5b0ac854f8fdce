"""Quality rules whose thresholds adapt to each language and source.

Per document, counts of words, symbols, repeated lines and repeated three-word windows. Of the documents that pass the fixed base rules, four rates are held in quantile sketches per
language and source: counts by logarithmic bucket, so each bucket is off by 1 % at most and two sketches merge by adding counts. Rates are smoothed by adding one to what is counted, as most are zero
otherwise: symbols to words, and odds of repeated lines and words to the others; and the mean length of words.

A threshold is a fence on the logarithmic scale: the upper quartile times a power of the ratio of the quartiles (for word length also the lower one over it). Nothing is a fixed cutoff: the parameters
FENCES are that power, and the least ratio that counts, without which a group of alike documents would have no width at all. A group of fewer than `least` documents takes the merged sketch of its language,
and a language of fewer that of all. The thresholds are then joined to the documents.

Rows: a null text has no words and fails the base rules; a null language or source is a value of its own. Very long texts count whole. Repeated rows are judged alike.
An empty table gives no rows. Count columns of the input with the same names are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import Rolling, bounded_batches, mix64, read, scratch, steps, stored, text_buffer, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Documents that a group needs for thresholds of its own, and the ratio of a sketch's buckets.
LEAST, RATIO = 100, 1.02
#: By rate: the power of the quartiles' ratio that a fence is away from its quartile, and the least ratio that counts.
FENCES = {"symbols": (2, 2.0), "dup_lines": (2, 2.0), "repeats": (3, 2.0), "word_length": (4, 1.08)}


def repeated(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes within rows: which are equal to an earlier one, and which to any other."""
    with np.errstate(over="ignore"):
        key = mix64(hashes ^ mix64(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    later, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same[:-1]
    other[order] = same[:-1] | same[1:]
    return later, other


def count_text(column: pa.Array, rolling: Rolling) -> dict[str, np.ndarray]:
    data, at = text_buffer(column)
    n = len(at) - 1
    start, end, row = words(data, at)
    total = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    characters, symbols = total((data & 0xC0) != 0x80), total(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    prefix = rolling.prefix(data)
    hashes = rolling.of(prefix, start, end)
    # lines: they begin where texts do and after each line end
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable")
    line_row = np.sort(np.concatenate((np.arange(n), np.searchsorted(at, breaks, side="right") - 1)), kind="stable")
    line_end = np.sort(np.concatenate((at[1:], breaks)), kind="stable")
    wordy = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    later, _ = repeated(line_row[wordy], rolling.of(prefix, line_start[wordy], line_end[wordy]))
    # windows of three words
    again = np.zeros(len(start), bool)
    if len(start) > 2:
        inside = row[2:] == row[:-2]
        with np.errstate(over="ignore"):
            triple = mix64(mix64(mix64(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        found = np.zeros(len(start) - 2, bool)
        found[inside] = repeated(row[:-2][inside], triple[inside])[1]
        for k in range(3):
            again[k : len(found) + k] |= found
    by = lambda rows, keep=None: np.bincount(rows if keep is None else rows[keep], minlength=n).astype(np.int64)
    lengths = np.bincount(row, weights=characters[end] - characters[start], minlength=n).astype(np.int64)
    return {"n_words": by(row), "word_chars": lengths, "n_symbols": symbols[at[1:]] - symbols[at[:-1]], "n_lines": by(line_row, wordy), "n_dup_lines": by(line_row[wordy], later), "n_repeat_words": by(row, again)}


def quality_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces `text` by its counts: a narrow map over the scan."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text and c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(7)
        for part in steps(batches, text):
            counts = count_text(part.column(text), rolling)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=[*rest, *COUNTS])

    schema = df.select(*rest).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return df.select(*rest, text).mapInArrow(run, schema)


def rates() -> dict[str, Column]:
    """What is judged, from the counts; none is ever zero for a document with words."""
    ratio = lambda a, b: (F.col(a) + F.lit(1.0)) / (b + F.lit(1.0))
    return {
        "symbols": ratio("n_symbols", F.col("n_words")),
        "dup_lines": ratio("n_dup_lines", F.col("n_lines") - F.col("n_dup_lines")),
        "repeats": ratio("n_repeat_words", F.col("n_words") - F.col("n_repeat_words")),
        "word_length": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) of the documents that pass the base rules: one sketch per language, source and rate. Sketches merge by adding n."""
    rows = counts.where(~base_failed()).select("lang", "source", F.inline(F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in rates().items()))))
    return rows.groupBy("lang", "source", "rate", F.ceil(F.ln("x") / F.ln(F.lit(RATIO))).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, total, least and most of each rate) from sketches merged by group. A window holds one sketch, whose size is bounded by its buckets."""
    merged = sketch.groupBy(*group, "rate", "bucket").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*group, "rate")
    merged = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    middle = lambda b: F.lit(2.0) * F.pow(F.lit(RATIO), b) / F.lit(1 + RATIO)
    quartile = lambda q: middle(F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("bucket"))))
    q = merged.groupBy(*group, "rate").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("total").alias("total"))
    out = [F.max("total").alias("total")]
    for k, (power, ratio) in FENCES.items():
        away = F.pow(F.greatest(F.col("q3") / F.col("q1"), F.lit(ratio)), F.lit(power))
        out += [F.max(F.when(F.col("rate") == k, F.col("q1") / away)).alias(f"least_{k}"), F.max(F.when(F.col("rate") == k, F.col("q3") * away)).alias(f"most_{k}")]
    return q.groupBy(*group).agg(*out)


def quality_limits(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Thresholds per language and source from stored counts, and the depth (2 own, 1 of the language, 0 of all) that they come from; one row per group, stored."""
    sketch = stored(sketches(counts), "sketches")
    own, lang = (stored(fences(sketch, *g), "fences") for g in (("lang", "source"), ("lang",)))
    every = fences(sketch).first()  # one row: all
    names = [c for c in own.columns if c.startswith(("least_", "most_"))]
    lang = lang.withColumnsRenamed({c: f"lang_{c}" for c in lang.columns})
    both = own.join(lang, own["lang"].eqNullSafe(lang["lang_lang"])).withColumn("depth", F.when(F.col("total") >= least, 2).when(F.col("lang_total") >= least, 1).otherwise(0))
    chosen = (F.when(F.col("depth") == 2, F.col(c)).when(F.col("depth") == 1, F.col(f"lang_{c}")).otherwise(F.lit(every[c]).cast("double")).alias(c) for c in names)
    return stored(both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "depth", *chosen), "limits")


def quality_rules(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Counts, base_failed and kept of each document of (doc_id, lang, source, `text`).

    The text is scanned once; the counts are stored, summed by group and bucket (combined before the shuffle), and joined with the groups' limits, which Spark broadcasts where their stored size allows."""
    with scratch(df.sparkSession) as keep:
        counts = keep(stored(quality_counts(df.select("doc_id", "lang", "source", text), text), "counts"))
        limits = keep(quality_limits(counts, least))
    fine = F.lit(True)
    for k, x in rates().items():
        fine = fine & (x <= F.col(f"most_{k}"))
    fine = fine & (rates()["word_length"] >= F.col("least_word_length"))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(fine).alias("kept"))


#: Written apart from the operator: counts from texts, quartiles by the engine's own discrete quantile of buckets, fences by hand.
ORACLE_SQL = r"""
with docs as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
split as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
word as (select rid, unnest(w) as w, generate_subscripts(w, 1) as i from split),
window3 as (select rid, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from word window o as (partition by rid order by i)),
found as (select rid, i, w, w3 is not null and count(*) over (partition by rid, w, w2, w3) > 1 as twice from window3),
marked as (select rid, w, twice or coalesce(lag(twice, 1) over o, false) or coalesce(lag(twice, 2) over o, false) as again from found window o as (partition by rid order by i)),
by_word as (select rid, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (again) as n_repeat_words from marked group by rid),
line as (select rid, unnest(string_split(text, chr(10))) as l from docs),
by_line as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
c as (
  select d.doc_id, d.lang, d.source, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from docs d left join by_word using (rid) left join by_line using (rid)),
r as (
  select *, n_words < 50 or 2 * n_repeat_words > n_words as base_failed, (n_symbols + 1e0) / (n_words + 1e0) as sy, (n_dup_lines + 1e0) / (n_lines - n_dup_lines + 1e0) as du,
         (n_repeat_words + 1e0) / (n_words - n_repeat_words + 1e0) as re, cast(word_chars as double) / nullif(n_words, 0) as wl
  from c),
b as (select lang, source, cast(ceil(ln(sy) / ln(1.02e0)) as int) as sy, cast(ceil(ln(du) / ln(1.02e0)) as int) as du, cast(ceil(ln(re) / ln(1.02e0)) as int) as re, cast(ceil(ln(wl) / ln(1.02e0)) as int) as wl from r where not base_failed),
s2 as (select lang, source, count(*) as n, quantile_disc(sy, [0.25, 0.75]) as sy, quantile_disc(du, [0.25, 0.75]) as du, quantile_disc(re, [0.25, 0.75]) as re, quantile_disc(wl, [0.25, 0.75]) as wl from b group by lang, source),
s1 as (select lang, count(*) as n, quantile_disc(sy, [0.25, 0.75]) as sy, quantile_disc(du, [0.25, 0.75]) as du, quantile_disc(re, [0.25, 0.75]) as re, quantile_disc(wl, [0.25, 0.75]) as wl from b group by lang),
s0 as (select quantile_disc(sy, [0.25, 0.75]) as sy, quantile_disc(du, [0.25, 0.75]) as du, quantile_disc(re, [0.25, 0.75]) as re, quantile_disc(wl, [0.25, 0.75]) as wl from b),
picked as (
  select s2.lang, s2.source, case when s2.n >= 100 then s2.sy when s1.n >= 100 then s1.sy else s0.sy end as sy, case when s2.n >= 100 then s2.du when s1.n >= 100 then s1.du else s0.du end as du,
         case when s2.n >= 100 then s2.re when s1.n >= 100 then s1.re else s0.re end as re, case when s2.n >= 100 then s2.wl when s1.n >= 100 then s1.wl else s0.wl end as wl
  from s2 join s1 on s2.lang is not distinct from s1.lang, s0),
v as (
  select lang, source, list_transform(sy, lambda x: 2e0 * pow(1.02e0, x) / 2.02e0) as sy, list_transform(du, lambda x: 2e0 * pow(1.02e0, x) / 2.02e0) as du,
         list_transform(re, lambda x: 2e0 * pow(1.02e0, x) / 2.02e0) as re, list_transform(wl, lambda x: 2e0 * pow(1.02e0, x) / 2.02e0) as wl
  from picked)
select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       not r.base_failed and r.sy <= v.sy[2] * pow(greatest(2e0, v.sy[2] / v.sy[1]), 2) and r.du <= v.du[2] * pow(greatest(2e0, v.du[2] / v.du[1]), 2)
       and r.re <= v.re[2] * pow(greatest(2e0, v.re[2] / v.re[1]), 3) and r.wl <= v.wl[2] * pow(greatest(1.08e0, v.wl[2] / v.wl[1]), 4) and r.wl >= v.wl[1] / pow(greatest(1.08e0, v.wl[2] / v.wl[1]), 4) as kept
from r left join v on r.lang is not distinct from v.lang and r.source is not distinct from v.source
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
