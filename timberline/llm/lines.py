"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line of at least `least` code points is dropped if an earlier one (by doc_id, then place in its document) is equal to it or one insertion,
deletion or substitution away, whether or not that earlier line is kept itself. By default every line that holds a word takes part. Empty lines
part paragraphs and always stay, as do lines of under BLANK code points of white space only.

Equal lines meet in one aggregate. Two lines one edit apart share, of one half of them, everything outside; so distinct lines are first keyed by what lies outside each
half, and only those whose key another line has are candidates. These emit every variant with one character of the half deleted, as hashed keys.
Equal keys join: a line that equals another's variant is an insertion or deletion away, and variants equal at the same place come of a substitution.
For each key only the earliest line matters, which an aggregate finds, so no pairs within a group are listed. Edit distances of the matches are verified.

Rows: a null text has no lines; very long lines and texts count whole; a null doc_id comes last; rows that repeat a doc_id and text are equally early, so both keep their lines.
An empty table gives no rows. Other columns pass through; n_lines, n_dropped and dropped replace columns of these names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import Rolling, beside, bounded_batches, dealt, mix64, read, scratch, steps, stored, text_buffer

LEAST = 1
#: Code points from which a line without a word takes part too.
BLANK = 40
FIRST, SECOND = Rolling(21), Rolling(22)


def split_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The step's code points, and each line's row, start and end among them."""
    data, at = text_buffer(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = count[at]
    breaks = np.flatnonzero(points == 10)
    rows = np.searchsorted(at, breaks, side="right") - 1
    row = np.sort(np.concatenate((np.arange(len(at) - 1), rows)), kind="stable")
    return points, row, np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable"), np.sort(np.concatenate((at[1:], breaks)), kind="stable")


def places(row: np.ndarray) -> np.ndarray:
    """Each line's number within its row."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def wordy(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines hold a word, that is any code point besides white space."""
    upto = np.concatenate(([0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))))
    return upto[end] > upto[start]


def outside(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, half: int) -> np.ndarray:
    """Hash of what lies outside a half, of lines taken as edits of `length` code points (their own length, or one less)."""
    middle = length // 2
    before = np.where(half == 0, 0, middle)
    after = np.where(half == 0, length - middle, 0)
    salt = (length * 2 + half).astype(np.uint64)
    return mix64(FIRST.of(prefix, start, start + before) + mix64(FIRST.of(prefix, end - after, end) + salt))


def variants(points: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line with the character at each place of low .. high - 1 deleted, and the places."""
    n = len(points)
    prefix = FIRST.prefix(points)
    at = np.arange(low, high)
    inverse = np.uint64(FIRST.inverse)
    with np.errstate(over="ignore"):
        raw = prefix[at] + (prefix[n] - prefix[at + 1]) * inverse
        out = mix64(raw + np.uint64(n - 1) * np.uint64(0xD6E8FEB86659FD93))
    return out, at


def _order(doc: str = "doc_id", line: str = "line", key: str = "text_hash") -> Column:
    """A line's place; the text's hash comes last and only tells rows of one doc_id apart."""
    return F.struct(F.col(doc).isNull().alias("last"), F.col(doc).alias("doc"), F.col(line).alias("line"), F.col(key).alias("text_hash"))


def _earlier(a: str, b: str) -> Column:
    """Whether a place comes before another, whatever the text's hash."""
    return F.struct(f"{a}.last", f"{a}.doc", f"{a}.line") < F.struct(f"{b}.last", f"{b}.doc", f"{b}.line")


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.xxhash64(text).alias("text_hash"), text)


def _line_rows(df: DataFrame, text: str, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            points, row, start, end = split_lines(part.column(text))
            line, length = places(row), end - start
            keep = (length >= least) & ((length >= BLANK) | wordy(points, start, end))
            row, start, end, line, length = row[keep], start[keep], end[keep], line[keep], length[keep]
            p1, p2 = FIRST.prefix(points), SECOND.prefix(points)
            keys = np.stack([outside(p1, start, end, length - less, half) for less in (0, 1) for half in (0, 1)], axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * 4), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)), pa.array(line.astype(np.int32)), pa.array(FIRST.of(p1, start, end).view(np.int64)), pa.array(SECOND.of(p2, start, end).view(np.int64)), listed],
                names=["doc_id", "text_hash", "line", "h1", "h2", "keys"],
            )

    return _keyed(df, text).mapInArrow(run, "doc_id long, text_hash long, line int, h1 long, h2 long, keys array<long>")


def _candidate_texts(df: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Texts of the lines in `wanted` (w_doc, w_hash, array of (line, h1, h2, keys))."""
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_hash") == F.col("w_hash"))
    joined = _keyed(df, text).join(dealt(wanted), same).select("doc_id", "text_hash", text, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            out = []
            for r in part.to_pylist():
                lines = (r[text] or "").split("\n")
                for w in r["wanted"]:
                    if w["line"] < len(lines):
                        own = lines[w["line"]]
                        points = np.frombuffer(own.encode("utf-32-le"), np.uint32)
                        prefix, whole = FIRST.prefix(points), np.array([len(points)])
                        if len(own) and FIRST.of(prefix, np.zeros(1, np.int64), whole).view(np.int64)[0] == w["h1"]:
                            out.append({"doc_id": r["doc_id"], "text_hash": r["text_hash"], **w, "text": own})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("text", pa.string())])
    return joined.mapInArrow(run, "doc_id long, text_hash long, line int, h1 long, h2 long, keys array<long>, text string")


def _neighbourhood(texts: DataFrame) -> DataFrame:
    """(v, place, doc_id, text_hash, line, h1, h2): each candidate itself at place -1, and its variants within the halves whose outside another line shares."""
    schema = pa.schema([("v", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 1 << 16):
            made = []
            for r in part.to_pylist():
                points = np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)
                n = len(points)
                prefix, zero, whole = FIRST.prefix(points), np.zeros(1, np.int64), np.array([n])
                held, got = set(r["keys"]), [(np.array([r["h1"]], np.int64), np.array([-1]))]
                for less in (0, 1):
                    for half in (0, 1):
                        if int(outside(prefix, zero, whole, whole - less, half).view(np.int64)[0]) in held:
                            middle = (n - less) // 2
                            v, at = variants(points, 0 if half == 0 else middle, min(n, middle + 1) if half == 0 else n)
                            got.append((v.view(np.int64), at))
                v, at = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                _, once = np.unique(at, return_index=True)
                made.append((v[once], at[once], r))
            sizes = [len(v) for v, _, _ in made]
            owner = pa.array(np.repeat(np.arange(len(made)), sizes))
            mine = [pa.array([r[c] for _, _, r in made], schema.field(c).type).take(owner) for c in ("doc_id", "text_hash", "line", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for v, _, _ in made])), pa.array(np.concatenate([a for _, a, _ in made]).astype(np.int32)), *mine], schema=schema)

    return texts.mapInArrow(run, "v long, place int, doc_id long, text_hash long, line int, h1 long, h2 long")


def near_lines(distinct: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """(h1, h2, near): for a distinct line the earliest place of another one within one edit, where that is earlier than its own; verified."""
    keyed = distinct.select("h1", "h2", "first", F.explode(F.array_distinct("keys")).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")), "shared")
    wanted = keyed.join(shared, keyed["key"] == shared["k"]).groupBy("h1", "h2", "first").agg(F.collect_set("key").alias("keys"))
    wanted = stored(wanted.groupBy(F.col("first.doc").alias("w_doc"), F.col("first.text_hash").alias("w_hash")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1", "h2", "keys")).alias("wanted")), "candidates")
    texts = stored(_candidate_texts(df, wanted, text).dropDuplicates(["h1", "h2"]), "candidate-lines")
    near = stored(_neighbourhood(texts), "neighbourhood")
    own = _order()
    by_edit = near.groupBy("v").agg(F.min(F.when(F.col("place") < 0, own)).alias("base"), F.min(F.when(F.col("place") >= 0, own)).alias("variant")).where("base is not null and variant is not null").withColumnRenamed("v", "k")
    one = near.join(by_edit, near["v"] == by_edit["k"]).select("h1", "h2", own.alias("own"), F.when(F.col("place") < 0, F.col("variant")).otherwise(F.col("base")).alias("other"))
    by_place = near.where("place >= 0").groupBy(F.col("v").alias("k"), F.col("place").alias("p")).agg(F.min(own).alias("other"), F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    two = near.join(by_place, (near["v"] == by_place["k"]) & (near["place"] == by_place["p"])).select("h1", "h2", own.alias("own"), "other")
    match = one.union(two).where(_earlier("other", "own")).select("h1", "h2", "other").distinct()
    a, b = texts.select("h1", "h2", F.col("text").alias("a")), texts.select(_order().alias("other"), F.col("text").alias("b"))
    match = match.join(a, ["h1", "h2"]).join(b, "other").where(F.levenshtein("a", "b", 1) >= 0)
    return match.groupBy("h1", "h2").agg(F.min("other").alias("near"))


def dropped_lines(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(d_doc, d_hash, drops: array of (line, h1)) of the documents that lose lines; stored.

    Hashes and keys of lines are shuffled, and the texts once, for the few candidates' lines."""
    with scratch(df.sparkSession) as keep:
        lines = stored(_line_rows(df, text, least), "lines")
        distinct = stored(lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("n"), F.min("keys").alias("keys")), "distinct-lines")
        near = stored(near_lines(distinct, df, text), "near-lines").withColumnsRenamed({"h1": "n1", "h2": "n2"})
        best = distinct.join(near, (distinct["h1"] == near["n1"]) & (distinct["h2"] == near["n2"]), "left").where("n > 1 or near is not null")
        best = stored(best.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.least("first", F.coalesce("near", "first")).alias("best")), "best")
        gone = lines.join(best, (lines["h1"] == best["b1"]) & (lines["h2"] == best["b2"])).withColumn("own", _order()).where(_earlier("best", "own"))
        return keep(stored(gone.groupBy(F.col("doc_id").alias("d_doc"), F.col("text_hash").alias("d_hash")).agg(F.collect_set(F.struct("line", "h1")).alias("drops")), "dropped"))


def dedup_lines(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Takes the dropped lines out of `text`; adds n_lines (before), n_dropped and dropped (their numbers from 0)."""
    bounded_batches(df.sparkSession)
    new = ("n_lines", "n_dropped", "dropped")
    other = {c: f"kept_{i}" for i, c in enumerate(df.columns) if c not in (*new, text, "doc_id")}
    inner = df.select("doc_id", F.col(text).alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in other.items()))
    back = {"doc_id": "doc_id", text: "text"} | other
    return _without_lines(inner, least).select(*(F.col(back[c]).alias(c) for c in df.columns if c not in new), *new)


def _without_lines(df: DataFrame, least: int) -> DataFrame:
    text, kept = "text", df.columns
    drops = dropped_lines(df, text, least)
    same = F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.xxhash64(text) == F.col("d_hash"))
    joined = df.join(dealt(drops), same, "left").select(*kept, "drops")
    names = [*kept, "n_lines", "n_dropped", "dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            texts, counts, gone = part.column(text).to_pylist(), [], []
            for i, drop in enumerate(part.column("drops").to_pylist()):
                lines = (texts[i] or "").split("\n") if texts[i] is not None else []
                out = set()
                for d in drop or ():
                    if d["line"] < len(lines):
                        points = np.frombuffer(lines[d["line"]].encode("utf-32-le"), np.uint32)
                        if FIRST.of(FIRST.prefix(points), np.zeros(1, np.int64), np.array([len(points)])).view(np.int64)[0] == d["h1"]:
                            out.add(d["line"])
                counts.append(len(lines))
                gone.append(sorted(out))
                if out:
                    texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in out)
            arrays = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=names)

    schema = T.StructType(df.select(*kept).schema.fields).add("n_lines", "long").add("n_dropped", "long").add("dropped", T.ArrayType(T.IntegerType()))
    return joined.mapInArrow(run, schema)


#: Pairs of distinct lines that share one half, compared character by character.
ORACLE_SQL = r"""
with t as (select row_number() over () as rid, doc_id, text from documents),
split as (select rid, doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from t where text is not null),
line as (select * from split where regexp_matches(l, '[^\x20\x09-\x0D]') or length(l) >= 40),
u as (select l, length(l) as n, min({'last': doc_id is null, 'doc': coalesce(doc_id, 0), 'line': k}) as first from line group by l),
low as (
  select l, n as m, 'prefix' as side, left(l, n // 2) as key from u union all select l, n, 'suffix', right(l, n - n // 2) from u),
high as (
  select l, m, 'prefix' as side, left(l, m // 2) as key from (select l, unnest([n, n - 1]) as m from u)
  union all select l, m, 'suffix', right(l, m - m // 2) from (select l, unnest([n, n - 1]) as m from u)),
pair as (select distinct low.l as a, high.l as b, low.m from low join high on low.m = high.m and low.side = high.side and low.key = high.key where low.l <> high.l),
differ as (select a, b, m, list_position(list_transform(range(1, m + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)), true) as p from pair),
near as (
  select a, b from differ
  where p is null or (length(b) = m and substr(a, p + 1) = substr(b, p + 1)) or (length(b) = m + 1 and substr(a, p) = substr(b, p + 1))),
both_ways as (select a as l, b as other from near union all select b, a from near union all select l, l from u),
best as (select w.l, min(u.first) as best from both_ways w join u on w.other = u.l group by w.l),
gone as (select line.rid, line.k from line join best on line.l = best.l where {'last': line.doc_id is null, 'doc': coalesce(line.doc_id, 0), 'line': line.k} > best.best),
drops as (select rid, count(*) as n, string_agg(cast(k as varchar), ',' order by k) as dropped from gone group by rid),
kept as (
  select s.rid, count(*) as n_lines, string_agg(s.l, chr(10) order by s.k) filter (g.rid is null) as body
  from split s left join gone g on s.rid = g.rid and s.k = g.k group by s.rid)
select t.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(d.n, 0) as bigint) as n_dropped, coalesce(d.dropped, '') as dropped, sha256(coalesce(body, '')) as kept_sha256
from t left join kept on t.rid = kept.rid left join drops d on t.rid = d.rid
"""


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their dropped lines; one that loses its last word with them goes."""
    return beside(docs, ("doc_id", "text"), lambda d: dedup_lines(d).where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'"))
