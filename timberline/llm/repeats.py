"""Exact removal of bytes that a long string repeats, by column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

A byte goes if it lies in a string of `length` bytes (a window) that also starts anywhere else, in the same text or another; windows are judged on the input.

1. Anchors cut the work into small collections. Of the strings of `gram` bytes in a window, the one with the least hash, the leftmost if tied, is its anchor. Equal windows have
   equal anchors at equal offsets. Consecutive windows with one anchor form a run, whose bytes (its span) are held as a 128-bit hash.
2. Anchors that occur once have no repeated window. Of the others, a span that occurs twice is repeated as a whole. So equal spans are one class with a count.
3. What is left are anchors with several classes, some of which occur once: the ends of repeats. Their spans form collections, whole anchors together, the
   anchor's bytes as one symbol. A collection's transform grows by one symbol of each string a round, from the right; each round reads the columns of transform, common prefixes and
   row owners of the last one in sequence and writes the next. As collections are bounded, the columns are held in memory: executors have no folder of their own to rely on. Rows that share `length - gram + 1` symbols from one anchor are equal windows.
4. Anchors with more than HOT classes are not put in one collection: their windows are hashed (128 bits) and counted by an aggregate that combines before the shuffle.

Rows: a null text counts as empty; texts under `length` bytes lose nothing; very long texts count whole; repeated rows repeat each other's strings, even with
the same or a null doc_id. An empty table gives no rows. Other columns pass through; columns named as the results are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import Rolling, bounded_batches, dealt, mix64, partitions, read, scratch, steps, stored, text_buffer

LENGTH, GRAM = 400, 304
#: Classes of an anchor above which its windows are counted by hash, and strings of a collection.
HOT, COLLECTION = 4096, 1536
#: Symbols that no UTF-8 text holds: the anchor, and what precedes a whole string.
ANCHOR, END = 0xFE, 0xFF
FIRST, SECOND = Rolling(31), Rolling(32)


def anchor_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor place (all in the buffer) and anchor hash of each run; and the first prefix sums."""
    n, wide = len(data), length - gram + 1
    prefix = FIRST.prefix(data)
    starts = [np.arange(a, b - length + 1) for a, b in zip(at[:-1], at[1:]) if b - a >= length]
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), prefix
    window = np.concatenate(starts)
    place = np.arange(n - gram + 1)
    grams = FIRST.of(prefix, place, place + gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(window)])) - 1
    anchor = chosen[first]
    return np.searchsorted(at, window[first], side="right") - 1, window[first], window[last], anchor, grams[anchor], prefix


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.xxhash64(text).alias("text_hash"), text)


RUN = pa.schema([("g", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("anchor", pa.int32())])
RUN_SQL = "g long, h1 long, h2 long, doc_id long, text_hash long, first int, last int, anchor int"


def _grams(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(anchor_runs(*text_buffer(part.column(text)), length, gram)[4].view(np.int64))], names=["g"])

    return df.select(text).mapInArrow(run, "g long")


def _runs(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            data, at = text_buffer(part.column(text))
            row, first, last, anchor, g, prefix = anchor_runs(data, at, length, gram)
            h1, h2 = FIRST.of(prefix, first, last + length), SECOND.of(SECOND.prefix(data), first, last + length)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("doc_id").take(own), part.column("text_hash").take(own), *(pa.array((x - at[row]).astype(np.int32)) for x in (first, last, anchor))],
                schema=RUN,
            )

    return _keyed(df, text).mapInArrow(run, RUN_SQL)


def merged_in(old: np.ndarray, new: np.ndarray, kept: np.ndarray, to: np.ndarray) -> np.ndarray:
    """One sequential pass: the old column with new values at their places."""
    out = np.empty(len(kept), old.dtype)
    out[kept] = old
    out[to] = new
    return out


def collection_rows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, suffix length and common prefix with the row before, of all suffixes of the strings in order.

    Round j inserts each string's suffix of j symbols. The symbol c before the suffix of the last round, at row p, gives its place: rows of the ends, then as many as there are smaller
    symbols in the transform, then the c's before p. Its common prefix with its neighbours there is one more than the least between p and the c before, and the c after.
    The columns (transform, common prefixes, owners, lengths) are read and written anew in sequence each round; seven bytes a symbol of the collection are held."""
    m, sizes = len(strings), np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(sizes)
    final = lambda who, j: np.where(sizes[who] > j, flat[np.maximum(end[who] - 1 - j, 0)], END).astype(np.uint8)
    everyone = np.arange(m)
    transform, common, owner, size = final(everyone, 0), np.zeros(m, np.uint16), everyone.astype(np.uint16), np.zeros(m, np.uint16)
    place = everyone.copy()  # row of each string's latest suffix
    for j in range(1, int(sizes.max(initial=0)) + 1):
        who = np.flatnonzero(sizes >= j)
        who = who[np.argsort(place[who])]
        p = place[who]
        n = len(transform)
        order = np.argsort(transform, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        r, c = rank[p], transform[p]
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
        has_before, has_after = (r > 0) & (transform[before] == c), (r + 1 < n) & (transform[after] == c)
        shared = np.append(common, 0)

        def between(low, high, has):
            out = np.zeros(len(low), np.int64)
            if has.any():
                out[has] = np.minimum.reduceat(shared, np.stack([low[has] + 1, high[has] + 1], axis=1).ravel())[::2] + 1
            return out

        with_before, with_after = between(before, p, has_before), between(p, after, has_after)
        to = m + r
        kept = np.ones(n + len(who), bool)
        kept[to] = False
        transform, common = merged_in(transform, final(who, j), kept, to), merged_in(common, with_before, kept, to)
        owner, size = merged_in(owner, who, kept, to), merged_in(size, j, kept, to)
        common[to[has_after] + 1] = with_after[has_after]
        place[who] = to
    return owner.astype(np.int64), size.astype(np.int64), common.astype(np.int64)


def equal_windows(strings: list[bytes], left: np.ndarray, group: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each window (a suffix that starts at or before the anchor) that another one of its group equals."""
    owner, size, common = collection_rows(strings)
    offset = np.array([len(s) for s in strings])[owner] - size
    run = np.cumsum(common < wide)
    ok = (size >= wide) & (offset <= left[owner])
    owner, offset, run = owner[ok], offset[ok], run[ok]
    _, key, count = np.unique(np.stack([run, group[owner]], axis=1), axis=0, return_inverse=True, return_counts=True)
    twice = count[key.ravel()] > 1
    return owner[twice], offset[twice]


STRINGS_SQL = "g long, h1 long, h2 long, n long, classes long, before binary, after binary"


def _strings(df: DataFrame, edge: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """What stands before and after the anchor in each class of `edge`, from a text that has it."""
    item = F.struct("g", "h1", "h2", "n", "classes", F.col("at.first").alias("first"), F.col("at.last").alias("last"), F.col("at.anchor").alias("anchor"))
    lists = stored(edge.groupBy(F.col("at.doc").alias("e_doc"), F.col("at.text_hash").alias("e_hash")).agg(F.collect_list(item).alias("items")), "edges-by-text")
    joined = _keyed(df, text).join(dealt(lists), F.col("doc_id").eqNullSafe(F.col("e_doc")) & (F.col("text_hash") == F.col("e_hash"))).select(text, "items")
    kinds = pa.schema([*((k, pa.int64()) for k in ("g", "h1", "h2", "n", "classes")), ("before", pa.binary()), ("after", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            out = []
            for t, items in zip(part.column(text).to_pylist(), part.column("items").to_pylist()):
                data = (t or "").encode()
                for x in items:
                    a = x["anchor"]
                    out.append({k: x[k] for k in ("g", "h1", "h2", "n", "classes")} | {"before": data[x["first"] : a], "after": data[a + gram : x["last"] + length]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return joined.mapInArrow(run, STRINGS_SQL).dropDuplicates(["h1", "h2"])


PART = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _by_collections(strings: DataFrame, wide: int) -> DataFrame:
    """(h1, h2, low, high): runs of offsets of repeated windows in classes that occur once."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        texts = [r["before"] + bytes([ANCHOR]) + r["after"] for r in rows]
        owner, offset = equal_windows(texts, np.array([len(r["before"]) for r in rows]), np.array([r["g"] for r in rows]), wide)
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(owner) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(owner)])).astype(np.int64) - 1
        found = [(rows[owner[a]], int(offset[a]), int(offset[b])) for a, b in zip(first, last)]
        return pa.RecordBatch.from_pylist([{"h1": r["h1"], "h2": r["h2"], "low": a, "high": b} for r, a, b in found if r["n"] == 1], schema=PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= COLLECTION and r["g"] != held[-1]["g"]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    return strings.repartition(4 * partitions(strings.sparkSession), "g").sortWithinPartitions("g").mapInArrow(run, "h1 long, h2 long, low int, high int")


def _by_counts(strings: DataFrame, wide: int) -> DataFrame:
    """The same for anchors with very many classes, from counts of window hashes."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("low", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = []
                for r in batch.slice(at, 512).to_pylist():
                    data = np.frombuffer(r["before"] + bytes([ANCHOR]) + r["after"], np.uint8)
                    start = np.arange(len(data) - wide + 1)
                    salt = mix64(np.array([r["g"]], np.int64).view(np.uint64))
                    w1, w2 = (mix64(x.of(x.prefix(data), start, start + wide) ^ salt).view(np.int64) for x in (FIRST, SECOND))
                    got.append((w1, w2, np.full(len(start), r["h1"]), np.full(len(start), r["h2"]), np.full(len(start), r["n"]), start.astype(np.int32)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], schema=schema)

    windows = strings.mapInArrow(run, "w1 long, w2 long, h1 long, h2 long, n long, low int")
    twice = windows.groupBy(F.col("w1").alias("k1"), F.col("w2").alias("k2")).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").drop("a", "b")
    return windows.where("n = 1").join(twice, (F.col("w1") == F.col("k1")) & (F.col("w2") == F.col("k2"))).select("h1", "h2", "low", F.col("low").alias("high"))


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(r_doc, r_hash, spans: array of (start, stop)) of the texts that hold repeated windows; stored.

    Shuffled are hashes of anchors (combined first), then rows of anchors, joined with those that repeat, and the texts once, for what stands around anchors of mixed classes.
    Nothing is broadcast, so the plan is the same at every size."""
    with scratch(df.sparkSession) as keep:
        return keep(_repeated_spans(df, text, length, gram, hot))


def _repeated_spans(df: DataFrame, text: str, length: int, gram: int, hot: int) -> DataFrame:
    wide = length - gram + 1
    again = stored(_grams(df, text, length, gram).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("k")), "anchors")
    hits = _runs(df, text, length, gram)
    hits = stored(hits.join(again, hits["g"] == again["k"]).drop("k"), "runs")
    place = F.struct(F.col("doc_id").alias("doc"), "text_hash", "first", "last", "anchor")
    classes = stored(hits.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("g").alias("g"), F.min(place).alias("at")), "spans")
    mixed = stored(classes.groupBy("g").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select(F.col("g").alias("k"), "classes"), "mixed")
    edge = stored(classes.join(mixed, classes["g"] == mixed["k"]).drop("k"), "edges")
    strings = stored(_strings(df, edge, text, length, gram), "strings")
    parts = _by_collections(strings.where(F.col("classes") <= hot), wide).union(_by_counts(strings.where(F.col("classes") > hot), wide))
    parts = stored(parts, "parts").withColumnsRenamed({"h1": "p1", "h2": "p2"})
    once = edge.where("n = 1").join(parts, (edge["h1"] == parts["p1"]) & (edge["h2"] == parts["p2"]))
    once = once.select(F.col("at.doc").alias("r_doc"), F.col("at.text_hash").alias("r_hash"), (F.col("at.first") + F.col("low")).alias("start"), (F.col("at.first") + F.col("high") + length).alias("stop"))
    whole = stored(classes.where("n > 1").select(F.col("h1").alias("p1"), F.col("h2").alias("p2")), "repeated")
    full = hits.join(whole, (hits["h1"] == whole["p1"]) & (hits["h2"] == whole["p2"]))
    full = full.select(F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_hash"), F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    return stored(_merged(full.union(once).groupBy("r_doc", "r_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))), "repeats")


def _merged(spans: DataFrame) -> DataFrame:
    """Maximal runs in place of overlapping or adjacent spans, in order."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            n, held = batch.num_rows, column.flatten()
            row = np.repeat(np.arange(n), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            start, stop = (held.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop"))
            order = np.lexsort((start, row))
            row, start, stop = row[order], start[order] + (row[order] << 32), stop[order] + (row[order] << 32)
            reach = np.maximum.accumulate(stop) if len(stop) else stop
            first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))) if len(start) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(start)) - 1
            low, high = ((x & 0xFFFFFFFF).astype(np.int32) for x in (start[first], reach[last]))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=n)))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(low), pa.array(high)], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("r_doc"), batch.column("r_hash"), runs], names=["r_doc", "r_hash", "spans"])

    return spans.mapInArrow(run, "r_doc long, r_hash long, spans array<struct<start:int,stop:int>>")


def remove_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Replaces `text` by kept (binary: the remaining bytes), n_bytes (before), and removed: maximal runs (start, stop) of removed bytes."""
    bounded_batches(df.sparkSession)
    new = ("n_bytes", "removed", "kept")
    other = {c: f"kept_{i}" for i, c in enumerate(df.columns) if c not in (*new, text, "doc_id")}
    inner = df.select("doc_id", F.col(text).alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in other.items()))
    out = _without_repeats(inner, length, gram, hot)
    return out.select(*(F.col(other.get(c, c)).alias(c) for c in df.columns if c not in (*new, text)), *new)


def _without_repeats(df: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    text, rest = "text", [c for c in df.columns if c != "text"]
    spans = repeated_spans(df.select("doc_id", text), text, length, gram, hot)
    joined = df.select(*rest, text, F.xxhash64(text).alias("text_hash"))
    joined = joined.join(dealt(spans), F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_hash") == F.col("r_hash")), "left").select(*rest, text, "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            sizes, removed, kept = [], [], []
            for t, spans in zip(part.column(text).to_pylist(), part.column("spans").to_pylist()):
                data = (t or "").encode()
                runs: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                sizes.append(len(data))
                removed.append([{"start": a, "stop": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=[*rest, "n_bytes", "removed", "kept"])

    schema = T.StructType(df.select(*rest).schema.fields).add("n_bytes", "long").add("removed", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))).add("kept", "binary")
    return joined.mapInArrow(run, schema)


#: Every window by its digest.
ORACLE_SQL = r"""
with t as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as body from documents),
h as (select rid, doc_id, octet_length(body) as n, hex(body) as x from t),
w as (select rid, x, unnest(range(0, n - 399)) as i from h where n >= 400),
k as (select rid, i, md5_number(substr(x, 2 * i + 1, 800)) as m from w),
twice as (select rid, i from k where m in (select m from k group by m having count(*) > 1)),
marked as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 400 then 0 else 1 end as new from twice),
numbered as (select rid, i, sum(new) over (partition by rid order by i) as run from marked),
runs as (select rid, run, min(i) as low, max(i) + 400 as high from numbered group by rid, run),
pieces as (
  select rid, lag(high, 1, 0) over (partition by rid order by low) as a, low as b from runs
  union all select r.rid, max(r.high), any_value(h.n) from runs r join h on r.rid = h.rid group by r.rid),
kept as (select p.rid, string_agg(substr(h.x, 2 * p.a + 1, 2 * (p.b - p.a)), '' order by p.a) as x from pieces p join h on p.rid = h.rid group by p.rid),
removed as (select rid, sum(high - low) as n_removed, count(*) as n_spans from runs group by rid)
select h.doc_id, cast(h.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.x, h.x))) as kept_sha256
from h left join removed on h.rid = removed.rid left join kept on h.rid = kept.rid
"""


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
