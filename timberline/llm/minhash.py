"""Near-duplicate documents by BagMinHash over word shingles.

A text is a multiset of five-word shingles (all its words, if fewer). A signature register holds the least point of Poisson processes that the shingles contribute: the weight axis is
discretised to copies and cut into dyadic intervals (0, 1], (1, 2], (2, 4], ...; each interval of a shingle has a process whose rate is its length, and a point descends by binary splits
to one copy, and counts if the text has that many. Points go to registers at random. Texts share the points of copies that both have, so a register agrees with
a probability of the weighted Jaccard similarity. Points are generated in ascending order, only up to a bound at which all registers are very likely filled, and further for texts where they are not.

Signatures are banded (20 bands of 5 registers find a pair at similarity 0.8 with probability 0.9997). Equal multisets are one class. Within a bucket, classes are compared with a leader; after components
are merged, another leader drawn anew meets classes of other components. What then still holds several components is compared whole, so that no link between components is lost: buckets of up to
SMALL classes by their pairs in different components, larger ones in blocks: a bucket is dealt in blocks of bounded size, and each pair of its blocks is one product of
incidence matrices, from which only components leave. Every link is verified by multiset overlap.

Rows: a text without words (or null) is a group of its own; very long texts count whole; a null doc_id comes last in its group; rows that repeat doc_id and text share
their class. An empty table gives no rows. Columns besides doc_id and the text are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import Rolling, beside, bounded_batches, components, dealt, mix64, partitions, read, scratch, steps, stored, text_buffer, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Classes of a bucket whose pairs are listed, and shingles of a block.
SMALL, BLOCK = 24, 1 << 20
ROLL = Rolling(41)
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingles(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle, sorted by both."""
    data, at = text_buffer(column)
    start, end, row = words(data, at)
    n = len(row)
    if not n:
        return row, np.zeros(0, np.uint64)
    word = ROLL.of(ROLL.prefix(data), start, end)
    h = mix64(word)
    with np.errstate(over="ignore"):
        for k in range(1, size):
            m = max(0, n - k)  # words that have a k-th one after them in this step
            follows = np.zeros(n, bool)
            follows[:m] = row[k:] == row[:m]
            after = np.full(n, B)
            after[:m] = word[k:]
            h = mix64(h * A + np.where(follows, after, C))
    whole = np.zeros(n, bool)
    m = max(0, n - size + 1)
    whole[:m] = row[size - 1 :] == row[:m]
    first = np.concatenate(([True], row[1:] != row[:-1]))
    keep = whole | (first & (np.bincount(row)[row] < size))
    row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    return row[order], h[order]


def occurrences(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal shingles of a row, and each shingle's number among its equals."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))))
    return first, np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def element_keys(h: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A key for each copy of each shingle, so that multisets overlap as sets of keys."""
    return mix64(h + occurrence.astype(np.uint64) * D)


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m least points of weighted elements (row, hash, weight of at least 1), infinite for rows without any."""
    out = np.full((n, m), np.inf)
    total = np.bincount(row, weights=weight, minlength=n)
    bound = m * (np.log(m) + 4) / np.maximum(total, 1)
    # the dyadic intervals that each element's weight enters
    rows, seeds, weights, low = [row], [mix64(h)], [weight], [np.zeros(len(row), np.int64)]
    reach = 1
    while (deep := np.flatnonzero(weight > reach)).size:
        rows.append(row[deep])
        with np.errstate(over="ignore"):
            seeds.append(mix64(h[deep] + np.uint64(reach) * A))
        weights.append(weight[deep])
        low.append(np.full(len(deep), reach))
        reach *= 2
    rows, seeds, weights, low = map(np.concatenate, (rows, seeds, weights, low))
    todo = np.ones(n, bool)
    while True:
        own = np.flatnonzero(todo[rows])
        x, k = np.zeros(len(own)), 0
        while len(own):
            wide = max(1, min(64, 200_000 // len(own)))
            with np.errstate(over="ignore"):
                draw = mix64(seeds[own, None] + np.arange(k + 1, k + wide + 1, dtype=np.uint64) * B)
            rate = np.maximum(low[own], 1)[:, None]
            gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
            # summed strictly in sequence, as band keys hash every bit: a point is the same whatever the width
            points = np.cumsum(np.concatenate((x[:, None], gaps), axis=1), axis=1)[:, 1:]
            hit = points < bound[rows[own], None]
            i, j = np.nonzero(hit)
            other = mix64(draw[i, j] ^ C)
            # binary splits: the leading bits choose halves down to one copy of the interval
            cell = (((other >> np.uint64(32)) * rate[i, 0].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            at = own[i]
            real = (low[at] == 0) | (low[at] + cell < weights[at])
            np.minimum.at(out.reshape(-1), rows[at[real]] * m + (other[real] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, points[i, j][real])
            on = hit[:, -1]
            own, x, k = own[on], points[on, -1], k + wide
        todo = (total > 0) & np.isinf(out).any(axis=1)
        if not todo.any():
            return out
        bound = np.where(todo, 2 * bound, bound)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(bits.shape[2]):
            key = mix64(key * A + bits[:, :, k])
    return key


def fingerprints(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """128 bits for each row's set of keys: sums of two mixed copies."""
    out = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((A, B)):
            np.add.at(out[:, i], row, mix64(keys ^ salt))
    return out


def _features(df: DataFrame, text: str, size: int, bands: int, rows: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            n = part.num_rows
            row, h = shingles(part.column(text), size)
            first, number = occurrences(row, h)
            prints = fingerprints(row, element_keys(h, number), n)
            weight = np.diff(np.append(first, len(row)))
            keys = band_keys(signatures(row[first], h[first], weight, n, bands * rows), bands)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in (0, 1)), pa.array(np.bincount(row, minlength=n).astype(np.int64)), listed], schema=schema)

    source = df.select("doc_id", F.xxhash64(text).alias("text_hash"), text)
    return source.mapInArrow(run, "doc_id long, text_hash long, f1 long, f2 long, size long, keys array<long>")


def _multisets(df: DataFrame, wanted: DataFrame, text: str, size: int) -> DataFrame:
    """(c, elements) of the wanted classes (c, doc, text_hash), from a document of each."""
    w = wanted.withColumnsRenamed({"doc": "w_doc", "text_hash": "w_hash"})
    source = df.select("doc_id", F.xxhash64(text).alias("text_hash"), text)
    joined = source.join(dealt(w), F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_hash") == F.col("w_hash"))).select("c", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            row, h = shingles(part.column(text), size)
            keys = element_keys(h, occurrences(row, h)[1])
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["c", "elements"])

    return joined.mapInArrow(run, "c long, elements array<long>").dropDuplicates(["c"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of stored pairs (a, b) of classes those whose multisets overlap enough."""
    left, right = sets.select(F.col("c").alias("ca"), F.col("elements").alias("ea")), sets.select(F.col("c").alias("cb"), F.col("elements").alias("eb"))
    both = pairs.join(left, pairs["a"] == left["ca"]).join(right, F.col("b") == F.col("cb"))
    common = F.size(F.array_intersect("ea", "eb"))
    return stored(both.withColumn("common", common).where(F.col("common") >= similarity * (F.size("ea") + F.size("eb") - F.col("common"))).select("a", "b"), "links")


def overlaps_at_least(elements: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets of keys have this Jaccard similarity, from products of incidence matrices over the keys that two or more hold."""
    sizes = np.array([len(e) for e in elements])
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, key, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    keep = count[key] > 1
    owner, key = owner[keep], key[keep]
    order = np.argsort(key, kind="stable")
    owner, key = owner[order], key[order]
    place = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
        a, b = np.searchsorted(place, [low, low + 2048])
        x = np.zeros((n, 2048), np.float32)
        x[owner[a:b], place[a:b] - low] = 1
        common += x @ x.T
    return common >= similarity * (sizes[:, None] + sizes[None, :] - common)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """The least place in each place's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _dense_links(member: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect what is connected within large buckets (key, c), each compared whole: its classes are dealt to blocks of bounded size, and each pair of blocks to a task."""
    sized = member.join(classes.select(F.col("c").alias("d"), "size"), F.col("c") == F.col("d")).drop("d")
    blocks = sized.groupBy(F.col("key").alias("g")).agg(F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.count("*") / 1024)).cast("int").alias("blocks"))
    own = stored(sized.join(blocks, F.col("key") == F.col("g")).drop("g"), "dense")
    sets = sets.withColumnRenamed("c", "s")
    block = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    cell = own.select("c", "key", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cell = cell.select("c", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(sets, F.col("c") == F.col("s")).drop("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list) -> pa.RecordBatch:
            ids = np.array([h[0] for h in held])
            label = least_labels(overlaps_at_least([h[1] for h in held], similarity))
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                here = tuple(batch.column(c)[at].as_py() for c in ("key", "i", "j"))
                if held and here != key:
                    yield solve(held)
                    held = []
                key = here
                held.append((batch.column("c")[at].as_py(), batch.column("elements")[at].values.to_numpy(zero_copy_only=False).copy()))
        if held:
            yield solve(held)

    return stored(cell.repartition(partitions(member.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct(), "dense-links")


def near_duplicates(df: DataFrame, text: str = "text", size: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, class_id, kept), a row per document: class_id is the least doc_id of its group, kept the one document (and rows that repeat it) that stays."""
    bounded_batches(df.sparkSession)
    with scratch(df.sparkSession) as keep:
        return _near_duplicates(df, text, size, similarity, bands, rows, keep)


def _near_duplicates(df: DataFrame, text: str, size: int, similarity: float, bands: int, rows: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    features = stored(_features(df, text, size, bands, rows), "features")
    at = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), "text_hash")
    classes = features.where("size > 0").groupBy("f1", "f2").agg(F.min(at).alias("at"), F.min("size").alias("size"), F.min("keys").alias("keys"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    bucket = classes.select("c", "size", F.explode("keys").alias("key"))
    shared = stored(bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")), "shared")
    bucket = stored(bucket.join(shared, bucket["key"] == shared["k"]).drop("k"), "buckets")
    close = F.least("size", "l_size") >= similarity * F.greatest("size", "l_size")
    every = stored(bucket.select(F.col("c").alias("x")).distinct(), "bucketed")
    wanted = classes.join(every, classes["c"] == every["x"]).select("c", F.col("at.doc").alias("doc"), F.col("at.text_hash").alias("text_hash"))
    sets = stored(_multisets(df, wanted, text, size), "multisets")
    seen, label = None, every.select(F.col("x").alias("c"), F.col("x").alias("group"))

    def merged(new: DataFrame) -> DataFrame:
        """Labels after new links, which are drawn between the components so far."""
        low, high = (label.select(F.col("c").alias(f"c{k}"), F.col("group").alias(f"g{k}")) for k in (0, 1))
        found = components(new.join(low, F.col("a") == F.col("c0")).join(high, F.col("b") == F.col("c1")).select(F.col("g0").alias("a"), F.col("g1").alias("b")))
        return stored(label.join(found, F.col("group") == F.col("id"), "left").select("c", F.coalesce("component", "group").alias("group")), "labels")

    for turn in range(3):
        member = bucket.join(label.withColumnRenamed("c", "l"), bucket["c"] == F.col("l")).drop("l")
        if turn:  # only buckets that still hold several components
            open_ = stored(member.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where("low <> high").select(F.col("key").alias("k"), (F.col("n") <= SMALL).alias("small")), "open-keys")
            member = stored(member.join(open_, member["key"] == open_["k"]).drop("k"), "open")
        if turn < 2:
            lead = F.min(F.struct(F.xxhash64(F.lit(turn), "c").alias("draw"), F.col("c").alias("lead"), F.col("size").alias("l_size"), F.col("group").alias("l_group")))
            lead = stored(member.groupBy(F.col("key").alias("k")).agg(lead.alias("l")).select("k", "l.*"), "leaders")
        else:
            if member.where("not small").limit(1).count():
                label = merged(_dense_links(member.where("not small").select("key", "c"), classes, sets, similarity))
            member = member.where("small")
            lead = member.select(F.col("key").alias("k"), F.col("c").alias("lead"), F.col("size").alias("l_size"), F.col("group").alias("l_group"))
        pair = member.join(lead, member["key"] == F.col("k")).where((F.col("group") != F.col("l_group")) & close)
        pair = pair.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()
        if seen is not None:
            pair = pair.join(seen, ["a", "b"], "left_anti")
        pair = stored(pair, "pairs")
        if not pair.limit(1).count():
            continue
        seen = pair if seen is None else seen.union(pair)
        label = merged(_verified(pair, sets, similarity))
    grouped = classes.join(label.withColumnRenamed("c", "l"), classes["c"] == F.col("l"), "left").select("f1", "f2", "at", F.coalesce("group", "c").alias("group"))
    grouped = stored(grouped, "grouped")
    least = stored(grouped.groupBy(F.col("group").alias("g")).agg(F.min("at").alias("least")), "least")
    grouped = stored(grouped.join(least, grouped["group"] == least["g"]).select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "least"), "classes-of")
    features, grouped = keep(features), keep(grouped)
    out = features.join(grouped, (features["f1"] == F.col("c1")) & (features["f2"] == F.col("c2")) & (features["size"] > 0), "left")
    return out.select("doc_id", "text_hash", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc")).alias("class_id"), (F.col("least").isNull() | (at == F.col("least"))).alias("kept"))


#: All pairs of shingle multisets by brute force.
ORACLE_SQL = r"""
with recursive t as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select rid, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as x from t where len(w) > 0),
e as (select rid, md5_number(x) as x, row_number() over (partition by rid, x) as copy from s),
n as (select rid, count(*) as n from e group by rid),
c as (select a.rid as a, b.rid as b, count(*) as common from e a join e b on a.x = b.x and a.copy = b.copy and a.rid < b.rid group by a.rid, b.rid),
link as (select c.a, c.b from c join n na on c.a = na.rid join n nb on c.b = nb.rid where common >= 0.8e0 * (na.n + nb.n - common)),
edge as (select a, b from link union all select b, a from link),
reach as (select rid as id, rid as other from t union select r.id, e.b from reach r join edge e on r.other = e.a),
least as (select r.id, min(t.doc_id) as class_id from reach r join t on r.other = t.rid group by r.id)
select t.doc_id, l.class_id, t.doc_id is not distinct from l.class_id as kept from t join least l on t.rid = l.id
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def stage_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that repeat it, one."""
    with scratch(spark) as keep:
        found = near_duplicates(docs.select("doc_id", "text")).where("kept").groupBy(F.col("doc_id").alias("k_doc"), F.col("text_hash").alias("k_hash"))
        stay = keep(stored(found.agg(F.count("*").alias("again")), "stay"))

    def left(d: DataFrame) -> DataFrame:
        joined = d.join(dealt(stay), d["doc_id"].eqNullSafe(F.col("k_doc")) & (F.xxhash64("text") == F.col("k_hash")))
        once = joined.where("again = 1").select(d.columns)
        if not stay.where("again > 1").limit(1).count():
            return once
        return once.union(joined.where("again > 1").select(d.columns).dropDuplicates(["doc_id", "text"]))

    return beside(docs, ("doc_id", "text"), left)
