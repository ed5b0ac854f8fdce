"""Near-duplicate vectors by collision-counting projections.

Counting collisions over whole sorted projections costs as much as all pairs: a close pair collides at most sqrt(2) / distance (4.5 at cosine 0.95) times as often as an unrelated one, so a handful of close collisions
brings a fixed share of n * n others. So each of the lists sorts a one-dimensional projection within cells of sign bits, as many bits as leave a cell about 32 vectors at any n.
A window around each vector's value in its cell gives the collisions of a list. Pairs are counted over all lists; `count` collisions pass, and the number of lists is the least for
which a pair exactly at the threshold is missed with a probability of at most 5e-4 (binomial in the lists). Passed pairs are verified in double precision.

Equal vectors are one class with a count. Dense groups would make pairs with the square of their size: cells far over the mean elect leaders, and vectors within half the threshold's angle of a leader
form its clump. Any two members are then within the threshold's angle, so their links are counted by the clump's size, and only pairs that leave a clump are listed.

Rows: vectors that are null, zero, or hold null or non-finite components have no links and are components of their own; vectors of different length don't compare; repeated rows
link with each other; a null id comes last in its component. An empty table gives no rows. Very long vectors cost in proportion. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import bounded_batches, components, mix64, partitions, read, scratch, stored

COSINE, COUNT, MISS = 0.95, 2, 5e-4
#: Half of the mean number of vectors that a cell should hold, and lists whose cells elect leaders.
CELL, LEADING = 16, 3


def plan_lists(n: int, cosine: float, count: int = COUNT, miss: float = MISS) -> tuple[int, int, float]:
    """Bits of a cell, number of lists and half width of a window, for n vectors."""
    bits = max(4, math.ceil(math.log2(max(2, n) / (2 * CELL))))
    width = 2 * math.sqrt(2 * (1 - cosine))
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(2 / math.sqrt(2))
    lists = count
    while sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(count)) > miss:
        lists += 1
    return bits, lists, width


def directions(size: int, bits: int, lists: int) -> np.ndarray:
    """lists x (bits + 1) x size random normal directions, the same on every machine."""
    return np.random.default_rng([size, bits]).normal(size=(lists, bits + 1, size))


def _unit_rows(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("unit", pa.binary())])
    salts = np.random.default_rng(5).integers(0, 1 << 63, 2, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                units, prints = [], []
                for v in part.column(vector):
                    x = None if not v.is_valid else v.values
                    if x is None or not len(x) or x.null_count:
                        x = None
                    else:
                        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                        scale = np.abs(x).max()
                        x = x / scale if np.isfinite(scale) and scale > 0 else None
                    if x is None or not np.isfinite(x).all():
                        units.append(None)
                        prints.append((0, 0))
                        continue
                    x = x / np.linalg.norm(x) + 0.0
                    units.append(x.tobytes())
                    bits, place = x.view(np.uint64), np.arange(len(x), dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        prints.append(tuple(int(mix64(bits + mix64(place + s)).sum(dtype=np.uint64).view(np.int64)) for s in salts))
                yield pa.RecordBatch.from_arrays([part.column(vec_id), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(units, pa.binary())], schema=schema)

    return df.select(F.col(vec_id).cast("long").alias(vec_id), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "vec_id long, f1 long, f2 long, unit binary")


def _lists(classes: DataFrame, bits: int, lists: int) -> DataFrame:
    """(list, cell, p, c, clump) for each class (c, unit, clump) and list."""
    schema = pa.schema([("list", pa.int32()), ("cell", pa.int64()), ("p", pa.float32()), ("c", pa.int64()), ("clump", pa.int64())])
    powers = 1 << np.arange(bits, dtype=np.int64)
    held: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                units = [u.as_buffer() for u in part.column("unit")]
                sizes = np.array([u.size // 8 for u in units])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    x = np.stack([np.frombuffer(units[i], np.float64) for i in own])
                    d = held.setdefault(int(size), directions(int(size), bits, lists)) if len(held) < 8 else directions(int(size), bits, lists)
                    y = np.einsum("lbs,ns->nlb", d, x, optimize=True)
                    cell = ((y[:, :, :bits] > 0) @ powers) + (int(size) << 40)
                    take = pa.array(np.repeat(own, lists))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(lists, dtype=np.int32), len(own))), pa.array(cell.reshape(-1)), pa.array(y[:, :, bits].astype(np.float32).reshape(-1)), part.column("c").take(take), part.column("clump").take(take)],
                        schema=schema,
                    )

    return classes.select("c", "unit", "clump").mapInArrow(run, "list int, cell long, p float, c long, clump long")


def _dots(pairs: DataFrame, least: float) -> DataFrame:
    """Keeps pairs whose units ua and ub have at least this dot product; drops the units."""
    rest = [c for c in pairs.columns if c not in ("ua", "ub")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = [a.as_buffer().size == b.as_buffer().size and float(np.frombuffer(a.as_buffer(), np.float64) @ np.frombuffer(b.as_buffer(), np.float64)) >= least for a, b in zip(part.column("ua"), part.column("ub"))]
                yield part.select(rest).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select(*rest).schema)


def _clumps(classes: DataFrame, bits: int, cosine: float, hot: int) -> DataFrame:
    """(m, clump): members of clumps and their leaders."""
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    own = stored(_lists(classes.withColumn("clump", F.lit(None).cast("long")), bits, LEADING).select("list", "cell", "c"), "leading")
    mark = [F.min(F.struct(F.xxhash64(F.lit(s), "c").alias("draw"), "c"))["c"] for s in range(4)]
    cells = own.groupBy("list", "cell").agg(F.count("*").alias("n"), F.array(*mark).alias("leads")).where(F.col("n") > hot).select(F.col("list").alias("l"), F.col("cell").alias("k"), F.explode(F.array_distinct("leads")).alias("lead"))
    cells = stored(cells, "hot-cells")
    near = stored(own.join(cells, (own["list"] == F.col("l")) & (own["cell"] == F.col("k"))).select("c", "lead").distinct(), "led")
    units = classes.select(F.col("c").alias("x"), F.col("unit").alias("u"))

    def within(pairs: DataFrame, name: str) -> DataFrame:
        leads = stored(pairs.select("lead").distinct().join(units, F.col("lead") == F.col("x")).select(F.col("lead").alias("y"), F.col("u").alias("ub")), "leaders")
        both = pairs.join(units, F.col("c") == F.col("x")).select("c", "lead", F.col("u").alias("ua")).join(leads, F.col("lead") == F.col("y")).drop("y")
        return stored(_dots(both, half), name)

    member = within(near, "near-leaders").groupBy("c").agg(F.min("lead").alias("lead"))
    for _ in range(2):  # a leader may have a leader: go over to it where it is close enough
        member = stored(member, "members")
        up = member.select(F.col("c").alias("z"), F.col("lead").alias("up")).where("z <> up")
        moved = within(member.join(up, F.col("lead") == F.col("z")).select("c", F.col("up").alias("lead")), "moved").select(F.col("c").alias("z"), F.col("lead").alias("up"))
        member = member.join(moved, F.col("c") == F.col("z"), "left").select("c", F.coalesce("up", "lead").alias("lead"))
    return stored(member.select(F.col("c").alias("m"), F.col("lead").alias("clump")), "clumps")


def _collisions(lists: DataFrame, width: float) -> DataFrame:
    """(a, b) for each list in which two classes of one cell are within the window and not of one clump."""

    def pairs(p: np.ndarray, c: np.ndarray, clump: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        loose = np.flatnonzero(clump < 0)
        groups = [np.flatnonzero(clump == k) for k in np.unique(clump[clump >= 0])]
        for place, rows in enumerate([loose, *groups]):
            # the loose ones among themselves, and each group with what is loose or comes in later groups
            other = rows if place == 0 else np.sort(np.concatenate([loose, *groups[place:]]))
            if place == 0:
                low, high = np.arange(len(rows)) + 1, np.searchsorted(p[other], p[rows] + width, side="right")
            else:
                low, high = np.searchsorted(p[other], p[rows] - width, side="left"), np.searchsorted(p[other], p[rows] + width, side="right")
            for at in range(0, len(rows), 1024):
                n = np.maximum(high[at : at + 1024] - low[at : at + 1024], 0)
                i = np.repeat(rows[at : at + 1024], n)
                j = other[np.repeat(low[at : at + 1024] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                yield np.minimum(c[i], c[j]), np.maximum(c[i], c[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, size = None, [], [], 0

        def cells(rows: list[tuple[np.ndarray, ...]]):
            p, c, clump = (np.concatenate(x) for x in zip(*rows))
            return pairs(p, c, clump)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            names = ("list", "cell", "p", "c", "clump")
            lst, cell, p, c, clump = (batch.column(x).to_numpy(zero_copy_only=False) for x in names)
            cut = np.flatnonzero((lst[1:] != lst[:-1]) | (cell[1:] != cell[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(lst)]):
                if held and key != (lst[a], cell[a]):
                    for x in cells(held):
                        out.append(x)
                        size += len(x[0])
                        if size > 200_000:
                            yield flush()
                            out, size = [], 0
                    held = []
                key = (lst[a], cell[a])
                held.append((p[a:b], c[a:b], clump[a:b]))
        if held:
            out += list(cells(held))
        if out:
            yield flush()

    sorted_ = lists.withColumn("clump", F.coalesce("clump", F.lit(-1).cast("long"))).repartition(4 * partitions(lists.sparkSession), "list", "cell").sortWithinPartitions("list", "cell", "p")
    return sorted_.mapInArrow(run, "a long, b long")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, hot: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    bounded_batches(df.sparkSession)
    with scratch(df.sparkSession) as keep:
        rows, info = map(keep, _linked(df, vec_id, vector, cosine, hot))
    out = rows.join(info, (rows["f1"] == F.col("i1")) & (rows["f2"] == F.col("i2")) & rows["unit"].isNotNull(), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked(df: DataFrame, vec_id: str, vector: str, cosine: float, hot: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, f1, f2, unit), and links and component of each class (i1, i2); both stored."""
    rows = stored(_unit_rows(df, vec_id, vector), "units")
    at = F.struct(F.col("vec_id").isNull().alias("last"), F.col("vec_id").alias("id"))
    classes = rows.where("unit is not null").groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min(at).alias("at"), F.first("unit").alias("unit")).withColumn("c", F.monotonically_increasing_id())
    classes = stored(classes, "vector-classes")
    many = classes.count()
    bits, lists, width = plan_lists(many, cosine)
    clumps = _clumps(classes, bits, cosine, hot or max(64, 4 * 2 * CELL))
    listed = _lists(classes.join(clumps, F.col("c") == F.col("m"), "left"), bits, lists)
    pairs = _collisions(listed, width).groupBy("a", "b").agg(F.count("*").alias("hits")).where(F.col("hits") >= COUNT).select("a", "b")
    left, right = (classes.select(F.col("c").alias(f"c{s}"), F.col("unit").alias(f"u{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    links = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb")).select("a", "b", "na", "nb", "ua", "ub")
    links = stored(_dots(links, cosine), "vector-links")
    outside = links.select(F.col("a").alias("k"), F.col("nb").alias("w")).union(links.select("b", "na")).groupBy("k").agg(F.sum("w").alias("outside"))
    weighed = clumps.join(classes.select("c", "n"), F.col("m") == F.col("c"))
    sizes = weighed.groupBy(F.col("clump").alias("q")).agg(F.sum("n").alias("inside"))
    inside = stored(clumps.join(stored(sizes, "clump-sizes"), F.col("clump") == F.col("q")).select("m", "clump", "inside"), "inside")
    found = components(links.select("a", "b").union(clumps.select("m", "clump")))
    info = classes.join(inside, F.col("c") == F.col("m"), "left").join(outside, F.col("c") == F.col("k"), "left").join(found, F.col("c") == F.col("id"), "left")
    info = stored(info.select("f1", "f2", classes["at"], (F.coalesce("inside", "n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("group")), "vector-info")
    least = stored(info.groupBy(F.col("group").alias("g")).agg(F.min("at").alias("least")), "least")
    info = stored(info.join(least, info["group"] == least["g"]).select(F.col("f1").alias("i1"), F.col("f2").alias("i2"), "n_links", F.col("least.id").alias("component")), "vector-components")
    return rows, info


#: All pairs by brute force.
ORACLE_SQL = r"""
with recursive v as (
  select row_number() over () as rid, vec_id, cast(embedding as double[]) as x from embeddings),
ok as (
  select * from v where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and list_max(list_transform(x, lambda c: abs(c))) > 0),
edge as (select a.rid as a, b.rid as b from ok a join ok b on a.rid <> b.rid and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.95e0),
reach as (select rid as id, rid as other from v union select r.id, e.b from reach r join edge e on r.other = e.a),
least as (select r.id, min(v.vec_id) as component_id from reach r join v on r.other = v.rid group by r.id),
links as (select a, count(*) as n from edge group by a)
select v.vec_id, cast(coalesce(links.n, 0) as bigint) as n_links, least.component_id, v.vec_id is not distinct from least.component_id as kept
from v join least on v.rid = least.id left join links on v.rid = links.a
"""


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
