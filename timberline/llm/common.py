"""What the operators of this subpackage share: stored intermediate tables, Arrow text buffers and 64-bit hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and texts, that one step in numpy handles; a longer text makes a step of its own.
STEP_BYTES, STEP_ROWS = 1 << 19, 1024

_own_dir: dict[int, str] = {}


#: Bytes of an Arrow batch between Spark and Python; Spark's own bound is in rows, and texts differ in size.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session already does so more tightly. Batches then stay small however long the texts are. Every operator that hands texts to Python calls this first."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine (tests)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own_dir:
        _own_dir[key] = tempfile.mkdtemp(prefix="timberline-")
    return _own_dir[key]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/timberline-{spark.sparkContext.applicationId}"
    if own not in _marked:
        place, at = _file_system(spark, own)
        place.mkdirs(at)
        place.deleteOnExit(at)
        _marked.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_marked: set[str] = set()
#: Paths that `stored` wrote since the innermost `scratch` began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at its end, but for those handed to the function that it gives; these belong to the scratch around it, if there is one.

    What leaves it may read kept tables only."""
    outer, own = _written.get(), []
    kept: set[str] = set()
    token = _written.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own:
            if path not in kept:
                place, at = _file_system(spark, path)
                place.delete(at, True)
            elif outer is not None:
                outer.append(path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    Sums by a key are stored before they are joined by it, too: then both sides of the join are plain shuffles, of which Spark splits hot keys."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    if (written := _written.get()) is not None:
        written.append(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the shuffle files of plans that nobody holds any more go with them
    return kept


def dealt(table: DataFrame) -> DataFrame:
    """Marks the side of a join with texts that each task holds as a hash table: texts are shuffled by the key once and not sorted. The plan is the same at every size."""
    return table.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def beside(docs: DataFrame, needed: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies an operator to the needed columns while the others, whatever their names, pass through; returns the input's columns."""
    other = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = apply(docs.select(*(F.col(f"`{c}`").alias(other.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def steps(batches: Iterable[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text and at most STEP_ROWS rows. At the end of the task, memory that its arrays took goes back to the system."""
    try:
        yield from _steps(batches, text, most)
    finally:
        release()


def release() -> None:
    """Hands freed memory back, which allocators else keep for a worker's next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def _steps(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = total[at - 1] if at else 0
            end = min(at + STEP_ROWS, max(at + 1, int(np.searchsorted(total, before + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Polynomial hashes modulo 2**64 of any substrings of one buffer, from prefix sums.

    The sum of value[b] * base**i over a substring, brought to a common power by the inverse base."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.values = byte_values(seed)
        self.base = (self.BASE + 8 * seed) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 2 * len(self._powers))
            for name, b in (("_powers", self.base), ("_inverses", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(p))

    def terms(self, data: np.ndarray) -> np.ndarray:
        """A random value per symbol: from a table for bytes, else (code points) by mixing."""
        return self.values[data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64) + self.values[0])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """n + 1 prefix sums of the buffer."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.terms(data) * self._powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buffer[start:end], the lengths mixed in."""
        self._grow(len(prefix))
        raw = (prefix[end] - prefix[start]) * self._inverses[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def is_space(data: np.ndarray) -> np.ndarray:
    """Where the bytes are \\x20 or \\x09-\\x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of other bytes than white space; runs end where texts do."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~is_space(data)
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) by contraction: (id, component), component the smallest id reachable; ids without an edge to another are left out.

    Each round every id goes over to its least neighbour if that is smaller, and on to where that one goes; edges are then drawn between the new labels, and equal ones merge.
    So edges shrink from round to round. Minima combine before the shuffle, so an id with very many edges is one row per task. Each round's tables are stored in the shared folder."""
    edge = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or edge.limit(1).count():
        both = edge.union(edge.select("b", "a"))
        near = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("up")), "near")
        on = near.select(F.col("id").alias("at"), F.col("up").alias("on"))
        up = stored(near.join(on, near["up"] == on["at"], "left").select("id", F.coalesce("on", "up").alias("up")), "up")
        low, high = (up.select(F.col("id").alias(f"i{k}"), F.col("up").alias(f"u{k}")) for k in (0, 1))
        edge = edge.join(low, F.col("a") == F.col("i0")).join(high, F.col("b") == F.col("i1"))
        edge = stored(edge.select(F.least("u0", "u1").alias("a"), F.greatest("u0", "u1").alias("b")).where("a <> b").distinct(), "edges")
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            moved = up.select(F.col("id").alias("was"), F.col("up").alias("now"))
            labels = labels.join(moved, labels["component"] == moved["was"], "left").select("id", F.coalesce("now", "component").alias("component"))
    return labels
