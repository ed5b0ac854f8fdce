"""Bin dictionaries and encoding.

Histogram dictionary of a feature with n rows and step s = max(1, floor(n / size)): distinct value v of dense rank k >= 1 with predecessor p and `less` rows below it proposes the float32 midpoint
of p and v for segment min(k, floor(less / s)) - 1; the least proposal of a segment is its threshold, and thresholds are used up to the first segment without one.
A value's bin is the number of thresholds under it, so bin b holds (T[b - 1], T[b]]."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.tables import partitions, settled


def long_values(df: DataFrame, features: Column | str = "features") -> DataFrame:
    """(fid, v): a row per value."""
    return df.select(F.posexplode(features).alias("fid", "v"))


def exact_dictionary(values: DataFrame) -> DataFrame:
    """(fid, bin, v): sorted distinct values with their dense ranks. Ranks are counted per range of values and carried across, so a feature's values need not meet in one task."""
    u = _ranged(values)
    return u.select("fid", "k", "v").withColumnsRenamed({"k": "bin"})


def exact_counts(values: DataFrame) -> DataFrame:
    """(fid, bin, n): rows of each of exact_dictionary's bins. They were counted with the distinct values, so the values themselves are not joined with their bins (Spark may send one side of a join to the driver)."""
    return _ranged(values).select("fid", F.col("k").alias("bin"), F.col("c").alias("n"))


def _ranged(values: DataFrame) -> DataFrame:
    """Distinct (fid, v, c) with dense rank k, rows below `less`, predecessor p and rows n of the feature.

    Values are dealt to ranges; each range's totals (a row per range and feature) are summed across ranges and joined back, so windows run inside ranges only. Of that join it is the totals that go through the driver, never the values, whose stored size says little of their number."""
    counts = values.groupBy("fid", "v").agg(F.count("*").alias("c"))
    counts = settled(counts.repartitionByRange(partitions(values.sparkSession), "fid", "v").withColumn("range", F.spark_partition_id()), "ranges")
    totals = counts.groupBy("fid", "range").agg(F.count("*").alias("d"), F.sum("c").alias("rows"), F.max("v").alias("top"))
    before = W.partitionBy("fid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("fid").alias("f"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
        F.max("top").over(before).alias("p0"),
        F.sum("rows").over(W.partitionBy("fid")).alias("n"),
    )
    inside = W.partitionBy("fid", "range").orderBy("v")
    u = counts.join(F.broadcast(offsets), (counts["fid"] == offsets["f"]) & (counts["range"] == offsets["r"]))
    return u.select(
        "fid",
        "v",
        "c",
        "n",
        (F.row_number().over(inside) - 1 + F.col("d0")).cast("long").alias("k"),
        (F.sum("c").over(inside) - F.col("c") + F.col("rows0")).alias("less"),
        F.coalesce(F.lag("v").over(inside), F.col("p0")).alias("p"),
    )


def hist_thresholds(values: DataFrame, size: int, compact_gaps: bool = False) -> DataFrame:
    """(fid, bin, threshold), at most size - 1 a feature. With compact_gaps, thresholds after an empty segment are used too."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    u = _ranged(values).where("k >= 1").withColumn("seg", (F.least(F.col("k"), F.floor(F.col("less") / step)) - 1).cast("int"))
    middle = ((F.col("v") + F.col("p")).cast("float") * F.lit(0.5)).cast("float")
    t = u.where((F.col("seg") >= 0) & (F.col("seg") < size - 1)).groupBy("fid", "seg").agg(F.min(middle).alias("threshold"))
    t = t.withColumn("bin", F.row_number().over(W.partitionBy("fid").orderBy("seg")) - 1)
    return (t if compact_gaps else t.where("bin = seg")).select("fid", "bin", "threshold")


def sketched_thresholds(df: DataFrame, width: int, size: int, accuracy: int, features: str = "features") -> list[np.ndarray]:
    """Thresholds near the size-quantiles of each feature, from one aggregate of mergeable sketches: nothing is exploded and only sketches are shuffled. Between two
    neighbouring distinct quantiles the threshold is the lower one, so a value equal to it stays in the lower bin."""
    probabilities = [i / size for i in range(1, size)]
    row = df.agg(*(F.percentile_approx(F.get(features, F.lit(f)), probabilities, accuracy).alias(f"q{f}") for f in range(width)), *(F.max(F.get(features, F.lit(f))).alias(f"top{f}") for f in range(width))).first()
    return [np.array(sorted({q for q in row[f"q{f}"] or () if q < row[f"top{f}"]}), np.float32) for f in range(width)]


def collect_thresholds(thresholds: DataFrame, width: int) -> list[np.ndarray]:
    """The dictionary in the driver: at most features times bins numbers, whatever the rows."""
    out: list[list[float]] = [[] for _ in range(width)]
    for r in thresholds.orderBy("fid", "bin").collect():
        out[r["fid"]].append(r["threshold"])
    return [np.array(t, np.float32) for t in out]


def flat_lists(column: pa.Array) -> tuple[np.ndarray, int]:
    """Values of a list column as rows x width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0), len(column)


def encode_bins(df: DataFrame, thresholds: list[np.ndarray], features: str = "features", bins: str = "bins") -> DataFrame:
    """Replaces features (array<float>) by bins (array<int>): a binary search per value, on Arrow batches; no shuffle."""
    rest = [c for c in df.columns if c not in (features, bins)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = flat_lists(batch.column(features))
            codes = np.empty(x.shape, np.int32)
            for f in range(x.shape[1]):
                codes[:, f] = np.searchsorted(thresholds[f], x[:, f], side="left")
                codes[np.isnan(x[:, f]), f] = len(thresholds[f])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), listed], names=[*rest, bins])

    from pyspark.sql import types as T

    return df.select(*rest, features).mapInArrow(run, T.StructType([*df.select(*rest).schema.fields, T.StructField(bins, T.ArrayType(T.IntegerType()))]))


def bit_width(c: Column) -> Column:
    """Bits that a count needs: 32 less its leading zeros."""
    return F.when(c > 0, F.length(F.bin(c))).otherwise(F.lit(0)).cast("int")
