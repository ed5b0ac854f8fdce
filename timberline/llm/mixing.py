"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target over its size gives copies per document: the whole part is certain for each document, the rest is drawn. A document's rank is its
random odds u / (1 - u) over its inclusion odds p / (1 - p); the drawn ones are those of least rank, up to the words that are left of the target.
Inclusion probabilities differ by source, and between a source's few large documents (over 1/64 of it, so fewer than 64) and the others:
the large ones are drawn first and the others' probability makes up for what the large ones took too much or too little.

Rows: a null text has size 0; a null source is a source of its own, the last; a null doc_id draws as an empty one. Rows that repeat a
doc_id within a source draw alike, so they are taken together. Empty tables give empty results. Very long texts count whole.
Result columns replace those of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import beside, read, scratch, stored

#: Classes of rank in which words are summed before the class that holds the cut is sorted.
CLASSES = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id") -> Column:
    """A uniform number in (0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":mix")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where p is not inside (0, 1)."""
    return F.when((p > 0) & (p < 1), (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def rank_class(x: Column) -> Column:
    return F.floor(x / (1 + x) * CLASSES)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) with target: weights repeat over sources by code point, null last; shares of all sizes, none over `most` times the source's own.

    Filling to the caps has a closed form: in the order of cap over weight, the level at a source is what earlier caps leave over the weights
    from it on; sources under the final level are capped. One row per source, so the unpartitioned windows hold as many rows as there are sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "place")
    s = s.withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap")).withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("caps_before")) / F.col("weight_from"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """From stored rows (doc_id, source, size): per source its size, target, whole copies, and the probability and cut rank of large and of other documents."""
    with scratch(sized.sparkSession) as keep:
        return keep(_mix_plan(sized, weights, most))


def _mix_plan(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = stored(t.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets").withColumnRenamed("source", "s")
    rows = sized.withColumn("u", uniform()).join(t, F.col("source").eqNullSafe(F.col("s")))
    large = F.col("size") * 64 > F.col("source_size")

    # Large documents: fewer than 64 of a source, repeated ids as one.
    big = rows.where(large).withColumn("rank", rank(F.col("u"), F.col("left") / F.col("source_size")))
    big = big.groupBy("s", "source_size", "left", "rank").agg(F.sum("size").alias("size"))
    run, whole = W.partitionBy("s").orderBy("rank"), W.partitionBy("s")
    big = big.withColumn("before", F.sum("size").over(run) - F.col("size")).withColumn("all", F.sum("size").over(whole))
    taken = F.col("rank").isNotNull() & (2 * F.col("before") + F.col("size") <= 2 * (F.col("left") * F.col("all") / F.col("source_size")))
    big = big.groupBy(F.col("s").alias("k")).agg(F.max("all").alias("big_size"), F.sum(F.when(taken, F.col("size"))).alias("big_taken"), F.max(F.when(taken, F.col("rank"))).alias("big_cut"))
    t = stored(t.join(big, t["s"].eqNullSafe(big["k"]), "left").drop("k").fillna(0, ["big_size", "big_taken"]), "plan")
    t = t.withColumn("big_p", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(F.lit(0.0)))
    small = F.col("source_size") - F.col("big_size")
    t = t.withColumn("small_left", F.greatest(F.lit(0.0), F.least(F.col("left") - F.col("big_taken"), small.cast("double"))))
    t = t.withColumn("small_p", F.when(small > 0, F.col("small_left") / small).otherwise(F.lit(0.0)))

    # Others: sum words by class of rank, then sort only the class that holds the cut.
    r = sized.withColumn("u", uniform()).join(t.select("s", "source_size", "small_p", "small_left"), F.col("source").eqNullSafe(F.col("s"))).where(~large)
    r = r.withColumn("rank", rank(F.col("u"), F.col("small_p"))).where("rank is not null").withColumn("class", rank_class(F.col("rank")))
    classes = r.groupBy("s", "small_left", "class").agg(F.sum("size").alias("size"))
    classes = classes.withColumn("before", F.sum("size").over(W.partitionBy("s").orderBy("class")) - F.col("size"))
    edge = classes.where("before <= small_left and before + size >= small_left").groupBy("s").agg(F.max(F.struct("class", "before")).alias("e"))
    edge = stored(edge.select(F.col("s").alias("s1"), F.col("e.class").alias("edge"), F.col("e.before").alias("edge_before")), "edges")
    last = r.join(edge, (F.col("s").eqNullSafe(F.col("s1"))) & (F.col("class") == F.col("edge")))
    last = last.groupBy("s", "small_left", "edge_before", "rank").agg(F.sum("size").alias("size"))
    last = last.withColumn("before", F.sum("size").over(run) - F.col("size") + F.col("edge_before"))
    cut = last.where("2 * before + size <= 2 * small_left").groupBy(F.col("s").alias("s2")).agg(F.max("rank").alias("small_cut"))
    t = t.join(edge, t["s"].eqNullSafe(edge["s1"]), "left").join(cut, t["s"].eqNullSafe(cut["s2"]), "left")
    return stored(t.select("s", "source_size", "target", "whole", "big_p", "big_cut", "small_p", F.col("edge").alias("small_edge"), "small_cut"), "plan")


def mix(df: DataFrame, plan: DataFrame, size: Column | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies times size). The plan has one row per source; Spark broadcasts it where its stored size allows."""
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in df.columns if c not in new]
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    at = lambda c: F.col(mark + c)
    r = df.withColumn("size", word_count() if size is None else size).select(*kept, "size").withColumn(f"{mark}u", uniform())
    r = r.join(plan.withColumnsRenamed({c: mark + c for c in plan.columns}), F.col("source").eqNullSafe(at("s")))
    large = F.col("size") * 64 > at("source_size")
    in_big = rank(at("u"), at("big_p")) <= at("big_cut")
    x = rank(at("u"), at("small_p"))
    c = rank_class(x)
    in_small = (c < at("small_edge")) | ((c == at("small_edge")) & F.coalesce(x <= at("small_cut"), F.lit(False))) | (at("small_p") >= 1)
    drawn = F.coalesce(F.when(large, in_big).otherwise(in_small), F.lit(False))
    copies = (at("whole") + F.when(drawn, 1).otherwise(0)).cast("long")
    return r.select(*kept, "size", at("source_size").alias("source_size"), at("target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':mix'), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as u
  from documents),
by_source as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from sized group by source),
weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][(place - 1) % 3 + 1] as weight, 3.0::double * source_size as cap from by_source),
levels as (
  select *, ((sum(source_size) over ())::double - (sum(cap) over r - cap)) / (sum(weight) over () - sum(weight) over r + weight) as level
  from weighed window r as (order by cap / weight, place)),
goals as (
  select source, source_size, least(cap, coalesce(max(case when level * weight <= cap then level end) over () * weight, cap)) as target from levels),
parts as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goals),
rest as (select *, target - whole * source_size as left_over from parts),
rows_ as (
  select d.doc_id, d.source, d.size, d.u, r.source_size, r.target, r.whole, r.left_over, d.size * 64 > r.source_size as is_big
  from sized d join rest r on d.source is not distinct from r.source),
big_rank as (
  select source, doc_id, size, (u / (1 - u)) / ((left_over / source_size) / (1 - left_over / source_size)) as k, left_over * (sum(size) over (partition by source))::double / source_size as goal
  from rows_ where is_big),
big as (
  select source, doc_id, size, case when left_over_ok and 2 * before + size <= 2 * goal then 1 else 0 end as drawn
  from (select *, goal > 0 as left_over_ok, (sum(size) over (partition by source order by k))::double - size as before from big_rank)),
small_goal as (
  select r.source, greatest(0.0::double, least(r.left_over - coalesce(b.took, 0), (r.source_size - coalesce(b.has, 0))::double)) as goal, r.source_size - coalesce(b.has, 0) as has
  from rest r left join (select source, sum(size)::double as has, sum(size * drawn)::double as took from big group by source) b on r.source is not distinct from b.source),
small_rank as (
  select r.source, r.doc_id, r.size, g.goal, g.has, (r.u / (1 - r.u)) / ((g.goal / g.has) / (1 - g.goal / g.has)) as k
  from rows_ r join small_goal g on r.source is not distinct from g.source where not r.is_big and g.has > 0),
small as (
  select source, doc_id, size, case when goal > 0 and (goal >= has or 2 * before + size <= 2 * goal) then 1 else 0 end as drawn
  from (select *, (sum(size) over (partition by source order by k))::double - size as before from small_rank)),
drawn as (select source, doc_id, size, drawn from big union all select source, doc_id, size, drawn from small)
select r.doc_id, r.size, r.source_size, round(r.target, 4) as target, cast((r.whole + coalesce(d.drawn, 0)) * r.size as bigint) as taken
from rows_ r left join drawn d on r.doc_id = d.doc_id and r.source is not distinct from d.source and r.size = d.size
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    return mix(sized, mix_plan(sized), F.col("size")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    plan = mix_plan(sized)
    return beside(docs, ("doc_id", "text", "source"), lambda d: mix(d, plan).where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
