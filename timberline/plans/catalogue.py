"""Named queries of the trees engine and the SQL they are checked against."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import Configuration
from timberline.errors import TreesError
from timberline.estimators import TreesClassifier, TreesRegressor
from timberline.functions import gain as engine
from timberline.functions.gain import Penalties
from timberline.functions.metrics import auc_table, mse, rmse
from timberline.functions.objective import gradients, logit, sigmoid, softmax, softmax_gradients
from timberline.operators.binning import bit_width, collect_thresholds, encode_bins, exact_counts, exact_dictionary, hist_thresholds, long_values
from timberline.operators.histogram import histogram, histogram_by_task, prefixed, root_sums, subtracted
from timberline.operators.routing import node_of, partition_index, split_bit
from timberline.operators.sampling import ColumnSampler
from timberline.operators.splits import best_category_splits, best_per_feature, best_splits, candidates, category_splits, with_gain
from timberline.plans import oracles as o
from timberline.plans.model import nodes_table
from timberline.plans.trainer import Model, load, train
from timberline.sources.matrix import FeatureMatrix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIZE = 32
PLAIN = Penalties()
LOGIT = Penalties(gate_hessian=True)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def matrix(spark: SparkSession, d: str, name: str) -> FeatureMatrix:
    source, features, y = o.BASES[name]
    if name == "V":
        return FeatureMatrix(table(spark, d, "embeddings"), "embedding", y=F.expr(y), width=64, check=False)
    if name == "D":
        docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("line_ends"))
        df = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    else:
        df = table(spark, d, source)
    target = {"labels": F.expr(y)} if name == "M" else {"y": F.expr(y)}
    return FeatureMatrix(df, features, categories=o.CATEGORIES.get(name, ()), check=False, **target)


def binned(spark: SparkSession, d: str, name: str, size: int = SIZE) -> tuple[DataFrame, list]:
    """Rows of bins and y, and the thresholds."""
    m = matrix(spark, d, name)
    design = m.design()
    t = collect_thresholds(hist_thresholds(long_values(design), size), m.width)
    return encode_bins(design.select("features", "y"), t), t


def with_gradients(df: DataFrame, objective: int = 0) -> DataFrame:
    g, h = gradients(objective, F.col("y"), F.lit(0.0 if objective else 0.5))
    return df.withColumns({"g": g, "h": h, "node": F.lit(0)})


def config(objective: int = 0, depth: int = 1, **tree) -> Configuration:
    return Configuration.parse({"method": 1, "objective": objective, "tree": {"max_depth": depth, "eta": 0.3, **tree}, "internals": {"hist_size": SIZE}})


# 2.1 source and 2.2 projections


@query("design_matrix", f"with {o.rows('L')}, {o.long('L')} select fid, count(*) as n, round(sum(cast(v as double)), 1) as total, min(v) as low, max(v) as high from long_ group by fid")
def design_matrix(spark, d):
    return long_values(matrix(spark, d, "L").design()).groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 1).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("exact_dict", f"with {o.rows('S')}, {o.long('S')} select fid, dense_rank() over (partition by fid order by v) - 1 as bin, v from (select distinct fid, v from long_)")
def exact_dict(spark, d):
    return exact_dictionary(long_values(matrix(spark, d, "S").design()))


@query("exact_bins", f"with {o.rows('S')}, {o.long('S')}, r as (select fid, dense_rank() over (partition by fid order by v) - 1 as bin from long_) select fid, bin, count(*) as n from r group by fid, bin")
def exact_bins(spark, d):
    return exact_counts(long_values(matrix(spark, d, "S").design()))


@query("hist_thresholds", o.start("L") + " select fid, bin, threshold from thr")
def thresholds(spark, d):
    return hist_thresholds(long_values(matrix(spark, d, "L").design()), SIZE)


@query("hist_bins", o.start("L") + " select fid, bin, count(*) as n from coded group by fid, bin")
def hist_bins(spark, d):
    return long_values(binned(spark, d, "L")[0], "bins").groupBy("fid", F.col("v").alias("bin")).agg(F.count("*").alias("n"))


@query("bin_bit_width", o.start("L") + " select fid, count(*) + 1 as bins, cast(floor(log2(count(*) + 1)) as int) + 1 as bits from thr group by fid")
def bin_bit_width(spark, d):
    t = hist_thresholds(long_values(matrix(spark, d, "L").design()), SIZE).groupBy("fid").agg((F.count("*") + 1).alias("bins"))
    return t.withColumn("bits", bit_width(F.col("bins")))


@query("category_width", "select max(l_linenumber) as top, cast(floor(log2(max(l_linenumber))) as int) + 1 as bits, count(distinct l_linenumber) as codes from lineitem")
def category_width(spark, d):
    m = FeatureMatrix(table(spark, d, "lineitem"), ["l_quantity"], categories=["l_linenumber"], check=False)
    codes = m.design().select(F.get("categories", F.lit(0)).alias("code"))
    return codes.agg(F.max("code").alias("top"), F.count_distinct("code").alias("codes")).withColumn("bits", bit_width(F.col("top")))


@query("grad_linear", f"select y, round(cast(y as double) - 0.5e0, 5) as g, 1e0 as h from ({o.base('L')}) b")
def grad_linear(spark, d):
    g, h = gradients(0, F.col("y"), F.lit(0.5))
    return matrix(spark, d, "L").design().select("y", F.round(g, 5).alias("g"), h.alias("h"))


@query(
    "grad_logistic",
    f"select y, f1, round(y - p, 6) as g, round(p * (1 - p), 6) as h from (select y, f1, 1e0 / (1e0 + exp(-(20 * cast(f1 as double) - 1))) as p from ({o.base('B')}) b) q",
)
def grad_logistic(spark, d):
    f1 = F.get("features", F.lit(1))
    g, h = gradients(1, F.col("y"), 20 * f1.cast("double") - 1)
    return matrix(spark, d, "B").design().select("y", f1.alias("f1"), F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


@query("link_logit", "select l_discount, round(ln((l_discount + 0.01e0) / (1 - (l_discount + 0.01e0))), 6) as m, round(1 / (1 + exp(-ln((l_discount + 0.01e0) / (1 - (l_discount + 0.01e0))))), 6) as p from lineitem")
def link_logit(spark, d):
    v = F.col("l_discount") + F.lit(0.01)
    return table(spark, d, "lineitem").select("l_discount", F.round(logit(v), 6).alias("m"), F.round(sigmoid(logit(v)), 6).alias("p"))


@query("link_sigmoid", "select l_tax, round(1 / (1 + exp(-(l_tax * 100 - 4))), 6) as p from lineitem")
def link_sigmoid(spark, d):
    return table(spark, d, "lineitem").select("l_tax", F.round(sigmoid(F.col("l_tax") * 100 - 4), 6).alias("p"))


# 2.4 aggregations and 2.5 prefixes

ROOT = o.start("L") + ", " + o.gradient(0, 0, "select rid, 0.5e0 as m from rows_") + ", node_0_0 as (select rid, 0 as node from rows_), " + o.level("0_0", "grad_0", "node_0_0", PLAIN)
ROOT_B = o.start("B") + ", " + o.gradient(0, 1, "select rid, 0e0 as m from rows_") + ", node_0_0 as (select rid, 0 as node from rows_), " + o.level("0_0", "grad_0", "node_0_0", LOGIT)
SUMS = "round(g, 3) as g, round(h, 3) as h, c"
PREFIXES = "round(gl, 3) as gl, round(hl, 3) as hl, cl"


def sums(*names: str) -> list:
    return [F.round(n, 3).alias(n) if n[0] in "gh" else F.col(n).cast("long").alias(n) for n in names]


@query("root_sums", ROOT + " select round(sum(g), 3) as g, round(sum(h), 3) as h, count(*) as c from grad_0")
def root_sums_query(spark, d):
    return root_sums(with_gradients(matrix(spark, d, "L").design())).select(*sums("g", "h", "c"))


@query("root_hist", ROOT + f" select fid, bin, {SUMS} from hist_0_0")
def root_hist(spark, d):
    return histogram(with_gradients(binned(spark, d, "L")[0])).select("fid", "bin", *sums("g", "h", "c"))


@query("root_hist_by_task", ROOT + f" select fid, bin, {SUMS} from hist_0_0")
def root_hist_by_task(spark, d):
    rows, t = binned(spark, d, "L")
    return histogram_by_task(with_gradients(rows), 0, [], [], [len(x) + 1 for x in t]).select("fid", "bin", *sums("g", "h", "c"))


@query("root_hist_logistic", ROOT_B + f" select fid, bin, {SUMS} from hist_0_0")
def root_hist_logistic(spark, d):
    return histogram(with_gradients(binned(spark, d, "B")[0], 1)).select("fid", "bin", *sums("g", "h", "c"))


@query("hist_prefix", ROOT + f" select fid, bin, {PREFIXES} from pref_0_0")
def hist_prefix(spark, d):
    return prefixed(histogram(with_gradients(binned(spark, d, "L")[0]))).select("fid", "bin", *sums("gl", "hl", "cl"))


# 2.2 scalars over a grid of parameters

GRID = {
    "plain": PLAIN,
    "l2": replace(PLAIN, lambda_=100.0),
    "l1": replace(PLAIN, alpha=2000.0),
    "clamped": replace(PLAIN, max_leaf_weight=5.0),
    "large_leaves": replace(PLAIN, min_leaf_size=20000, min_child_weight=25000.0),
    "gamma": replace(PLAIN, gamma_absolute=1e6, gamma_relative=0.01),
}


def over_grid(sql: Callable[[str, Penalties], str], source: str) -> str:
    return " union all ".join(f"select '{name}' as params, q.* from ({sql(source, p)}) q" for name, p in GRID.items())


def leaf_sql(weight: Callable, source: str, p: Penalties) -> str:
    return f"select fid, cut, round({weight('gl', 'hl', 'cl', p)}, 4) as w_left, round({weight('(g - gl)', '(h - hl)', '(c - cl)', p)}, 4) as w_right from {source}"


def score_sql(score: Callable, weight: Callable, source: str, p: Penalties) -> str:
    return f"select fid, cut, round({score('gl', 'hl', weight('gl', 'hl', 'cl', p), p)}, 1) as score from {source}"


def gain_sql(steps: Callable, source: str, p: Penalties) -> str:
    return f"select fid, cut, round(cast(gain as double), -1) as gain from ({steps(source, p, 'fid, cut')}) z"


# the engine's formulas, and those written apart in the oracles
for _name, _own, _other in (
    ("leaf_weight", partial(leaf_sql, engine.weight), partial(leaf_sql, o.weight)),
    ("node_score", partial(score_sql, engine.score, engine.weight), partial(score_sql, o.score, o.size)),
    ("split_gain", partial(gain_sql, engine.gain_steps), partial(gain_sql, o.gains)),
):

    def _run(spark, d, sql=_own):
        rows = candidates(histogram(with_gradients(binned(spark, d, "L")[0])))
        return spark.sql(over_grid(sql, "{rows}"), rows=rows)

    query(_name, ROOT + " " + over_grid(_other, "cand_0_0"))(_run)


# 2.4 arg-max


def gains(spark, d, name="L", p=PLAIN, objective=0):
    return with_gain(candidates(histogram(with_gradients(binned(spark, d, name)[0], objective))), p)


@query("best_bin_per_feature", ROOT + " select fid, cut, cl from (select *, row_number() over (partition by fid order by gain desc, cut desc) as place from gain_0_0) where place = 1")
def best_bin_per_feature(spark, d):
    return best_per_feature(gains(spark, d)).select("fid", "cut", F.col("cl").cast("long").alias("cl"))


BEST = "select b.node, b.fid, b.cut, t.threshold, round(b.gl, 2) as gl, b.cl, round(b.g, 2) as g, b.c"
BEST_SQL = BEST + " from best_0_0 b join thr t on t.fid = b.fid and t.bin = b.cut"


def best(spark, d, name="L", p=PLAIN, objective=0):
    rows, t = binned(spark, d, name)
    b = best_splits(with_gain(candidates(histogram(with_gradients(rows, objective))), p))
    return named(b, t)


def named(b: DataFrame, t: list) -> DataFrame:
    """Best splits with thresholds in place of cuts' numbers alone."""
    limits = b.sparkSession.createDataFrame([(f, i, float(x)) for f, own in enumerate(t) for i, x in enumerate(own)], "f int, i int, threshold float")
    b = b.join(F.broadcast(limits), (F.col("fid") == F.col("f")) & (F.col("cut") == F.col("i")))
    return b.select("node", "fid", "cut", "threshold", F.round("gl", 2).alias("gl"), F.col("cl").cast("long").alias("cl"), F.round("g", 2).alias("g"), F.col("c").cast("long").alias("c"))


@query("best_split_root", ROOT + " " + BEST_SQL)
def best_split_root(spark, d):
    return best(spark, d)


@query("best_split_logistic", ROOT_B + " " + BEST_SQL)
def best_split_logistic(spark, d):
    return best(spark, d, "B", LOGIT, 1)


GATES = {
    "gamma_gated_split": replace(PLAIN, gamma_absolute=3.9e7),
    "l1_l2_split": replace(PLAIN, lambda_=5000.0, alpha=3000.0),
    "clamped_leaf": replace(PLAIN, max_leaf_weight=30.0),
    "min_leaf_gate": replace(PLAIN, min_leaf_size=200),
}


def root_with(p: Penalties) -> str:
    return o.start("L") + ", " + o.gradient(0, 0, "select rid, 0.5e0 as m from rows_") + ", node_0_0 as (select rid, 0 as node from rows_), " + o.level("0_0", "grad_0", "node_0_0", p)


for _name, _p in GATES.items():
    query(_name, root_with(_p) + " " + BEST_SQL)(lambda spark, d, p=_p: best(spark, d, p=p))

HEAVY = replace(LOGIT, min_child_weight=60.0)


@query("min_child_gate", o.start("B") + ", " + o.gradient(0, 1, "select rid, 0e0 as m from rows_") + ", node_0_0 as (select rid, 0 as node from rows_), " + o.level("0_0", "grad_0", "node_0_0", HEAVY) + " " + BEST_SQL)
def min_child_gate(spark, d):
    return best(spark, d, "B", HEAVY, 1)


EXACT = f"""with {o.rows("S")}, {o.long("S")},
hist as (select l.fid, l.v as cut, sum(cast(r.y as double) - 0.5e0) as g1, count(*) as c1 from long_ l join rows_ r on l.rid = r.rid group by l.fid, l.v),
cand as (select 0 as node, fid, cut, sum(g1) over b as gl, cast(sum(c1) over b as double) as hl, sum(c1) over b as cl, sum(g1) over t as g, cast(sum(c1) over t as double) as h, sum(c1) over t as c
  from hist window b as (partition by fid order by cut rows between unbounded preceding and 1 preceding), t as (partition by fid)),
gains as ({o.gains("(select * from cand where cl is not null) k", PLAIN, "node, fid, cut")})"""


def exact_gains(spark, d):
    return with_gain(candidates(histogram(with_gradients(matrix(spark, d, "S").design()), "features"), exact=True), PLAIN)


@query("exact_gain_candidates", EXACT + " select fid, cut, round(gl, 2) as gl, cl, round(cast(gain as double), -1) as gain from gains")
def exact_gain_candidates(spark, d):
    return exact_gains(spark, d).select("fid", "cut", F.round("gl", 2).alias("gl"), F.col("cl").cast("long").alias("cl"), F.round(F.col("gain").cast("double"), -1).alias("gain"))


@query("exact_best_split", EXACT + " select fid, cut, cl, c from gains where gain > 0 order by gain desc, fid, cut desc limit 1")
def exact_best_split(spark, d):
    return best_splits(exact_gains(spark, d)).select("fid", "cut", F.col("cl").cast("long").alias("cl"), F.col("c").cast("long").alias("c"))


# 2.3 routing


@query("apply_split", f"select case when f1 < cast(40000 as float) then 0 else 1 end as bit, count(*) as n, round(avg(cast(y as double)), 4) as y from ({o.base('L')}) b group by 1")
def apply_split(spark, d):
    bit = split_bit(F.get("features", F.lit(1)), F.lit(40000.0).cast("float"))
    return matrix(spark, d, "L").design().groupBy(bit.alias("bit")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("double")), 4).alias("y"))


@query(
    "partition_index",
    """with r as (select c_custkey, c_nationkey % 4 as node from customer),
s as (select c_custkey, node, sum(case when node % 2 = 0 then 1 else 0 end) over (partition by floor(node / 2)) as n,
  row_number() over (partition by node order by c_custkey) as up, row_number() over (partition by node order by c_custkey desc) as down from r)
select c_custkey, node, cast(case when node % 2 = 0 then up - 1 else n + down - 1 end as bigint) as place from s""",
)
def partition_index_query(spark, d):
    return partition_index(table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("node")), "node", "c_custkey")


# 2.8 levels, trees, ensembles

LEVEL1 = ROOT + ", " + o.route("node_0_1", "node_0_0", "best_0_0") + ", " + o.level("0_1", "grad_0", "node_0_1", PLAIN)


def level1(spark, d):
    rows, t = binned(spark, d, "L")
    rows = with_gradients(rows)
    b = best_splits(with_gain(candidates(histogram(rows)), PLAIN)).first()
    return rows, t, b, rows.withColumn("node", node_of(F.col("bins"), [b["fid"]], [b["cut"]], 1, "int"))


@query("level1_hist", LEVEL1 + f" select node, fid, bin, {SUMS} from hist_0_1")
def level1_hist(spark, d):
    return histogram(level1(spark, d)[3]).select("node", "fid", "bin", *sums("g", "h", "c"))


@query("hist_subtraction", LEVEL1 + f" select node, fid, bin, {SUMS} from hist_0_1")
def hist_subtraction(spark, d):
    rows, _, b, routed = level1(spark, d)
    small = 1 if b["cl"] * 2 <= b["c"] else 2
    return subtracted(histogram(rows), histogram(routed.where(F.col("node") == small))).select("node", "fid", "bin", *sums("g", "h", "c"))


@query("level1_best_splits", LEVEL1 + " " + BEST + " from best_0_1 b join thr t on t.fid = b.fid and t.bin = b.cut")
def level1_best_splits(spark, d):
    _, t, _, routed = level1(spark, d)
    return named(best_splits(with_gain(candidates(histogram(routed)), PLAIN)), t)


NODES = "tree, id, leaf, fid, threshold, weight"
WITH_CATEGORY = NODES + ", category"


def grown_sql(name, objective, levels):
    p = LOGIT if objective else PLAIN
    return o.grown(name, objective, levels, p, 0.3, "0e0" if objective else "0.5e0", SIZE)


def nodes_sql(n: int, names: str = NODES) -> str:
    return " union all ".join(f"select {names} from nodes_{k}" for k in range(n))


def rounded_nodes(spark, model: Model, names: str = NODES) -> DataFrame:
    return nodes_table(spark, model.trees).withColumn("weight", F.round("weight", 3)).select(*names.split(", "))


def ensemble(spark, d, name, objective, levels) -> Model:
    model = Model(config(objective, levels[0]), matrix(spark, d, name))
    for depth in levels:
        model.config.tree.max_depth = depth
        model.grow_tree()
    model.close()
    return model


for _name, _base, _objective, _levels in (
    ("tree_d1", "L", 0, [1]),
    ("tree_d2", "L", 0, [2]),
    ("trees_boosted", "L", 0, [2, 2]),
    ("tree_logistic", "B", 1, [2]),
    ("tree_documents", "D", 1, [1]),
    ("tree_documents_linear", "D", 0, [1]),
):

    def _nodes(spark, d, name=_base, objective=_objective, levels=_levels):
        return rounded_nodes(spark, ensemble(spark, d, name, objective, levels))

    query(_name, grown_sql(_base, _objective, _levels) + " " + nodes_sql(len(_levels)))(_nodes)


@query("model_round_trip", grown_sql("L", 0, [2]) + " " + nodes_sql(1))
def model_round_trip(spark, d):
    return rounded_nodes(spark, load(ensemble(spark, d, "L", 0, [2]).dump()))


TWO = grown_sql("L", 0, [2, 2])
LEAVES = "select round({m}, 3) as prediction, count(*) as n from {t} group by 1"


@query("update_margin", TWO + " " + LEAVES.format(m="m", t="margin_2"))
def update_margin(spark, d):
    model = train(config(depth=2), matrix(spark, d, "L"), 2)
    return model.training_rows().groupBy(F.round("margin", 3).alias("prediction")).agg(F.count("*").alias("n"))


def by_prediction(df: DataFrame) -> DataFrame:
    return df.groupBy(F.round("prediction", 3).alias("prediction")).agg(F.count("*").alias("n"))


@query("predict_1", grown_sql("L", 0, [1]) + ", " + o.scored([1]) + " " + LEAVES.format(m="m", t="scored_1"))
def predict_1(spark, d):
    return by_prediction(ensemble(spark, d, "L", 0, [1]).predict(matrix(spark, d, "L")))


@query("predict_2_trees", TWO + ", " + o.scored([2, 2]) + " " + LEAVES.format(m="m", t="scored_2"))
def predict_2(spark, d):
    return by_prediction(ensemble(spark, d, "L", 0, [2, 2]).predict(matrix(spark, d, "L"), by_column=False))


@query("predict_n_rounds", TWO + ", " + o.scored([2, 2]) + " " + LEAVES.format(m="m", t="scored_1"))
def predict_n_rounds(spark, d):
    return by_prediction(ensemble(spark, d, "L", 0, [2, 2]).predict(matrix(spark, d, "L"), 1))


@query("append_last_tree", TWO + ", " + o.scored([2, 2]) + " " + LEAVES.format(m="m", t="scored_2"))
def append_last_tree(spark, d):
    model, other = Model(config(depth=2), matrix(spark, d, "L")), matrix(spark, d, "L")
    for _ in range(2):
        model.grow_tree()
        model.append_last_tree(other)
    return by_prediction(model.get_y(other))


@query("classifier_proba", grown_sql("B", 1, [2]) + ", " + o.scored([2]) + " " + LEAVES.format(m="1e0 / (1e0 + exp(-m))", t="scored_1"))
def classifier_proba(spark, d):
    return by_prediction(ensemble(spark, d, "B", 1, [2]).predict(matrix(spark, d, "B")))


@query("flagship", grown_sql("L", 0, [1]) + ", " + o.scored([1]) + " select n.node as leaf, count(*) as n, round(avg(s.m), 3) as prediction, round(avg(cast(r.y as double)), 3) as y from scored_1 s join walk_0_1 n on s.rid = n.rid join rows_ r on r.rid = s.rid group by n.node")
def flagship(spark, d):
    """Leaves of a depth-1 tree with their rows and mean prediction."""
    model = ensemble(spark, d, "L", 0, [1])
    t = model.trees[0]
    x = matrix(spark, d, "L")
    out = FeatureMatrix(x.df.withColumn("y", x.y), x.names, check=False)
    leaf = F.when(F.get(out.features, F.lit(t.fids[0])) < F.lit(t.thresholds[0]).cast("float"), 1).otherwise(2)
    return model.predict(out).groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("prediction"), F.round(F.avg(F.col("y").cast("double")), 3).alias("y"))


# metrics

SCORES = "select case when l_extendedprice * (1 - l_discount) > 40000 then 1 else 0 end as y, cast(l_quantity as double) / 50 as prediction from lineitem"


def scores(spark, d):
    return table(spark, d, "lineitem").select(F.expr("case when l_extendedprice * (1 - l_discount) > 40000 then 1 else 0 end").alias("y"), (F.col("l_quantity") / 50).alias("prediction"))


@query("metric_mse_rmse", f"select round(avg(pow(y - prediction, 2)), 6) as mse, round(sqrt(avg(pow(y - prediction, 2))), 6) as rmse from ({SCORES}) s")
def metric_mse_rmse(spark, d):
    return scores(spark, d).agg(F.round(mse(), 6).alias("mse"), F.round(rmse(), 6).alias("rmse"))


@query(
    "metric_auc",
    f"with s as ({SCORES}), r as (select y, rank() over (order by prediction) + (count(*) over (partition by prediction) - 1) / 2e0 as place from s), n as (select sum(y) as pos, count(*) - sum(y) as neg from s) "
    "select round((sum(case when y = 1 then place end) - max(pos) * (max(pos) + 1) / 2e0) / (max(pos) * max(neg)), 6) as auc from r, n",
)
def metric_auc(spark, d):
    return auc_table(scores(spark, d)).select(F.round("auc", 6).alias("auc"))


# extensions and what SQL can't express


@query(
    "category_best_split",
    f"""with c as (select l_linenumber as cut, sum(cast(y as double) - 0.5e0) as gl, cast(count(*) as double) as hl, count(*) as cl
from (select l_linenumber, cast(l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 as float) as y from lineitem) r group by 1),
k as (select 0 as node, 0 as fid, cut, gl, hl, cl, sum(gl) over () as g, sum(hl) over () as h, sum(cl) over () as c from c)
select cut, round(gl, 2) as gl, cl, round(cast(gain as double), -1) as gain from ({o.gains("k", PLAIN, "node, fid, cut")}) z where gain > 0 order by gain desc, cut limit 1""",
)
def category_best_split(spark, d):
    m = FeatureMatrix(table(spark, d, "lineitem"), ["l_quantity"], y=F.expr(o.BASES["L"][2]), categories=["l_linenumber"], check=False)
    b = best_category_splits(category_splits(histogram(with_gradients(m.design()), "categories"), PLAIN))
    return b.select("cut", F.round("gl", 2).alias("gl"), F.col("cl").cast("long").alias("cl"), F.round(F.col("gain").cast("double"), -1).alias("gain"))


MARGINS = "select l_orderkey, l_linenumber, l_linenumber % 3 as label, l_discount * 10 as a, l_tax * 10 as b, l_quantity / 50 as c from lineitem"


def margins(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("label"), F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("m"))


@query("softmax_link", f"select l_orderkey, l_linenumber, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) as p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) as p1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) as p2 from ({MARGINS}) s")
def softmax_link(spark, d):
    p = margins(spark, d).withColumn("p", softmax(F.col("m")))
    return p.select("l_orderkey", "l_linenumber", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)))


@query(
    "softmax_grad",
    f"select l_orderkey, l_linenumber, round((case when label = 0 then 1 else 0 end) - p0, 6) as g0, round((case when label = 1 then 1 else 0 end) - p1, 6) as g1, round(2 * p2 * (1 - p2), 6) as h2 "
    f"from (select *, exp(a) / (exp(a) + exp(b) + exp(c)) as p0, exp(b) / (exp(a) + exp(b) + exp(c)) as p1, exp(c) / (exp(a) + exp(b) + exp(c)) as p2 from ({MARGINS}) s) q",
)
def softmax_grad(spark, d):
    g, h = softmax_gradients(F.col("label"), F.col("m"))
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return margins(spark, d).select("l_orderkey", "l_linenumber", at(g, 0).alias("g0"), at(g, 1).alias("g1"), at(h, 2).alias("h2"))


@query("weighted_grad", f"select round(sum((cast(y as double) - 0.5e0) * w), 1) as g, round(sum(w), 2) as h from (select cast({o.BASES['L'][2]} as float) as y, cast(cast(l_quantity as float) as double) as w from lineitem) r")
def weighted_grad(spark, d):
    m = FeatureMatrix(table(spark, d, "lineitem"), ["l_discount"], y=F.expr(o.BASES["L"][2]), weights="l_quantity", check=False)
    g, h = gradients(0, F.col("y"), F.lit(0.5), F.col("weight").cast("double"))
    return m.design().agg(F.round(F.sum(g), 1).alias("g"), F.round(F.sum(h), 2).alias("h"))


VECTORS = replace(PLAIN, lambda_=0.0)


@query("wide_vectors_tree", o.grown("V", 0, [1], VECTORS, 0.3, "0.1e0", SIZE) + " " + nodes_sql(1))
def wide_vectors_tree(spark, d):
    """A depth-1 tree over 64 features from an array column."""
    return rounded_nodes(spark, train(config(0, 1, **{"lambda": 0.0, "initial_y": 0.1}), matrix(spark, d, "V"), 1))


PLAIN_FIT = {"min_leaf_size": 1, "colsample_bytree": 1.0, "l1": 0.0, "hist_size": SIZE, "verbosity": 0}


@query(
    "early_stopping",
    o.grown("L", 0, [1, 1, 1, 1], PLAIN, 2.5, "0.5e0", SIZE)
    + ", scores as ("
    + " union all ".join(f"select {k} as round, avg(pow(cast(r.y as double) - m.m, 2)) as score from margin_{k + 1} m join rows_ r on m.rid = r.rid" for k in range(4))
    + ") select round, round(score, 2) as score, round = (select arg_min(round, score) from scores) as best from scores",
)
def early_stopping(spark, d):
    """Scores of an evaluation set by round. Steps are so long that each tree but the first makes them worse, so training stops after the patience of two rounds, long before the tenth."""
    fit = TreesRegressor(max_depth=1, learning_rate=2.5, n_estimators=10, **PLAIN_FIT).fit(matrix(spark, d, "L"), matrix(spark, d, "L"), early_stopping_rounds=2)
    fit.model.close()
    return spark.createDataFrame([(i, round(float(s), 2), i == fit.best_round) for i, s in enumerate(fit.scores)], "round int, score double, best boolean")


@query("classifier_fit", grown_sql("B", 1, [2, 2]) + " " + nodes_sql(2))
def classifier_fit(spark, d):
    fit = TreesClassifier(max_depth=2, n_estimators=2, learning_rate=0.3, **PLAIN_FIT).fit(matrix(spark, d, "B"))
    fit.model.close()
    return rounded_nodes(spark, fit.model)


@query("regressor_fit", grown_sql("L", 0, [2, 2]) + " " + nodes_sql(2))
def regressor_fit(spark, d):
    fit = TreesRegressor(max_depth=2, n_estimators=2, learning_rate=0.3, **PLAIN_FIT).fit(matrix(spark, d, "L"))
    fit.model.close()
    return rounded_nodes(spark, fit.model)


@query("custom_gradient_tree", grown_sql("L", 0, [2]) + " " + nodes_sql(1))
def custom_gradient_tree(spark, d):
    """The linear objective's tree from gradients that the caller gives."""
    model = Model(config(1, 2, initial_y=0.5), matrix(spark, d, "L"))
    model.grow_tree((F.col("y").cast("double") - F.lit(0.5), F.lit(1.0)))
    model.close()
    return rounded_nodes(spark, model)


def sampled(level: int) -> list[int]:
    """The features that a sampler of five columns draws for its first tree and its first or second level."""
    s = ColumnSampler(5, 0.8, 0.75, 7)
    s.tree()
    return [s.level() for _ in range(level + 1)][level]


def sampled_sql() -> str:
    return ROOT + " " + " union all ".join(f"select {k} as level, fid, bin, {SUMS} from hist_0_0 where fid in ({', '.join(map(str, sampled(k)))})" for k in (0, 1))


@query("column_sampling", sampled_sql())
def column_sampling(spark, d):
    """Root histograms of the features that a tree's first two levels would draw."""
    rows, t = binned(spark, d, "L")
    rows, sizes = with_gradients(rows), [len(x) + 1 for x in t]
    parts = [histogram_by_task(rows, 0, [], [], sizes, fids=sampled(k)).select(F.lit(k).alias("level"), "fid", "bin", *sums("g", "h", "c")) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("exact_tree", o.grown("S", 0, [3], PLAIN, 0.3, "0.5e0", by_value=True) + " " + nodes_sql(1))
def exact_tree(spark, d):
    c = config(depth=3)
    c.method = 0
    return rounded_nodes(spark, train(c, matrix(spark, d, "S"), 1))


@query("category_tree", grown_sql("C", 0, [2, 2]) + " " + nodes_sql(2, WITH_CATEGORY))
def category_tree(spark, d):
    """Two trees in which a category column splits beside numbers."""
    return rounded_nodes(spark, ensemble(spark, d, "C", 0, [2, 2]), WITH_CATEGORY)


@query("category_predict", grown_sql("C", 0, [2, 2]) + " " + LEAVES.format(m="m", t="margin_2"))
def category_predict(spark, d):
    return by_prediction(load(ensemble(spark, d, "C", 0, [2, 2]).dump()).predict(matrix(spark, d, "C")))


SOFT = replace(PLAIN, gate_hessian=True)
SOFTMAX_SQL = o.softmax_grown("M", 3, 2, 2, SOFT, 0.3, SIZE)


def softmax_model(spark, d) -> Model:
    model = train(config(3, 2, labels_count=3, initial_y=0.0), matrix(spark, d, "M"), 2)
    model.close()
    return model


@query("softmax_trees", SOFTMAX_SQL + " " + nodes_sql(6))
def softmax_trees(spark, d):
    """Two rounds of a tree for each of three classes."""
    return rounded_nodes(spark, softmax_model(spark, d))


@query("softmax_predict", SOFTMAX_SQL + ", e as (select exp(m0) as a, exp(m1) as b, exp(m2) as c from margins_2) select round(a / (a + b + c), 3) as p0, round(b / (a + b + c), 3) as p1, round(c / (a + b + c), 3) as p2, count(*) as n from e group by 1, 2, 3")
def softmax_predict(spark, d):
    out = softmax_model(spark, d).predict(matrix(spark, d, "M"))
    return out.groupBy(*(F.round(F.get("prediction", F.lit(k)), 3).alias(f"p{k}") for k in range(3))).agg(F.count("*").alias("n"))


@query("class_labels", "select 4 as labels_count, l_linenumber % 4 as label, count(*) as n from lineitem group by 2")
def class_labels(spark, d):
    m = FeatureMatrix(table(spark, d, "lineitem"), ["l_quantity"], labels=F.col("l_linenumber") % 4)
    return m.df.groupBy(m.labels.alias("label")).agg(F.count("*").alias("n")).select(F.lit(m.labels_count).alias("labels_count"), "label", "n")


@query("missing_values", "select count(*) as n, round(sum(coalesce(nullif(cast(l_discount as float), cast(0.05 as float)), -1)), 2) as total from lineitem")
def missing_values(spark, d):
    df = table(spark, d, "lineitem").select(F.when(F.col("l_discount").cast("float") != F.lit(0.05).cast("float"), F.col("l_discount")).alias("x"))
    return FeatureMatrix(df, ["x"], missing=-1.0).design().agg(F.count("*").alias("n"), F.round(F.sum(F.get("features", F.lit(0)).cast("double")), 2).alias("total"))


@query("from_arrays", "select row_number() over (order by n_nationkey) - 1 as row_id, cast(n_nationkey as float) as f0, cast(n_regionkey * 0.1e0 as float) as f1, cast(n_regionkey as int) as c0, cast(n_nationkey as float) / 2 as y from nation")
def from_arrays(spark, d):
    """A matrix from arrays in the driver's memory."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    key, region = np.array([r[0] for r in rows], np.float64), np.array([r[1] for r in rows])
    m = FeatureMatrix.from_arrays(spark, np.column_stack([key, region * 0.1]), region[:, None], y=key / 2)
    return m.df.select("row_id", "f0", "f1", "c0", "y")


@query(
    "config_json",
    "select * from (values ('internals.hist_size', '32'), ('internals.seed', '9'), ('method', '0'), ('objective', '1'), ('tree.colsample_bytree', '0.5'), ('tree.eta', '0.25'), ('tree.lambda', '2.0'), ('tree.max_depth', '4'), ('verbose.gpu', 'true')) t(key, value)",
)
def config_json(spark, d):
    """A configuration after its way through JSON and back, with unknown keys left out; what is not the default."""
    given = {"method": 0, "objective": 1, "unknown": 1, "tree": {"max_depth": 4, "eta": 0.25, "lambda": 2.0, "colsample_bytree": 0.5, "gamma": 3}, "internals": {"hist_size": 32, "seed": 9}, "verbose": {"gpu": True}}
    flat = lambda x: {f"{k}.{n}" if isinstance(v, dict) else k: w for k, v in x.items() for n, w in (v.items() if isinstance(v, dict) else [(k, v)])}
    out, default = flat(Configuration.parse(json.dumps(Configuration.parse(given).to_dict())).to_dict()), flat(Configuration().to_dict())
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(out.items()) if v != default[k]], "key string, value string")


@query("refused", "select * from (values ('a column that is not there', true), ('a null feature', true), ('a text feature', true), ('all fine', false), ('depth 0', true), ('two targets', true)) t(case_, refused)")
def refused(spark, d):
    """Which of these inputs raise an error."""
    df = table(spark, d, "nation").withColumn("hole", F.when(F.col("n_nationkey") > 3, 1.0))
    cases = {
        "a column that is not there": lambda: FeatureMatrix(df, ["nothing"]),
        "a null feature": lambda: FeatureMatrix(df, ["hole"]),
        "a text feature": lambda: FeatureMatrix(df, ["n_name"]),
        "all fine": lambda: FeatureMatrix(df, ["n_nationkey"], y="n_regionkey"),
        "depth 0": lambda: Configuration.parse({"tree": {"max_depth": 0}}),
        "two targets": lambda: FeatureMatrix(df, ["n_nationkey"], y="n_regionkey", labels="n_regionkey"),
    }

    def raises(f: Callable) -> bool:
        try:
            f()
        except (TreesError, KeyError):
            return True
        return False

    return spark.createDataFrame([(k, raises(f)) for k, f in cases.items()], "case_ string, refused boolean")
