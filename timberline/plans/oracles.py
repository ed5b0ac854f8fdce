"""SQL for the catalogue's queries: the same dataflow written from the tables up, one common table expression per step.

Weights, scores and gains are written apart from the engine's: a leaf's weight is the sign of G and a size, and its score is that size times what is left of it."""

from __future__ import annotations

from timberline.functions.gain import Penalties

#: Base tables: feature expressions and target, over a table expression.
BASES = {
    "L": ("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000"),
    "S": ("lineitem", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000"),
    "B": ("lineitem", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "case when l_extendedprice * (1 - l_discount) > 40000 then 1 else 0 end"),
    "D": (
        "(select d.n_chars, length(d.text) - length(replace(d.text, ' ', '')) as spaces, length(d.text) - length(replace(d.text, chr(10), '')) as line_ends, l.quality from labels l join documents d on l.doc_id = d.doc_id) j",
        ["n_chars", "spaces", "line_ends"],
        "quality",
    ),
    "C": ("lineitem", ["l_quantity", "l_tax"], "case when l_linenumber = 3 then 40 when l_linenumber = 5 then 15 else 0 end + l_quantity / 10"),
    "M": ("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "case when l_quantity < 17 then 0 when l_extendedprice < 40000 then 1 else 2 end"),
    "V": ("embeddings", [f"embedding[{i + 1}]" for i in range(64)], "case when label = 0 then 1 else 0 end"),
}
#: Category columns, whose features follow.
CATEGORIES = {"C": ["l_linenumber"]}


def size(g: str, h: str, c: str, p: Penalties) -> str:
    """The absolute value of a leaf's weight."""
    free = f"coalesce(greatest(abs({g}) - {p.alpha!r}, 0.0) / nullif({h} + {p.lambda_!r}, 0.0), 0.0)"
    held = f"least({free}, {p.max_leaf_weight!r})" if p.max_leaf_weight else free
    return f"(case when {c} < {p.min_leaf_size} or {h} < {p.min_child_weight!r} then 0.0 else {held} end)"


def weight(g: str, h: str, c: str, p: Penalties) -> str:
    return f"(case when {g} < 0 then -1.0 else 1.0 end * {size(g, h, c, p)})"


def score(g: str, h: str, w: str, p: Penalties) -> str:
    """2 G w - (H + lambda) w^2 - 2 alpha |w|, by the weight's size w."""
    return f"({w} * (2.0 * (abs({g}) - {p.alpha!r}) - ({h} + {p.lambda_!r}) * {w}))"


def gains(source: str, p: Penalties, keep: str) -> str:
    """A select that adds gain to rows with gl, hl, cl (left) and g, h, c (node)."""
    sized = f"select {keep}, gl, hl, cl, g, h, c, {size('gl', 'hl', 'cl', p)} as zl, {size('(g - gl)', '(h - hl)', '(c - cl)', p)} as zr, {size('g', 'h', 'c', p)} as zp from {source}"
    scored = f"select *, {score('gl', 'hl', 'zl', p)} + {score('(g - gl)', '(h - hl)', 'zr', p)} as sides, {score('g', 'h', 'zp', p)} as whole from ({sized}) z1"
    allowed = [f"least(cl, c - cl) >= {p.min_leaf_size}", f"sides - whole > {p.gamma_absolute!r}", f"sides - whole > {p.gamma_relative!r} * whole"]
    if p.gate_hessian:
        allowed.append(f"least(abs(hl), abs(h - hl)) >= {p.min_child_weight!r}")
    return f"select *, cast(if({' and '.join(allowed)}, sides - whole, 0.0) as float) as gain from ({scored}) z2"


def base(name: str) -> str:
    table, features, y = BASES[name]
    columns = ", ".join(f"cast({f} as float) as f{i}" for i, f in enumerate(features))
    columns += "".join(f", {c} as c{i}" for i, c in enumerate(CATEGORIES.get(name, ())))
    return f"select {columns}, cast({y} as float) as y from {table}"


def width(name: str) -> int:
    return len(BASES[name][1])


def rows(name: str) -> str:
    return f"rows_ as (select row_number() over () as rid, b.* from ({base(name)}) b)"


def long(name: str) -> str:
    return "long_ as (" + " union all ".join(f"select rid, {i} as fid, f{i} as v from rows_" for i in range(width(name))) + ")"


def thresholds(size: int) -> str:
    return f"""
u as (select fid, v, count(*) as c from long_ group by fid, v),
ranked as (
  select fid, v, c, dense_rank() over o - 1 as k, lag(v) over o as p, sum(c) over o - c as less, sum(c) over (partition by fid) as n
  from u window o as (partition by fid order by v)),
proposed as (
  select fid, cast(least(k, floor(less / greatest(1, floor(n / {size})))) - 1 as int) as seg, cast(cast(v + p as float) * 0.5e0 as float) as t
  from ranked where k >= 1),
least_ as (select fid, seg, min(t) as threshold from proposed where seg >= 0 and seg < {size} - 1 group by fid, seg),
numbered as (select fid, seg, threshold, row_number() over (partition by fid order by seg) - 1 as bin from least_),
thr as (select fid, cast(bin as int) as bin, threshold from numbered where bin = seg)"""


def exact(name: str) -> str:
    """Codes are dense ranks of values, and a cut is the first value on the right."""
    return f"""with {rows(name)}, {long(name)},
u as (select distinct fid, v from long_),
thr as (select fid, cast(dense_rank() over (partition by fid order by v) - 1 as int) as bin, v as threshold from u),
coded as (select l.rid, l.fid, l.v, t.bin from long_ l join thr t on l.fid = t.fid and l.v = t.threshold)"""


CODED = """
codes as (select u.fid, u.v, (select count(*) from thr t where t.fid = u.fid and t.threshold < u.v) as bin from u),
coded as (select l.rid, l.fid, l.v, cast(c.bin as int) as bin from long_ l join codes c on l.fid = c.fid and l.v = c.v)"""


def start(name: str, size: int = 32) -> str:
    made = f"with {rows(name)}, {long(name)}, {thresholds(size)}, {CODED}"
    if name not in CATEGORIES:
        return made
    codes = " union all ".join(f"select rid, {width(name) + i} as fid, cast(c{i} as float) as v, cast(c{i} as int) as bin from rows_" for i in range(len(CATEGORIES[name])))
    return made.replace("coded as (", "numeric_coded as (") + f", coded as (select * from numeric_coded union all {codes})"


def gradient(k: int, objective: int, margin: str) -> str:
    """grad_k (rid, g, h) from margin_k (rid, m)."""
    if objective:
        p = "1e0 / (1e0 + exp(-m.m))"
        return f"margin_{k} as ({margin}), grad_{k} as (select r.rid, r.y - {p} as g, ({p}) * (1e0 - {p}) as h from rows_ r join margin_{k} m on r.rid = m.rid)"
    return f"margin_{k} as ({margin}), grad_{k} as (select r.rid, cast(r.y as double) - m.m as g, 1e0 as h from rows_ r join margin_{k} m on r.rid = m.rid)"


def level(tag: str, grad: str, node: str, p: Penalties, by_value: bool = False, first_category: int | None = None) -> str:
    """hist, prefixes, gains and best splits of one level, from rows' nodes."""
    frame = " rows between unbounded preceding and 1 preceding" if by_value else ""
    order = "cut desc" if first_category is None else f"case when fid >= {first_category} then -cut else cut end desc"
    cand = f"select * from pref_{tag} where cut is not null"
    if first_category is not None:
        whole = f"sum(g) over t, sum(h) over t, sum(c) over t from hist_{tag} where fid >= {first_category} window t as (partition by node, fid)"
        cand += f" and fid < {first_category} union all select node, fid, bin, bin as cut, g, h, c, {whole}"
    return f"""
hist_{tag} as (
  select n.node, c.fid, c.bin, sum(g.g) as g, sum(g.h) as h, count(*) as c
  from coded c join {grad} g on c.rid = g.rid join {node} n on c.rid = n.rid group by n.node, c.fid, c.bin),
pref_{tag} as (
  select node, fid, bin, {"case when sum(c) over o is not null then bin end" if by_value else "lead(bin) over (partition by node, fid order by bin) - 1"} as cut, sum(g) over o as gl, sum(h) over o as hl, sum(c) over o as cl,
         sum(g) over t as g, sum(h) over t as h, sum(c) over t as c
  from hist_{tag} window o as (partition by node, fid order by bin{frame}), t as (partition by node, fid)),
cand_{tag} as ({cand}),
gain_{tag} as ({gains(f"cand_{tag}", p, "node, fid, cut")}),
best_{tag} as (
  select * from (select *, row_number() over (partition by node order by gain desc, fid, {order}) as place from gain_{tag} where gain > 0) where place = 1)"""


def route(new: str, old: str, best: str, by_value: bool = False, first_category: int | None = None) -> str:
    left = "c.bin < b.cut" if by_value else "c.bin <= b.cut"
    if first_category is not None:
        left = f"if(b.fid >= {first_category}, c.bin = b.cut, {left})"
    return f"""
{new} as (
  select n.rid, case when b.node is null or {left} then 2 * n.node + 1 else 2 * n.node + 2 end as node
  from {old} n left join {best} b on n.node = b.node left join coded c on c.rid = n.rid and c.fid = b.fid)"""


def tree(k: int, levels: int, p: Penalties, eta: float, by_value: bool = False, first_category: int | None = None) -> str:
    """Levels of tree k, its leaves (node, weight) and nodes (id, leaf, fid, threshold, weight)."""
    parts, node = [], f"node_{k}_0"
    parts.append(f"{node} as (select rid, 0 as node from rows_)")
    for l in range(levels):
        parts += [level(f"{k}_{l}", f"grad_{k}", f"node_{k}_{l}", p, by_value, first_category), route(f"node_{k}_{l + 1}", f"node_{k}_{l}", f"best_{k}_{l}", by_value, first_category)]
    first = 2**levels - 1
    ids = lambda low, high: " union all ".join(f"select {i} as id" for i in range(low, high))
    bests = " union all ".join(f"select node, fid, cut from best_{k}_{l}" for l in range(levels))
    parts.append(f"""
sums_{k} as (select n.node, sum(g.g) as g, sum(g.h) as h, count(*) as c from node_{k}_{levels} n join grad_{k} g on n.rid = g.rid group by n.node),
leaf_{k} as (
  select i.id as node, cast(coalesce({weight("s.g", "s.h", "s.c", p)}, 0e0) * {eta!r}e0 as float) as weight
  from ({ids(first, 2 * first + 1)}) i left join sums_{k} s on i.id = s.node),
split_{k} as (
  select i.id, coalesce(b.fid, 0) as fid, t.threshold, {f"case when b.fid >= {first_category} then b.cut end" if first_category is not None else "null"} as category
  from ({ids(0, first)}) i left join ({bests}) b on i.id = b.node left join thr t on t.fid = b.fid and t.bin = b.cut),
nodes_{k} as (
  select {k} as tree, id, false as leaf, fid, threshold, cast(category as int) as category, cast(null as double) as weight from split_{k}
  union all select {k} as tree, node as id, true as leaf, null as fid, null as threshold, null as category, round(cast(weight as double), 3) as weight from leaf_{k})""")
    return ",".join(parts)


def grown(name: str, objective: int, levels: list[int], p: Penalties, eta: float, base_margin: str, size: int = 32, by_value: bool = False) -> str:
    """CTEs of an ensemble; margin_k are the training margins before tree k."""
    parts = [exact(name) if by_value else start(name, size), gradient(0, objective, f"select rid, {base_margin} as m from rows_")]
    for k, l in enumerate(levels):
        parts.append(tree(k, l, p, eta, by_value, width(name) if name in CATEGORIES else None))
        after = f"select m.rid, m.m + f.weight as m from margin_{k} m join node_{k}_{l} n on m.rid = n.rid join leaf_{k} f on n.node = f.node"
        parts.append(gradient(k + 1, objective, after) if k + 1 < len(levels) else f"margin_{k + 1} as ({after})")
    return ", ".join(parts)


def scored(levels: list[int]) -> str:
    """scored_k (rid, m): margins of the first k trees by values under thresholds, as a new table would be scored."""
    parts = ["scored_0 as (select rid, m from margin_0)"]
    for k, n in enumerate(levels):
        for l in range(n):
            old = f"(select rid, 0 as node from rows_)" if l == 0 else f"walk_{k}_{l}"
            parts.append(f"""
walk_{k}_{l + 1} as (
  select n.rid, case when s.threshold is null or x.v < s.threshold then 2 * n.node + 1 else 2 * n.node + 2 end as node
  from {old} n join split_{k} s on n.node = s.id join long_ x on x.rid = n.rid and x.fid = s.fid)""")
        parts.append(f"scored_{k + 1} as (select m.rid, m.m + f.weight as m from scored_{k} m join walk_{k}_{n} n on m.rid = n.rid join leaf_{k} f on n.node = f.node)")
    return ", ".join(parts)


def softmax_grown(name: str, labels: int, rounds: int, levels: int, p: Penalties, eta: float, size: int = 32) -> str:
    """CTEs of rounds of a tree per label; tree r * labels + j is label j's of round r, margins_r has a column for each label."""
    parts = [start(name, size), "margins_0 as (select rid, " + ", ".join(f"0e0 as m{j}" for j in range(labels)) + " from rows_)"]
    total = " + ".join(f"exp(m{j})" for j in range(labels))
    for r in range(rounds):
        parts.append(f"chances_{r} as (select rid, " + ", ".join(f"exp(m{j}) / ({total}) as p{j}" for j in range(labels)) + f" from margins_{r})")
        for j in range(labels):
            k = r * labels + j
            parts.append(f"grad_{k} as (select c.rid, if(r.y = {j}, 1e0, 0e0) - p{j} as g, 2e0 * p{j} * (1e0 - p{j}) as h from chances_{r} c join rows_ r on c.rid = r.rid)")
            parts.append(tree(k, levels, p, eta))
        joins = " ".join(f"join node_{r * labels + j}_{levels} n{j} on m.rid = n{j}.rid join leaf_{r * labels + j} f{j} on n{j}.node = f{j}.node" for j in range(labels))
        parts.append(f"margins_{r + 1} as (select m.rid, " + ", ".join(f"m.m{j} + f{j}.weight as m{j}" for j in range(labels)) + f" from margins_{r} m {joins})")
    return ", ".join(parts)
