"""The decision engine: which layout a checkpoint's headers are, whether it serves a lane, and by which derivation.

Headers are a table (artifact, member, ord, name, dtype, shape); layouts (layout, layout_ord, component, component_ord, key,
dtypes, shape, optional, vacant), ``vacant`` marking a transforming rule that transformed nothing. Refusals are rows.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators.ordered import checkpoint, few, large


def candidates(headers: DataFrame, layouts: DataFrame) -> DataFrame:
    """(artifact, layout, layout_ord) that counts and a probe don't rule out; it loses no layout that the headers are.

    The probe is an equi-join on the least tensor name, so no artifact meets all layouts."""
    shape = headers.groupBy("artifact").agg(F.count("*").alias("total"), F.min("name").alias("probe"))
    stats = layouts.groupBy("layout", "layout_ord").agg(F.count_if(~F.col("optional")).alias("required"), F.count("*").alias("most"), F.max("vacant").alias("vacant")).where(~F.col("vacant"))
    keys = layouts.select("layout", F.col("key").alias("probe")).distinct()
    return shape.join(large(keys), "probe").join(large(stats), "layout").where("total between required and most").select("artifact", "layout", "layout_ord")


def accepts(headers: DataFrame, layouts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (artifact, layout) of ``pairs``, which is a checkpoint, member, and component that declares any of its tensors (the first component,
    if none does): tensors, those declared (overlap), those matched before the first disagreement, and that disagreement's
    reason and tensor (null: accepted).

    Tensors meet only the components that declare them. A member's tensors are numbered, so the first that a component
    doesn't declare is the first number that its hits lack, and no tensor has to be paired with a component to be missed."""
    keys = ["artifact", "layout", "member", "component", "component_ord"]
    chosen = few(pairs.select("artifact", "layout"))
    ranked = headers.withColumn("rank", F.row_number().over(Window.partitionBy("artifact", "member").orderBy("ord")) - 1)
    sizes = ranked.groupBy("artifact", "member").agg(F.count("*").alias("tensors"))
    declared = layouts.select("layout", "component", "component_ord", F.col("key").alias("name"), "dtypes", F.col("shape").alias("declared"))
    hits = ranked.join(chosen, "artifact").join(large(declared), ["layout", "name"])
    hits = hits.withColumn("why", F.when(F.col("declared") != F.col("shape"), "shape").when(~F.array_contains("dtypes", F.col("dtype")), "dtype"))
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) - 1)
    bad = F.when(F.col("why").isNotNull(), F.col("rank"))
    judged = hits.groupBy(*keys).agg(F.count("*").alias("overlap"), F.count_if(F.col("rank") == F.col("place")).alias("prefix"), F.min(bad).alias("bad"), F.min_by("why", bad).alias("why"), F.min_by("name", bad).alias("bad_name"))
    first = layouts.groupBy("layout").agg(F.min(F.struct("component_ord", "component")).alias("c"))
    alone = sizes.join(chosen, "artifact").join(large(judged.select("artifact", "layout", "member").distinct()), ["artifact", "layout", "member"], "left_anti").join(large(first), "layout")
    none = F.lit(None)
    alone = alone.select("artifact", "layout", "member", F.col("c.component").alias("component"), F.col("c.component_ord").alias("component_ord"), F.lit(0).cast("long").alias("overlap"), F.lit(0).cast("long").alias("prefix"), none.cast("int").alias("bad"), none.cast("string").alias("why"), none.cast("string").alias("bad_name"))
    rows = judged.unionByName(alone).join(large(sizes), ["artifact", "member"])
    lacking = F.when(F.col("prefix") < F.col("tensors"), F.col("prefix"))
    rows = rows.withColumn("lacking", lacking).withColumn("first", F.least("bad", "lacking"))
    rows = rows.withColumn("reason", F.when(F.col("first").isNull(), F.lit(None)).when(F.col("first") == F.col("bad"), F.col("why")).otherwise("unclaimed"))
    names = ranked.select("artifact", "member", F.col("rank").cast("long").alias("first"), F.col("name").alias("first_name"))
    rows = rows.withColumn("first", F.col("first").cast("long")).join(large(names), ["artifact", "member", "first"], "left")
    return rows.select(*keys, "tensors", "overlap", F.coalesce("first", "tensors").alias("matched"), "reason", F.when(F.col("reason").isNotNull(), F.col("first_name")).alias("tensor"))


ASSIGNED = "artifact string, layout string, member string, component string, matched long, reason string, tensor string"


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members to components, in path order: those with one choice first, the others to what they cover most of anew."""
    names = {m: g for m, g in zip(pdf["member"], pdf["names"])}
    choices = defaultdict(list)
    for m, c, o, ok in zip(pdf["member"], pdf["component"], pdf["component_ord"], pdf["reason"].isna()):
        if ok:
            choices[m].append((o, c))
    covered: dict[str, set] = defaultdict(set)
    out, matched = [], 0
    artifact, layout = pdf["artifact"].iloc[0], pdf["layout"].iloc[0]
    members = sorted(names)
    for m in [m for m in members if len(choices[m]) == 1] + [m for m in members if len(choices[m]) > 1]:
        directory = m.rsplit("/", 1)[0].rsplit("/", 1)[-1] if "/" in m else ""
        best = max(sorted(choices[m]), key=lambda oc: (sum(n not in covered[oc[1]] for n in names[m]) + (directory == oc[1]), -oc[0]))[1]
        for n in names[m]:
            if n in covered[best]:
                return pd.DataFrame([(artifact, layout, m, best, 0, "duplicate", n)], columns=[c.split()[0] for c in ASSIGNED.split(", ")])
            covered[best].add(n)
            matched += 1
        out.append((artifact, layout, m, best, matched, None, None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ASSIGNED.split(", ")])


def match_layouts(headers: DataFrame, layouts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(artifact, layout, matched, reason, component, tensor) of each pair; a null reason: the headers are the layout."""
    judged = checkpoint(accepts(headers, layouts, pairs))  # read three times below
    keys = ["artifact", "layout"]
    member = judged.groupBy(*keys, "member").agg(
        F.max(F.col("reason").isNull()).alias("any"), F.max_by(F.struct("reason", "component", "tensor", "matched"), F.struct("overlap", -F.col("component_ord"))).alias("why")
    )
    refused = member.where(~F.col("any")).groupBy(*keys).agg(F.min_by("why", "member").alias("why"))
    refused = refused.select(*keys, F.col("why.matched").alias("matched"), F.col("why.reason").alias("reason"), F.col("why.component").alias("component"), F.col("why.tensor").alias("tensor"))
    whole = judged.join(large(refused.select(*keys)), keys, "left_anti")
    names = headers.groupBy("artifact", "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    # Members of an artifact are few; the greedy choice is sequential.
    assigned = whole.join(large(names), ["artifact", "member"]).groupBy(*keys).applyInPandas(_assign, ASSIGNED)
    doubled = assigned.where("reason is not null").select(*keys, "matched", "reason", "component", "tensor")
    good = assigned.where("reason is null")
    totals = good.groupBy(*keys).agg(F.max("matched").alias("matched"))
    covered = good.join(large(headers.select("artifact", "member", F.col("name").alias("key"))), ["artifact", "member"]).select(*keys, "component", "key")
    needed = totals.select(*keys).join(large(layouts.where(~F.col("optional")).select("layout", "component", "component_ord", "key")), "layout")
    lacking = needed.join(large(covered), [*keys, "component", "key"], "left_anti").groupBy(*keys).agg(F.min(F.struct("component_ord", "key", "component")).alias("m"))
    done = totals.join(large(lacking), keys, "left").select(*keys, "matched", F.when(F.col("m").isNotNull(), "missing").alias("reason"), F.col("m.component").alias("component"), F.col("m.key").alias("tensor"))
    return refused.unionByName(doubled).unionByName(done)


def stamp(headers: DataFrame, layouts: DataFrame) -> DataFrame:
    """(artifact, layout, matched, reason, component, tensor): the first layout in order that the headers are; otherwise the
    refusal that matched most, the earliest of equal ones; ``no-stamp`` if no layout was a candidate."""
    pairs = checkpoint(candidates(headers, layouts))  # a few rows an artifact, read again and again
    matched = match_layouts(headers, layouts, pairs).join(large(pairs), ["artifact", "layout"])
    value = F.struct("layout", "matched", "reason", "component", "tensor")
    order = F.struct(F.col("reason").isNull(), F.when(F.col("reason").isNull(), F.lit(0)).otherwise(F.col("matched")), -F.col("layout_ord"))
    best = matched.groupBy("artifact").agg(F.max_by(value, order).alias("v"))
    out = headers.select("artifact").distinct().join(large(best), "artifact", "left")
    hit = F.col("v.reason").isNull() & F.col("v").isNotNull()
    return out.select("artifact", F.when(hit, F.col("v.layout")).alias("layout"), F.coalesce("v.matched", F.lit(0)).alias("matched"), F.when(~hit, F.coalesce(F.col("v.reason"), F.lit("no-stamp"))).alias("reason"), F.col("v.component").alias("component"), F.col("v.tensor").alias("tensor"))


def stamp_all(headers: DataFrame, layouts: DataFrame) -> DataFrame:
    """(artifact, layout) of every match; more than one a checkpoint means two names for one packaging."""
    pairs = checkpoint(candidates(headers, layouts))
    return match_layouts(headers, layouts, pairs).where("reason is null").select("artifact", "layout")


def closest_lane(headers: DataFrame, layouts: DataFrame, lanes: list[str]) -> DataFrame:
    """(artifact, layout, matched, reason, component, tensor): of the lanes' layouts that an artifact's headers aren't, the one
    that matched most, the first of equal ones, with its disagreement; artifacts that are all of the lanes have no row."""
    pairs = headers.select("artifact").distinct().withColumn("layout", F.explode(F.array(*map(F.lit, lanes))))
    pairs = checkpoint(pairs)
    place = F.array_position(F.array(*map(F.lit, lanes)), F.col("layout"))
    refused = match_layouts(headers, layouts, pairs).where("reason is not null")
    best = refused.groupBy("artifact").agg(F.max_by(F.struct("layout", "matched", "reason", "component", "tensor"), F.struct(F.col("matched"), -place)).alias("v"))
    return best.select("artifact", "v.*")


def admit_files(headers: DataFrame, layouts: DataFrame, stamps: DataFrame, admitted: DataFrame, lanes: list[str]) -> DataFrame:
    """(artifact, lane, decision, reason, closest, component, tensor, note): what ``admit`` says of stamped artifacts, and for
    those it found no way for, or that have no stamp, the closest lane's disagreement; ``note`` is the stamp that an unrelated
    one has. Without lanes all are refused with ``no-lane``. ``stamps`` is the result of ``stamp``."""
    every = headers.select("artifact").distinct()
    empty = F.lit(None).cast("string")
    if not lanes:
        return every.select("artifact", empty.alias("lane"), F.lit("refuse").alias("decision"), F.lit("no-lane").alias("reason"), empty.alias("closest"), empty.alias("component"), empty.alias("tensor"), empty.alias("note"))
    rows = every.join(large(stamps.select("artifact", F.col("layout").alias("stamp"), F.col("reason").alias("unstamped"))), "artifact", "left").join(large(admitted.select("artifact", "lane", "decision", F.col("reason").alias("why"))), "artifact", "left")
    open_ = F.col("stamp").isNull() | (F.col("why") == "no-bridge")
    near = closest_lane(headers, layouts, lanes).select("artifact", F.col("layout").alias("closest"), F.col("reason").alias("near"), "component", "tensor")
    rows = rows.join(large(near), "artifact", "left")
    return rows.select(
        "artifact", F.when(F.col("stamp").isNotNull(), F.col("lane")).alias("lane"), F.when(F.col("stamp").isNull(), "refuse").otherwise(F.coalesce("decision", F.lit("refuse"))).alias("decision"),
        F.when(open_, F.coalesce("near", "unstamped", F.lit("unrelated"))).otherwise(F.col("why")).alias("reason"), *(F.when(open_, F.col(c)).alias(c) for c in ("closest", "component", "tensor")), F.when(F.col("why") == "no-bridge", F.col("stamp")).alias("note"),
    )


LOSSY = 4  # the tier of what can't be undone


# ---- derivations -------------------------------------------------------------------------------------------------------


def routes(edges: list[tuple[str, str, str, int]]) -> list[tuple[str, str, list[str], int, int]]:
    """(source, target, steps, tier sum, greatest tier) of the route with fewest hops between any two topologies, neighbours by the
    morphism's name. The catalogue of morphisms is small and already on the driver."""
    ahead = defaultdict(list)
    for a, b, name, tier in edges:
        ahead[a].append((name, b, tier))
    out = []
    for start in sorted({x for e in edges for x in e[:2]}):
        seen, todo = {start}, deque([(start, [], 0, 0)])
        while todo:
            at, steps, cost, worst = todo.popleft()
            out.append((start, at, steps, cost, worst))
            for name, to, tier in sorted(ahead[at]):
                if to not in seen:
                    seen.add(to)
                    todo.append((to, [*steps, name], cost + tier, max(worst, tier)))
    return out


def requant(source: Column, target: Column, source_transforms: Column, target_transforms: Column, source_inverse: Column) -> Column:
    """struct(step, tier, reason) between two rules; a transforming rule can be left only by its inverse."""
    step = F.when(source == target, F.lit("none")).when(~source_transforms & ~target_transforms, "cast").when(~source_transforms, "quantize").when(~target_transforms, "dequantize").otherwise("requantize")
    refused = (source != target) & source_transforms & ~source_inverse
    return F.struct(F.when(~refused, step).alias("step"), F.when(refused | (source == target), F.lit(0)).otherwise(4).alias("tier"), F.when(refused, "no-inverse").alias("reason"))


def relayout(source: Column, target: Column, source_record: Column, target_record: Column) -> Column:
    """struct(step, tier, reason) between two arrangements; records are struct(rank, candidate), rank 0 fitting any."""
    reason = (
        F.when(source == target, F.lit(None)).when(source_record.isNull() | target_record.isNull(), "no-record").when(source_record["candidate"] | target_record["candidate"], "candidate")
        .when((source_record["rank"] != 0) & (target_record["rank"] != 0) & (source_record["rank"] != target_record["rank"]), "rank")
    )
    same = source == target
    return F.struct(F.when(~same & reason.isNull(), F.concat_ws(">", source, target)).alias("step"), F.when(same | reason.isNotNull(), 0).otherwise(3).alias("tier"), reason.alias("reason"))


def admit(stamps: DataFrame, lanes: DataFrame, routes_: DataFrame, rules: DataFrame, arrangements: DataFrame) -> DataFrame:
    """(artifact, lane, decision, cost, hops, steps, lossy, reason): admitted as it is, by the cheapest derivation (the first
    lane of equal ones; its steps are the route's, the quantisation and the arrangement; it is lossy if one of them is of the
    highest tier), or refused.

    stamps: artifact, topology, quant, arrangement; lanes: lane, lane_ord and the same three; routes_: source, target, hops,
    steps, cost, worst; rules: quant, transforms, inverse; arrangements: arrangement, rank, candidate. All but the stamps are
    catalogue tables, so they go to the stamps: a topology's lanes as one array, of which each stamp takes the least."""
    r = routes_.where("source <> target").select(F.col("source").alias("s_topology"), F.col("target").alias("topology"), F.col("hops").cast("int").alias("hops"), F.col("cost").cast("long").alias("route_cost"), "steps", F.col("worst").cast("int").alias("worst"))
    own = lanes.select(F.col("topology").alias("s_topology"), "topology").distinct().select("s_topology", "topology", F.lit(0).alias("hops"), F.lit(0).cast("long").alias("route_cost"), F.array().cast("array<string>").alias("steps"), F.lit(0).alias("worst"))
    rule = rules.select("quant", F.struct("transforms", "inverse").alias("rule"))
    record = arrangements.select("arrangement", F.struct("rank", "candidate").alias("record"))
    offered = r.unionByName(own).join(lanes, "topology").join(rule, "quant").join(record, "arrangement", "left")
    offered = offered.groupBy("s_topology").agg(F.collect_list(F.struct("lane", "lane_ord", "hops", "route_cost", "worst", "steps", "quant", "rule", "arrangement", "record")).alias("offered"))
    s = stamps.select("artifact", *(F.col(c).alias(f"s_{c}") for c in ("topology", "quant", "arrangement")))
    for side, by in ((offered, "s_topology"), (rule.toDF("s_quant", "s_rule"), "s_quant"), (record.toDF("s_arrangement", "s_record"), "s_arrangement")):
        s = s.join(F.broadcast(side), by, "left")
    steps = lambda o: F.struct(
        o.alias("o"), requant(F.col("s_quant"), o["quant"], F.col("s_rule.transforms"), o["rule"]["transforms"], F.col("s_rule.inverse")).alias("q"), relayout(F.col("s_arrangement"), o["arrangement"], F.col("s_record"), o["record"]).alias("l")
    )

    def judged(p: Column) -> Column:
        o, q, l = p["o"], p["q"], p["l"]  # noqa: E741
        reason, cost = F.coalesce(q["reason"], l["reason"]), o["route_cost"] + q["tier"] + l["tier"]
        exact = (o["hops"] == 0) & (F.col("s_quant") == o["quant"]) & (F.col("s_arrangement") == o["arrangement"])
        others = F.array_compact(F.array(F.nullif(q["step"], F.lit("none")), l["step"]))
        order = [reason.isNotNull().alias("refused"), (~exact).alias("inexact"), cost.alias("cost"), o["lane_ord"].alias("lane_ord")]
        return F.struct(*order, o["lane"].alias("lane"), exact.alias("exact"), o["hops"].alias("hops"), F.greatest(q["tier"], l["tier"], o["worst"]).alias("worst"), F.concat(o["steps"], others).alias("steps"), reason.alias("reason"))

    known = F.col("artifact").isNotNull() & F.col("s_rule").isNotNull()
    s = s.select("artifact", F.when(known, F.array_min(F.transform(F.transform("offered", steps), judged))).alias("v"))
    best = s.select("artifact", F.min("v").over(Window.partitionBy("artifact")).alias("v"))
    good = F.col("v").isNotNull() & F.col("v.reason").isNull()
    return best.select(
        "artifact", F.when(good, F.col("v.lane")).alias("lane"), F.when(good, F.when(F.col("v.exact"), "admit").otherwise("derive")).otherwise("refuse").alias("decision"),
        F.when(good, F.col("v.cost")).alias("cost"), F.when(good, F.col("v.hops")).alias("hops"), F.when(good, F.col("v.steps")).alias("steps"), F.when(good, F.col("v.worst") == LOSSY).alias("lossy"), F.when(~good, F.coalesce(F.col("v.reason"), F.lit("no-bridge"))).alias("reason"),
    )


def refusal_text(reason: Column, member: Column, component: Column, tensor: Column) -> Column:
    """A sentence for an operator."""
    where = F.when(F.coalesce(component, F.lit("")) == "", "the checkpoint").otherwise(F.concat(F.lit("component "), component))
    return (
        F.when(reason.isNull(), F.lit(None)).when(reason == "missing", F.concat(where, F.lit(" lacks "), tensor)).when(reason == "unclaimed", F.concat(tensor, F.lit(" of "), member, F.lit(" is not declared by "), where))
        .when(reason == "duplicate", F.concat(tensor, F.lit(" of "), member, F.lit(" is there twice in "), where)).when(reason.isin("shape", "dtype"), F.concat(tensor, F.lit(" of "), member, F.lit(" differs in "), reason, F.lit(" from "), where))
        .otherwise(F.concat(F.lit("refused: "), reason))
    )


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
