"""Exact quantiles (linear interpolation) by narrowing, with bounded memory per task.

Spark's exact ``percentile`` merges a value->count map per group in one task, which
for a continuous column grows with the data. Here a value's rank is found by counting.
``order_key`` cuts all doubles into ranges that don't depend on the data:

1. count the values of each group by range, and take the range each target rank lies in;
2. count the values inside these ranges by finer ones, all groups at once;
3. rank the distinct values of the last ranges, at most some 700,000 doubles each.

Each step is one scan with a partial aggregate; the ranges found (groups x ranks rows)
join the values of the next. They are broadcast for the ``GROUPS`` largest groups, a
bound that holds for any data. Of a table with more groups than that, each further one
holds under one in ``GROUPS`` of all rows: these are shuffled by group and ranked there.

Nothing runs while the query is built, and no value reaches the driver.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions.order import leading, order_key

#: Groups whose ranges are broadcast.
GROUPS = 10_000
#: Binary digits of a key that each step reads: at most 4 million ranges, each cut in as many.
STEPS = (22, 44)


def _counted(rows: DataFrame, own: list[str], into: Column) -> DataFrame:
    """For each ``own``: the counts (``_n``) by ``into`` (``_v``), in order, with the values before (``_before``)."""
    w = (Window.partitionBy(*own) if own else Window.partitionBy()).orderBy("_v")
    n = rows.groupBy(*own, into.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))


def _targets(counts: DataFrame, own: list[str], probs: Sequence[float]) -> DataFrame:
    """The rows of ``counts`` that hold target ranks, once for each: two for a probability, below its place and above."""
    every = Window.partitionBy(*own) if own else Window.partitionBy()
    ranks, total = [], F.col("_total")
    for i, p in enumerate(probs):
        low = F.floor(F.lit(p) * (total - 1)).cast("long")
        ranks += [F.struct(F.lit(2 * i).alias("_t"), low.alias("_rank")),
                  F.struct(F.lit(2 * i + 1).alias("_t"), F.least(low + 1, total - 1).alias("_rank"))]
    held = F.filter(F.array(*ranks), lambda r: (F.col("_before") <= r["_rank"]) & (r["_rank"] < F.col("_before") + F.col("_n")))
    whole = counts.withColumn("_total", F.sum("_n").over(every))
    return whole.select(*own, "_v", "_before", "_total", F.explode(held).alias("_r")).select(
        *own, "_v", "_total", "_r._t", (F.col("_r._rank") - F.col("_before")).alias("_rank"))


def _narrowed(keyed: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """keyed: (_by..., _x, _key); ranges: (own..., _v, _total, _t, _rank). The values at the target ranks: (own..., _total, _t, _x)."""
    kept = [*own, "_total", "_t", "_rank"]
    held = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    for done, step in zip(STEPS, [*STEPS[1:], None]):
        lies = reduce(lambda a, b: a & b, [F.col(f"_by{c}").eqNullSafe(F.col(c)) for c in own], leading(F.col("_key"), done) == F.col("_v"))
        inside = keyed.join(F.broadcast(ranges), lies).drop("_v")
        found = _counted(inside, kept, F.col("_x") if step is None else leading(F.col("_key"), step)).where(held)
        ranges = found.select(*own, "_v", "_total", "_t", (F.col("_rank") - F.col("_before")).alias("_rank"))
    return ranges.select(*own, "_total", "_t", F.col("_v").alias("_x"))


def _picked(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], few_groups: bool) -> DataFrame:
    """The values at the target ranks, and the groups' sizes: (_g0..., _total, _t, _x)."""
    own = [f"_g{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    keyed = df.where(F.col(value).isNotNull()).select(
        *[F.col(c).alias(f"_by{g}") for c, g in zip(by, own)], x.alias("_x"), order_key(x).alias("_key"))
    named = [F.col(f"_by{g}").alias(g) for g in own]
    counts = _counted(keyed.select(*named, "_key"), own, leading(F.col("_key"), STEPS[0]))
    if not own or few_groups:
        return _narrowed(keyed, _targets(counts, own, probs), own)
    sizes = counts.groupBy(*own).agg(F.sum("_n").alias("_size"))
    largest = F.broadcast(sizes.orderBy(F.desc("_size"), *own).limit(GROUPS).select(*[F.col(g).alias(f"_top{g}") for g in own]))
    among = lambda side: reduce(lambda a, b: a & b, [F.col(side + g).eqNullSafe(F.col(f"_top{g}")) for g in own])
    found = _narrowed(keyed, _targets(counts.join(largest, among(""), "left_semi"), own, probs), own)
    others = keyed.join(largest, among("_by"), "left_anti").select(*named, "_x")
    ranked = _targets(_counted(others, own, F.col("_x")), own, probs)
    return found.unionByName(ranked.select(*own, "_total", "_t", F.col("_v").alias("_x")))


def quantile_columns(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                     by: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Exact quantiles, same as ``percentile`` (linear), a column per probability: (by..., names...).

    No row for a group without a value (without ``by``: one row of NULLs).
    ``few_groups``: the caller knows that there are at most ``GROUPS`` groups (a fixed
    vocabulary, column names), which saves the branch for more.
    """
    probs, own = [float(p) for p in probs], [f"_g{i}" for i in range(len(by))]
    ends = _picked(df, value, probs, by, few_groups).groupBy(*own).agg(F.first("_total").alias("_total"), *[
        F.max(F.when(F.col("_t") == t, F.col("_x"))).alias(f"_x{t}") for t in range(2 * len(probs))])
    out = [F.col(g).alias(c) for g, c in zip(own, by)]
    for i, (p, n) in enumerate(zip(probs, names)):
        place = F.lit(p) * (F.col("_total") - 1)
        a, b, part = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), place - F.floor(place)
        out.append(F.when((part == 0) | (a == b), a).otherwise(a * (1 - part) + b * part).alias(n))
    return ends.select(*out)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    few_groups: bool = False) -> DataFrame:
    """The same, long: (by..., p, value). No rows for a group without a value."""
    names = [f"_q{i}" for i in range(len(probs))]
    wide = quantile_columns(df, value, probs, names, by, few_groups)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(n).alias("value")) for p, n in zip(probs, names)])
    return wide.select(*by, F.explode(pairs).alias("_v")).select(*by, "_v.*").where(F.col("value").isNotNull())
