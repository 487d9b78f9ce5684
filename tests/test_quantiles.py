"""Exact quantiles by narrowing vs brute force (Spark's exact percentile)."""
import math

import pytest
from pyspark.sql import functions as F

import hydrolens.operators.quantiles as Q
from hydrolens.functions.order import leading, order_key
from hydrolens.operators.quantiles import exact_quantiles, quantile_columns

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(df, by):
    got = {tuple(r[c] for c in (*by, "p")): r.value for r in exact_quantiles(df, "v", PROBS, by).collect()}
    want = df.groupBy(*by).agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()
    assert len(got) == len(PROBS) * len(want)
    for row in want:
        for i, p in enumerate(PROBS):
            assert got[(*[row[c] for c in by], p)] == pytest.approx(row.q[i], rel=1e-12, abs=1e-14 * max(map(abs, row.q))), (row, p)


@pytest.mark.parametrize("groups", [2, 10_000])
def test_matches_percentile_with_ties_and_groups(spark, monkeypatch, groups):
    monkeypatch.setattr(Q, "GROUPS", groups)  # 2: two groups narrowed, the others ranked by group
    df = spark.range(9000).select(
        F.when(F.col("id") % 4 != 3, (F.col("id") % 4).cast("string")).alias("g"), (F.col("id") % 3 % 2).alias("h"),
        # one value in half the rows, plus a continuous part
        F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.sin(F.col("id")) * 1000).alias("v"))
    check(df, ["g"])
    check(df, ["g", "h"])


def test_fifty_thousand_groups(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("g"), (F.hash("id") / 7.0).alias("v"))
    check(df, ["g"])


@pytest.mark.parametrize("scale", [1.0, 1e-280, 1e290])
def test_any_scale_and_crowded_values(spark, scale):
    crowd = spark.range(3000).select((F.lit(scale) * (1 + F.col("id") * 1e-15)).alias("v"))
    df = crowd.unionByName(spark.createDataFrame([(x,) for x in (0.0, -0.0, -scale, scale, -1e308, 1e308, -3e-310)], "v double"))
    got = {r.p: r.value for r in exact_quantiles(df, "v", PROBS).collect()}
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).first().q
    assert [got[p] for p in PROBS] == pytest.approx(want, rel=1e-12, abs=0)


def test_nulls_infinities_and_nothing(spark):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in [5, 1, None, 3, 3, 9]], "v double")
    got = {r.p: r.value for r in exact_quantiles(df, "v", [0.0, 0.5, 0.75, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 3.0, 0.75: 5.0, 1.0: 9.0}
    assert exact_quantiles(df.where("v > 100"), "v", [0.5]).count() == 0
    ends = spark.createDataFrame([(x,) for x in (-math.inf, -math.inf, 1.0, math.inf, math.nan)], "v double")
    got = [r.value for r in exact_quantiles(ends, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).orderBy("p").collect()]
    assert got[:4] == [-math.inf, -math.inf, 1.0, math.inf] and math.isnan(got[4])


def test_keys_keep_the_order_of_doubles(spark):
    values = sorted({s * 10.0 ** e * m for s in (-1, 1) for e in range(-320, 308, 7) for m in (1, 1 + 1e-15, 1.5, 9.99)}
                    | {0.0, math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).orderBy("v").collect()
    keys = [r.k for r in rows]
    assert keys == sorted(keys) and len(set(keys)) > len(keys) / 3
    assert spark.range(1).select(leading(order_key(F.lit(1.0)), 22) == F.shiftright(order_key(F.lit(1.0)), 26)).first()[0]


def test_nothing_runs_while_a_query_is_built(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("built"))
    spark.sparkContext.setJobGroup("built", "")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"), F.col("id").alias("n"))
        quantile_columns(df, "v", [0.5], ["m"], ["g"])
        from hydrolens.operators.reports import describe_numeric
        describe_numeric(df, ["v", "n"])
        assert jobs() == 0
    finally:
        spark.sparkContext._jsc.clearJobGroup()
