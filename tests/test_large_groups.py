"""Exact percentiles without gathering a group's values."""

import random

from pyspark.sql import functions as F

from tessera.operators import simulate as D
from tessera.operators.cross import quantiles, with_quantiles

AT = {"p10": 0.1, "med": 0.5, "p75": 0.75, "top": 1.0}


def test_quantiles_equal_percentile(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i % 3, rng.choice([None, 0.25, -3.5, round(rng.gauss(0, 0.2), 4), rng.gauss(0, 1e-6)])) for i in range(3000)]
    rows += [("one", 0, 1.5), ("two", 1, 1.0), ("two", 1, 2.0), ("none", 2, None)]
    df = spark.createDataFrame(rows, "k string, h int, v double")
    want = {(r.k, r.h): r for r in df.groupBy("k", "h").agg(F.count("v").alias("n"), *(F.percentile("v", p).alias(k) for k, p in AT.items())).collect()}
    got = with_quantiles(df.groupBy("k", "h").agg(F.count("v").alias("n")), df, ["k", "h"], "v", AT).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.k, r.h]
        assert all((r[c] is None and w[c] is None) or abs(r[c] - w[c]) < 1e-12 for c in AT) and r.n == w.n
    assert [r.top for r in quantiles(df, [], "v", AT).collect()] == [df.agg(F.max("v")).first()[0]]
    assert quantiles(df.where("v > 99"), ["k"], "v", AT).count() == 0


def test_statistics_of_trades_gather_no_values(spark):
    df = spark.createDataFrame([(i % 7, None if i % 5 == 0 else (i % 11 - 4) / 100) for i in range(200)], "code int, net double")
    out = D.trade_stats(df)
    assert "percentile(" not in out._jdf.queryExecution().toString()
    w, r = df.agg(*(F.percentile("net", p).alias(k) for k, p in {"median": 0.5, "p10": 0.1, "p90": 0.9}.items())).first(), out.first()
    assert all(abs(r[k] - w[k]) < 1e-12 for k in w.asDict()) and r.n == 160


def test_shuffle_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    from tessera.sources import versions as V

    spark.range(20000).selectExpr("id", "uuid() AS s").coalesce(1).write.parquet(f"{tmp_path}/t")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert V.spread(spark, [f"{tmp_path}/t"]) == session
    monkeypatch.setattr(V, "PARTITION_BYTES", 10_000)
    assert V.spread(spark, [f"{tmp_path}/t"]) > 10 * session
    monkeypatch.undo()
    V.spread(spark, [f"{tmp_path}/t"])


def test_bins_come_from_bounds_and_no_window_sees_a_period(spark):
    from tessera.functions.columns import bins, rank_pct
    from tessera.operators import cross as X

    rng = random.Random(5)
    rows = [(i, day, rng.choice([None, 0.0, -0.0, 0.25, 0.25, rng.gauss(0, 1)]), rng.choice([None, float(rng.randrange(4))]), rng.gauss(0, 1)) for day in ("2024-01-01", "2024-01-08") for i in range(150)]
    rows += [(1, "2024-01-15", 2.0, None, 1.0), (2, "2024-01-15", None, None, None), (1, None, 3.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "code int, date string, a double, b double, amt20_lag double").withColumn("date", F.col("date").cast("date"))
    out = X.with_deciles(df, ("a", "b"))
    assert out.columns == [*df.columns, "d_a", "d_b", "size_grp"]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    ranked = [bins(rank_pct(c, ["date"])) for c in ("a", "b", "amt20_lag")]
    want = df.select("code", "date", ranked[0], ranked[1], ranked[2] - 1)
    assert sorted(map(str, map(tuple, out.select("code", "date", "d_a", "d_b", "size_grp").collect()))) == sorted(str(tuple(r)) for r in want.collect())


def test_merged_partitions_are_small(spark, tmp_path):
    from tessera.sources import versions as V

    spark.range(10).write.parquet(f"{tmp_path}/t")
    V.spread(spark, [f"{tmp_path}/t"])
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) <= 1 << 20


def test_factor_days_equal_windows(spark):
    from tessera.functions.columns import correlation, rank_pct
    from tessera.operators import cross as X
    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [(day, code, (day + code) % 3 == 0 if day == 2 else day == 1, rng.choice([None, 0.5, rng.gauss(0, 1)]), rng.choice([None, 1.0, 2.0, rng.gauss(0, 1)]), 1.0 if code < 80 else None) for day in range(4) for code in range(100 if day else 20)]
    df = spark.createDataFrame(rows, "day long, code long, bull boolean, y double, a double, flat double")
    out = X.factor_days(df, ("a", "flat"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    day = Window.partitionBy("day")
    some = df.where("y IS NOT NULL AND a IS NOT NULL")
    some = some.withColumns({"n": F.count("*").over(day), "rk": F.row_number().over(day.orderBy("a", "code")), "rx": rank_pct("a", ["day"]), "ry": rank_pct("y", ["day"])}).where("n >= 30")
    some = some.withColumn("q", F.least(F.lit(4), F.floor((F.col("rk") - 1) * 5.0 / F.col("n"))))
    want = {(r.day, r.bull): r for r in some.groupBy("day", "bull").agg(correlation("rx", "ry").alias("ic"), F.count("*").alias("k"), *(F.sum(F.when(F.col("q") == i, F.col("y"))).alias(f"s{i}") for i in range(5)), *(F.count_if(F.col("q") == i).alias(f"c{i}") for i in range(5))).collect()}
    got = {(r.day, r.bull): r for r in out.where("factor = 'a'").collect()}
    assert got.keys() == want.keys() and got
    for k, r in got.items():
        assert r.k == want[k].k and abs(r.ic - want[k].ic) < 1e-12 and all(r[f"c{i}"] == want[k][f"c{i}"] and abs(r[f"s{i}"] - (want[k][f"s{i}"] or 0)) < 1e-9 for i in range(5))
    assert {r.ic for r in out.where("factor = 'flat'").collect()} <= {None}


def test_random_orders_are_ranked_where_a_day_lies(spark):
    import os

    import pytest

    from tessera.plans import catalog_evidence as E
    from tessera.plans.catalog_strategy import prepared

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    first = E._contested(spark, folder, prepared(spark, folder))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS, [plan_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    most = first.groupBy("scenario", "day").count().agg(F.max("count"), F.countDistinct("scenario")).first()
    assert most[0] <= 12 and most[1] == 4 + E.DRAWS
