"""Primitives along time against pandas, on short series with holes, ties and neighbours."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import asof as A
from tessera.operators import cross as X
from tessera.operators import indicators as I
from tessera.operators import capacity as K
from tessera.operators import simulate as D
from tessera.plans import query as Q
from tessera.sources import panel as P
from tessera.streaming import incremental as N


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code, n in ((1, 90), (2, 40)):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
        rows += [(code, d, float(c * 0.999), float(c * 1.01), float(c * 0.98), float(c), float(v)) for d, c, v in zip(days(n), close, rng.integers(1, 50, n))]
    return spark.createDataFrame(rows, "code int, date date, open double, high double, low double, close double, volume double")


def pdf(df, *cols):
    return df.select("code", "date", *cols).toPandas().sort_values(["code", "date"]).reset_index(drop=True)


def by_code(frame, f):
    return pd.concat([f(g) for _, g in frame.groupby("code")]).reset_index(drop=True)


def test_rolling_full_and_past(two):
    got = pdf(two, "close", C.rolling(F.stddev_samp, "close", 10).alias("sd"), C.rolling(F.max, "close", 5, past=True).alias("mx"), C.rolling(C.median, "close", 6).alias("med"))
    np.testing.assert_allclose(got.sd, by_code(got, lambda g: g.close.rolling(10).std()), rtol=1e-9)
    np.testing.assert_allclose(got.mx, by_code(got, lambda g: g.close.shift(1).rolling(5).max()), rtol=1e-12)
    np.testing.assert_allclose(got.med, by_code(got, lambda g: g.close.rolling(6).median()), rtol=1e-12)


def test_ewm_equals_recursive_mean(two):
    got = pdf(two, "close", C.ewm("close", 12).alias("e"))
    np.testing.assert_allclose(got.e, by_code(got, lambda g: g.close.ewm(span=12, adjust=False).mean()), rtol=1e-12)


def test_ewm_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(code, d, float(x)) for code, n in ((1, 900), (2, 181), (3, 182), (4, 1)) for d, x in zip(days(n), rng.normal(0, 5, n))]
    df = spark.createDataFrame(rows, "code int, date date, x double")
    got = pdf(df, "x", *(C.ewm("x", n).alias(f"e{n}") for n in (2, 9, 26)))
    for n in (2, 9, 26):
        np.testing.assert_allclose(got[f"e{n}"], by_code(got, lambda g: g.x.ewm(span=n, adjust=False).mean()), rtol=1e-9, atol=1e-12)


def test_streak_counts_runs(spark):
    df = spark.createDataFrame([(1, d, x) for d, x in zip(days(8), [1, 2, 3, 2, 3, None, 4, 5])], "code int, date date, x int")
    got = pdf(df, C.streak(F.col("x") > C.lag("x")).alias("s"))
    assert got.s.tolist() == [0, 1, 2, 0, 1, 0, 0, 1]


def test_rank_pct_ties_nulls_and_edges(spark):
    values = [5.0, 1.0, 1.0, None, 3.0, 9.0]
    df = spark.createDataFrame([(i, days(1)[0], v) for i, v in enumerate(values)], "code int, date date, v double")
    got = pdf(df, "v", C.rank_pct("v", ["date"]).alias("p"))
    np.testing.assert_allclose(got.p, got.v.rank(pct=True))
    edge = spark.range(1, 11).select(C.bins(F.col("id") / 10).alias("b"))
    assert [r.b for r in edge.collect()] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 10]  # an exact edge goes up


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = P.normalised(df, ["x"], {"y": "string"})
    assert [r.x for r in got.collect()] == [1.0, None, None, None] and got.columns == ["x", "y"]
    with pytest.raises(ValueError):
        P.normalised(df, ["z"], {})


def test_limit_regime_ties_give_the_first(spark):
    rows = [(1, d, 100.0, 100.5, 99.5, 100.0) for d in days(130)]
    df = spark.createDataFrame(rows, "code int, date date, open double, high double, low double, close double")
    got = pdf(I.limit_regime(df, F.lit(0.1)), "limit_pct", "limit_up_px", "can_buy_open")
    assert got.limit_pct.iloc[0] == 0.1 and got.limit_pct.iloc[-1] == 0.05  # too few rows: the default; no touch: the first
    assert got.limit_up_px.iloc[-1] == 105.0 and bool(got.can_buy_open.iloc[-1]) and not bool(got.can_buy_open.iloc[0])


def test_true_range_has_no_first_row(two):
    got = pdf(I.ranges(two.withColumn("ret", F.col("close") / C.lag("close") - 1)), "tr", "atr14")
    assert got.groupby("code").tr.first().notna().all() and got.groupby("code").head(1).tr.isna().all()


def test_first_sellable_open_waits(spark):
    df = spark.createDataFrame([(1, d, float(i), s) for i, (d, s) in enumerate(zip(days(5), [True, False, False, True, False]))], "code int, date date, open double, can_sell boolean")
    got = pdf(df, I.first_sellable_open(df).alias("s"))
    assert got.s.tolist()[:4] == [0.0, 3.0, 3.0, 3.0] and np.isnan(got.s.iloc[4])


def test_divergence_hand_case(spark):
    n = 80
    low = np.full(n, 50.0)
    low[:60] = np.linspace(60, 50.5, 60)
    low[65], low[75] = 45.0, 44.0
    dif = np.zeros(n)
    dif[65], dif[75] = -3.0, -1.0
    df = spark.createDataFrame([(1, d, float(x), float(x + 1), float(f)) for d, x, f in zip(days(n), low, dif)], "code int, date date, low double, high double, dif double")
    got = pdf(I.divergence(df), "dv_bull", "dv_bear")
    assert got.index[got.dv_bull].tolist() == [75]


def test_volume_score_at_an_edge_of_its_bins(spark):
    # scores of exactly -1, -1 and 1, which doubles put at -1.0000000000000002 or 0.9999999999999998
    cases = [
        ([70, 44, 37, 78, 39, 77, 39, 10, 69, 124, 81, 74, 130, 14, 48, 27, 58, 28, 81, 52, 27], -1, 1),
        ([31, 25, 33, 93, 7, 89, 2, 50, 13, 32, 92, 35, 10, 36, 73, 62, 8, 33, 33, 83, 12], -1, 1),
        ([21, 82, 50, 39, 67, 68, 6, 85, 114, 46, 114, 108, 73, 33, 41, 51, 114, 38, 36, 14, 94], 1, 3),
    ]
    for volumes, score, _ in cases:
        past, now = volumes[:-1], volumes[-1]
        assert len(past) == 20 and 19 * (20 * now - sum(past)) ** 2 == 20 * (20 * sum(v * v for v in past) - sum(past) ** 2) and (20 * now > sum(past)) == (score > 0)
    df = spark.createDataFrame([(i, d, float(v)) for i, (volumes, _, _) in enumerate(cases) for d, v in zip(days(21), volumes)], "code int, date date, volume double")
    got = pdf(I.volume_trend(df), "volz20", "volz_bin").groupby("code").tail(1)
    np.testing.assert_allclose(got.volz20, [c[1] for c in cases], rtol=1e-12)
    assert got.volz_bin.tolist() == [c[2] for c in cases]


def test_asof_join_matches_merge_asof(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"code": rng.integers(0, 5, 200), "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 300, 200), "D")}).drop_duplicates()
    right = pd.DataFrame({"code": rng.integers(0, 4, 60), "at": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 300, 60), "D")}).drop_duplicates()
    right["v"] = np.arange(len(right), dtype=float)
    for strict in (False, True):
        want = pd.merge_asof(left.sort_values("date"), right.sort_values("at"), left_on="date", right_on="at", by="code", allow_exact_matches=not strict).sort_values(["code", "date"])
        got = A.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "code", "date", "at", strict).toPandas().sort_values(["code", "date"])
        np.testing.assert_array_equal(got.v.to_numpy(), want.v.to_numpy())


def test_adjustment_applies_before_the_ex_date(spark):
    bars = spark.createDataFrame([(1, d, 10.0, 10.0, 10.0, 10.0, 100.0) for d in days(4)], "code int, date date, open double, high double, low double, close double, volume double")
    ratios = spark.createDataFrame([(1, days(4)[2], 0.5)], "code int, ex_date date, ratio double")
    got = pdf(A.adjusted(bars, ratios), "adj_factor", "close", "volume")
    assert got.adj_factor.tolist() == [0.5, 0.5, 1.0, 1.0] and got.volume.tolist() == [200.0, 200.0, 100.0, 100.0]


def test_market_states_unformed_average_is_bear(spark):
    rows = [(c, d, i, 0.01, c % 10) for c in range(10) for i, d in enumerate(days(30))]
    df = spark.createDataFrame(rows, "code int, date date, day int, ret double, size_grp int")
    got = X.market_states(df).where("index = 'all' AND ma_len = 20").orderBy("day").toPandas()
    assert not got.bull.iloc[:19].any() and got.bull.iloc[19:].all()


def test_union_latest_is_idempotent(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "k int, d int, v int")
    b = spark.createDataFrame([(1, 2, 25), (1, 3, 30)], "k int, d int, v int")
    once = N.merge(a, b, ["k", "d"], ["v"])
    twice = N.merge(once, b, ["k", "d"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, 10), (1, 2, 25), (1, 3, 30)]


def test_normalisers():
    assert Q.size_band(7, 2) == (2, 7) and Q.size_band(None, None) is None and Q.size_band(-3, 4.4) == (0, 4)
    assert Q.ladder_steps("1, 2;2/3") == (1, 2, 2, 3) and Q.ladder_steps("1,0") is None and Q.ladder_steps("x") is None
    assert Q.code_list("600000，000001.sz") == ["600000.SH", "600000.SZ", "000001.SZ"]
    with pytest.raises(ValueError):
        Q.code_list("  ")
    with pytest.raises(ValueError):
        Q.predicate(Q.Params(ranges={"nothing": (1, 2)}))


# ---- the planner ---------------------------------------------------------------------------------------------------


def planned(spark, rows, **how):
    df = spark.createDataFrame([("s", c, d, 0, k) for c, d, k in rows], "scenario string, code long, day long, row long, key double")
    hold = how.pop("hold")
    return sorted((r.entry_day, r.exit_day, r.code, r.weight) for r in K.plan(df, hold, K.Rhythm(**how)).collect())


def test_plan_skips_held_names_and_frees_places(spark):
    got = planned(spark, [(1, 0, 1.0), (2, 0, 2.0), (3, 0, 3.0), (1, 1, 1.0), (2, 1, 2.0), (3, 1, 3.0), (4, 6, None), (5, 6, 9.0)], hold=5, places=2, new=1)
    assert [(e, x, c) for e, x, c, _ in got] == [(1, 6, 1), (2, 7, 2), (7, 12, 5)]  # name 1 is held on day 1; of day 6, the known key first


def test_ladder_fills_steps(spark):
    rows = [(10 * d + i, d, float(i)) for d in range(6) for i in range(5)]
    got = planned(spark, rows, hold=100, ladder=(1, 1, 2, 2, 3, 3))
    per_day = pd.Series([e for e, *_ in got]).value_counts().sort_index().tolist()
    assert per_day == [1, 1, 2, 2, 3, 3] and all(abs(w - 1 / 12) < 1e-12 for *_, w in got) and all(x - e == 100 for e, x, *_ in got)


def test_even_ladder_is_equal_weight(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), d, float(rng.random())) for d in range(60) for c in rng.choice(40, 14, replace=False)]  # enough for every step
    a = planned(spark, rows, hold=7, ladder=(2, 2, 2, 2, 2))
    b = planned(spark, rows, hold=7, places=10, new=2)
    assert [x[:3] for x in a] == [x[:3] for x in b]


def test_identity_of_signals(spark):
    df = spark.createDataFrame([(1, d, 10.0 + i, i != 3, True, i) for i, d in enumerate(days(12))], "code int, date date, open double, can_buy boolean, can_sell boolean, day int")
    states = D.with_fills(df, 4).select(D.open_state().alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] for r in states}
    assert sum(n.values()) == 12 and n["nobuy"] == 1 and n["pending"] == 1


def test_annual_stats(spark):
    r = [0.01, -0.02, 0.03, 0.0]
    df = spark.createDataFrame([(i, d, x, float(np.prod([1 + y for y in r[: i + 1]]))) for i, (d, x) in enumerate(zip(days(4), r))], "day int, date date, ret double, nav double")
    got = D.annual_stats(df).collect()[0]
    assert abs(got.cagr - (np.prod([1 + x for x in r]) ** (252 / 4) - 1)) < 1e-9 and abs(got.mdd + 0.02) < 1e-12
    assert abs(got.sharpe - np.mean(r) / np.std(r, ddof=1) * 252**0.5) < 1e-9


def test_stops(spark):
    px = [10.0, 10.0, 9.0, 8.0, 12.0, 13.0, 14.0, 15.0]
    df = spark.createDataFrame([(1, i, d, x, x + 0.1, x - 0.1, x) for i, (d, x) in enumerate(zip(days(8), px))], "code int, row int, date date, open double, high double, low double, close double")
    got = D.with_bars(df, 3).select("date", D.stop_return(3, 0.1, "close").alias("c"), D.stop_return(3, 0.1, "intraday").alias("i")).orderBy("date").collect()
    assert abs(got[0].c - (8 / 10 - 1)) < 1e-9  # close of row 2 is at the line, sold at the open of row 3
    assert abs(got[0].i + 0.1) < 1e-9  # the open of row 2 is at the line


def test_trade_page_filters_orders_and_clamps(spark):
    rows = [(i, dt.date(2020, 1, 1), dt.date(2020 + i % 2, 2, 1), dt.date(2020, 3, 1 + i), (i - 3) / 10, None if i == 2 else -i / 10) for i in range(7)]
    df = spark.createDataFrame(rows, "code int, date date, entry_date date, exit_date date, net double, excess double")
    codes = lambda d: [r.code for r in d.collect()]
    assert codes(D.trade_page(df, size=3)) == [6, 5, 4]  # latest exits first
    assert codes(D.trade_page(df, "excess", "asc", page=1, size=0)) == [6]
    assert codes(D.trade_page(df, "excess", "desc", size=2)) == [2, 0] and codes(D.trade_page(df, "excess", "asc", page=9, size=4)) == [1, 0, 2]
    assert codes(D.trade_page(df, "unknown", page=-1, size=2)) == [6, 5]
    assert sorted(codes(D.filtered_trades(df, win=True))) == [4, 5, 6] and sorted(codes(D.filtered_trades(df, win=False, year=2020))) == [0, 2]
    assert sorted(codes(D.filtered_trades(df, least=-0.1, most=0.1))) == [2, 3, 4] and codes(D.filtered_trades(df, code=5)) == [5]
    assert codes(D.trade_page(df.where("code > 99"))) == []


def test_correlations_of_what_does_not_vary(spark):
    """A day on which a factor or the target stands still has no coefficient, and stops nothing."""
    rng = np.random.default_rng(4)
    rows = [(d, c, float(rng.normal()), 1.0 if d == 1 else float(rng.normal()), 2.0 if d == 2 else float(rng.normal())) for d in range(4) for c in range(40)]
    df = spark.createDataFrame(rows, "day long, code long, a double, b double, y double")
    ic = {(r.factor, r.day): r.ic for r in X.daily_ic(df, ["a", "b"], "y").collect()}
    assert {k for k, v in ic.items() if v is None} == {("b", 1), ("a", 2), ("b", 2)} and len(ic) == 8
    assert {r.factor: r.days for r in X.fama_macbeth(df, ["a", "b"], "y").collect()} == {"a": 3, "b": 3}
    x, y = ([r[i] for r in rows] for i in (2, 4))
    gap = df.unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double")))
    assert abs(gap.agg(C.correlation("a", "y").alias("r")).first().r - np.corrcoef(x, y)[0, 1]) < 1e-12
