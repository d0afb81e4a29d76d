"""Stops, recomputed features, versions, reused stages, mixed series, trees and pools against plain restatements."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import stops as T
from tessera.plans import catalog_ingest as C
from tessera.plans import query as Q
from tessera.sources import files as W
from tessera.sources import versions as V
from tessera.streaming import incremental as I


def some_rows():
    rng = np.random.default_rng(8)
    out = []
    for code in range(6):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.05, 40))
        open_ = np.r_[100, close[:-1]] * (1 + rng.normal(0, 0.01, 40))
        for i in range(40):
            ret = float(open_[i + 2] / open_[i + 1] - 1) if i < 38 else None
            out.append((code, i, dt.date(2020, 1, 1) + dt.timedelta(i), i, float(open_[i]), float(min(open_[i], close[i]) * 0.99), float(close[i]), bool(rng.random() < 0.8), ret, bool(rng.random() < 0.3)))
    return out


STOPS = [("none", 9.0), ("close", 0.05), ("intraday", 0.05), ("close", 0.1), ("intraday", 0.1)]
HOLD = 5


def stopped_by_hand(rows, kind, level):
    """Trades (gross, ended) and, by day, (sum, open positions, positions without a stop)."""
    by = {(r[0], r[1]): r for r in rows}
    sell = lambda c, i: next((by[c, k][4] for k in range(i, 40) if by[c, k][7]), None)
    trades, days = [], np.zeros((40, 3))
    for c, i, *_, signal in rows:
        if not signal or i + 1 + HOLD >= 40 or sell(c, i + 1 + HOLD) is None:
            continue
        entry, end, part, gross, hit = by[c, i + 1][4], HOLD, None, None, None
        line = entry * (1 - level) * (1 + 1e-9)
        for j in range(HOLD):
            _, _, _, _, open_, low, close, *_ = by[c, i + 1 + j]
            if (close if kind == "close" else min(open_, low)) <= line:
                hit, end = j, j + 1 if kind == "close" else j
                fill = open_ if open_ <= line else entry * (1 - level)
                if kind == "intraday":
                    part, gross = fill / open_ - 1, fill / entry - 1
                break
        trades.append((sell(c, i + 1 + end) / entry - 1 if gross is None else gross, hit is not None))
        for j in range(HOLD):
            x = by[c, i + j][8] if j < end else part if j == hit else None
            days[i + j] += (x or 0, x is not None, 1)
    return trades, days


def test_stops_end_each_position_on_its_own_path(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "code long, row long, date date, day long, open double, low double, close double, can_sell boolean, oret_sig double, signal boolean")
    from pyspark.sql import Window

    from tessera.operators.indicators import first_sellable_open

    own = Window.partitionBy("code").orderBy("date")
    df = df.withColumn("so", first_sellable_open(df)).withColumn("r", F.lead("so", 1 + HOLD).over(own) / F.lead("open").over(own) - 1).drop("so")
    days = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(i)) for i in range(40)], "day long, date date")
    cells = T.stop_cells(df, HOLD, STOPS)
    trades = {(r.kind, r.level): r for r in T.stop_trades(cells, STOPS).collect()}
    daily = {(r.kind, r.level, r.day): r for r in T.stop_daily(cells, days, HOLD, STOPS).collect()}
    for kind, level in STOPS:
        want, by_day = stopped_by_hand(rows, kind, level)
        got = trades[kind, level]
        assert got.n_trade == len(want) and abs(got.stopped - np.mean([h for _, h in want])) < 1e-12
        assert abs(got.mean - np.mean([g - T.COST for g, _ in want])) < 1e-12
        for d in range(40):
            s, n, every = by_day[d]
            x = daily[kind, level, d]
            assert x.n == n and abs(x.ret - ((s - n * T.COST / HOLD) / n if n else 0)) < 1e-12 and abs(x.fixed - ((s - n * T.COST / HOLD) / every if every else 0)) < 1e-12
    assert 0 < trades["close", 0.1].stopped < trades["close", 0.05].stopped


def features(spark, rows):
    return C.across(C.along(spark.createDataFrame(rows, "code int, date date, close double")))


def test_recompute_equals_all_anew_and_leaves_other_months(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    start = dt.date(2020, 1, 1)
    rows = [(c, start + dt.timedelta(d), float(rng.uniform(50, 150))) for c in range(5) for d in range(0, 900, 3 + c)]
    day = start + dt.timedelta(420)
    change = {r[:2]: r[2] * 1.5 for r in rows if r[0] == 1 and day <= r[1] < day + dt.timedelta(20)}
    new = [(7, start + dt.timedelta(500), 77.0)]  # an entity that was not there
    later = [(c, d, change.get((c, d), x)) for c, d, x in rows] + new
    root = f"{tmp_path}/features"
    I.write_periods(features(spark, rows), root)
    before = {p.name: {f.name for f in p.glob("part-*")} for p in (tmp_path / "features").glob("month=*")}
    changed = spark.createDataFrame([*change, *(r[:2] for r in new)], "code int, date date")
    got = I.recompute(root, spark.createDataFrame(later, "code int, date date, close double"), changed, C.DEPTH, C.along, C.across).collect()[0]
    after = {p.name: {f.name for f in p.glob("part-*")} for p in (tmp_path / "features").glob("month=*")}
    want = features(spark, later)
    assert sorted(map(tuple, I.read_periods(spark, root).select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    same = sum(before[m] == after[m] for m in before)
    assert same == got.of_months - got.n_months and 8 < same < 25 and got.n_along < got.n_read < got.n_rows / 3


def test_readers_see_whole_versions_only(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert V.current(spark, root) is None
    for n in (3, 5, 7):
        V.publish(spark.range(n), root, keep=2)
        spark.range(100).write.parquet(f"{root}/version=torn{n}")
        assert V.current(spark, root).count() == n
    assert len([p for p in (tmp_path / "t").glob("version=*") if "torn" not in p.name]) == 2
    assert [v.seq for v in V.versions(spark, root)] == [3, 2, 1]


def test_fingerprints_follow_files(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    spark.range(3).write.parquet(path)
    one = V.fingerprint(spark, [path])
    assert one == V.fingerprint(spark, [path])
    spark.range(3).write.mode("append").parquet(path)
    assert V.fingerprint(spark, [path]) != one


def test_series_of_mixed_shape(spark, tmp_path):
    docs = [
        {"series": 1, "klines": [{"date_ms": 1704067200000, "close_price": 1.5}, [1704153600000, 0, 0, 0, 2.5], ["2024-01-03", 0, 0, 0, 3], {"day": "2024-01-03 00:00", "c": 4}]},
        {"series": 2, "klines": []},
        {"series": 3, "klines": [{"date": "2024-02-01", "close": None}, {"date": None, "close": 2}]},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, docs)))
    got = sorted(((r.series, str(r.date), r.close) for r in W.read_mixed_series(spark, f"file://{tmp_path}/x.json").collect()), key=str)
    assert got == [(1, "2024-01-01", 1.5), (1, "2024-01-02", 2.5), (1, "2024-01-03", 4.0), (3, "2024-02-01", None), (3, "None", 2.0)]


def test_tree_keeps_what_is_there_and_loses_nothing(spark, tmp_path):
    tree = {"groups": [{"code": 1, "name": "g", "subs": ["a", "b", "zz"]}, {"code": 2, "name": "h", "subs": ["zz"]}], "absent": [{"code": 3, "name": "k", "why": "w"}]}
    (tmp_path / "t.json").write_text(json.dumps(tree, indent=1))
    day = lambda n: dt.date(2020, 1, n)
    rows = spark.createDataFrame([(1, day(1), "a"), (1, day(2), "a"), (2, day(2), "a"), (3, day(1), "b"), (4, day(2), "c")], "code int, date date, name string")
    got = sorted(map(tuple, W.grouped_members(W.read_tree(spark, f"file://{tmp_path}/t.json"), rows, "name").collect()))
    assert got == [("absent", 3, "k", 0, 0, None), ("group", 1, "g", 2, 2, "a,b"), ("unlisted", None, "c", 1, 1, "c")]


def test_pool_of_free_text(spark):
    df = spark.createDataFrame([("600000.SH",), ("600000.SZ",), ("000001.SZ",), ("AB",)], "code string")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert sorted(r.code for r in Q.in_text_pool(df, texts(" 600000，ab ", "x;y", None)).collect()) == ["600000.SH", "600000.SZ", "AB"]
    for text in (" ，", "999999"):
        with pytest.raises(ValueError):
            Q.in_text_pool(df, texts(text))
