"""Plans, their occupancy, the random control and the search against plain restatements."""

import datetime as dt
import hashlib

import numpy as np

from tessera.operators import capacity as K
from tessera.operators.cross import COST, YEAR
from tessera.plans import catalog_capacity as C
from tessera.plans.catalog_strategy import HOLD


def plain_plan(rows, hold, places, most):
    """(code, day) of what is bought, of (code, day, key), without a trim."""
    held, taken = {}, []
    for day in sorted({d for _, d, _ in rows}):
        held = {c: x for c, x in held.items() if x > day}
        want = min(places - len(held), most)
        for *_, code in sorted((k is None, k or 0.0, c) for c, d, k in rows if d == day):
            if want > 0 and code not in held:
                held[code] = day + 1 + hold
                taken.append((code, day))
                want -= 1
    return taken


def fixture():
    """Rows of 40 entities over 80 days without a gap: (code, day, row, return, signal, depth)."""
    rng = np.random.default_rng(4)
    signals = {(int(c), d): float(rng.integers(-20, 0)) for d in range(60) for c in rng.choice(40, int(rng.integers(0, 35)), replace=False)}
    return [(c, d, d, float(rng.normal(0, 0.02)) if d < 78 else None, (c, d) in signals, signals.get((c, d))) for c in range(40) for d in range(80)]


def tables(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, "code long, day long, row long, oret_sig double, signal boolean, px_ma60_pct double")
    days = spark.createDataFrame([(d, dt.date(2020, 1, 1) + dt.timedelta(d)) for d in range(80)], "day long, date date")
    monkeypatch.setattr(C, "_rows", lambda *_: df)
    monkeypatch.setattr(C, "_days", lambda *_: days)
    return df, days


def account(rows, bought, places):
    ret, path = np.zeros(80), {(c, d): x for c, d, _, x, *_ in rows}
    for code, day in bought:
        for j in range(HOLD):
            if path.get((code, day + j)) is not None:
                ret[day + j] += (path[code, day + j] - COST / HOLD) / places
    return ret


def test_random_control_draws_as_many_as_the_reference(spark, monkeypatch):
    rows = fixture()
    tables(spark, monkeypatch, rows)
    got = C.random_control(spark, "").collect()[0]
    signals = [(c, d, k) for c, d, _, _, s, k in rows if s]
    drawn = lambda seed: [(c, d, float(int(hashlib.md5(f"{c}|{d}|{seed}".encode()).hexdigest()[:12], 16))) for c, d, _ in signals]
    cagr = lambda order: np.prod(1 + account(rows, plain_plan(order, HOLD, 10, 2), 10)) ** (YEAR / 80) - 1
    own, all_ = cagr(signals), np.array([cagr(drawn(s)) for s in range(200)])
    assert got.n == 200
    want = {"own": own, "mean": all_.mean(), "sd": all_.std(ddof=1), "p05": np.percentile(all_, 5), "p95": np.percentile(all_, 95), "low": all_.min(), "high": all_.max(), "beaten": (all_ < own).mean(), "z": (own - all_.mean()) / all_.std(ddof=1)}
    for name, x in want.items():
        assert abs(got[name] - x) < 1.2e-5 if name == "z" else abs(got[name] - x) < 2e-6, name


def test_plans_carry_the_held_from_batch_to_batch(spark):
    rows = [(c, d, k) for c, d, _, _, s, k in fixture() if s]
    df = spark.createDataFrame([(n, i, c, d, d, k) for i, n in enumerate("abc") for c, d, k in rows], "scenario string, rhythm int, code long, day long, row long, key double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = K.plan(df, 9, [K.Rhythm(6, 2), K.Rhythm(new=1), K.Rhythm()]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for name, places, new in (("a", 6, 2), ("b", 1 << 30, 1), ("c", 1 << 30, 1 << 30)):
        assert sorted((r.code, r.day) for r in got if r.scenario == name) == sorted(plain_plan(rows, 9, places, new)), name
    assert {r.weight for r in got if r.scenario == "a"} == {1 / 6} and {r.exit_day - r.entry_day for r in got} == {9}


def test_occupancy_and_what_became_of_the_signals(spark, monkeypatch):
    rows = fixture()
    _, days = tables(spark, monkeypatch, rows)
    signals = [(c, d, k) for c, d, _, _, s, k in rows if s]
    bought = plain_plan(signals, HOLD, 10, 2)
    held = np.zeros(80, int)
    for _, day in bought:
        held[day : day + HOLD] += 1
    again = sum(any(c == x and day < d <= day + HOLD for x, day in bought) for c, d, _ in signals)
    got = next(r for r in C.capacity_occupancy(spark, "").collect() if r.scenario == "even")
    assert (got.n_signal, got.n_hold, got.n_drop, got.n_drop_dup) == (len(signals), len(bought), len(signals) - len(bought), again)
    assert abs(got.avg_pos - held[held > 0].mean()) < 2e-6 and got.max_pos == held.max() and abs(got.full_pct - (held == 10).mean()) < 2e-6 and abs(got.empty_pct - (held == 0).mean()) < 2e-6


def test_both_bases(spark, monkeypatch):
    rows = fixture()
    tables(spark, monkeypatch, rows)
    got = {(r.scenario, r.basis): r for r in C.capacity_result(spark, "").collect()}
    ret = account(rows, plain_plan([(c, d, k) for c, d, _, _, s, k in rows if s], HOLD, 10, 2), 10)
    assert abs(got["even", "capital"].cagr - (np.prod(1 + ret) ** (YEAR / 80) - 1)) < 2e-6
    assert got["even", "capital"].vol < got["even", "invested"].vol and len(got) == 4


def test_rhythm_bounds():
    lad = K.Rhythm(ladder=(1, 2, 2))
    assert [lad.wanted(n) for n in range(7)] == [1, 2, 1, 2, 1, 0, 0] and lad.room == 5 and lad.daily == 2
    assert [K.Rhythm(3, 2).wanted(n) for n in range(5)] == [2, 2, 1, 0, 0] and K.Rhythm().wanted(9) is None and K.Rhythm(new=4).wanted(99) == 4
    assert K.Rhythm(10, 2).considered(20) == 12 and K.Rhythm(new=2).considered(3) == 10 and K.Rhythm().considered(5) == 0
