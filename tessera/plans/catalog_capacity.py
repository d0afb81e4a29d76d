"""Queries on plans under a capacity: positions, both bases, occupancy, random controls and the search over eight axes, each with its SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import capacity as K
from ..operators import cross as X
from ..operators import simulate as D
from ..sources.files import staged
from . import query as Q
from . import sql as S
from .catalog_cross import r6
from .catalog_strategy import HOLD, ROWS, _days, prepared
from .catalog_studies import _chosen

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Random plans beside the deepest-first one.
DRAWS = 200
TEN = K.Rhythm(places=10, new=2)
LADDER = K.Rhythm(ladder=(1, 2, 2, 2, 3))


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


# ---- SQL: a plan as a recursion over the days that have candidates, which carries the positions held ------------------


#: From cd (scenario, code, day, key) and rl (scenario, places, new, steps) to hd, the positions.
PLANNED = f"""
, dn AS MATERIALIZED (SELECT scenario, day, row_number() OVER (PARTITION BY scenario ORDER BY day) AS k, list(code ORDER BY key NULLS LAST, code) AS codes FROM cd GROUP BY scenario, day)
, pst AS (
    SELECT scenario, 0::BIGINT AS k, NULL::BIGINT AS day, []::STRUCT(c BIGINT, x BIGINT)[] AS held, []::STRUCT(c BIGINT, x BIGINT)[] AS got FROM rl
    UNION ALL
    SELECT scenario, k, day, list_concat(alive, got), got FROM (
        SELECT scenario, k, day, alive, list_transform(free[1:want], lambda c: {{'c': c, 'x': day + {HOLD + 1}}}) AS got FROM (
            SELECT *, list_filter(codes, lambda c: NOT list_contains(names, c)) AS free,
                CASE WHEN steps IS NULL THEN least(places - len(alive), new) ELSE coalesce(list_min(list_filter(steps, lambda s: s > len(alive))), len(alive)) - len(alive) END AS want
            FROM (SELECT *, list_transform(alive, lambda h: h.c) AS names FROM (
                SELECT p.scenario, d.k, d.day, d.codes, places, new, steps, list_filter(p.held, lambda h: h.x > d.day) AS alive
                FROM pst p JOIN dn d ON d.scenario = p.scenario AND d.k = p.k + 1 JOIN rl ON rl.scenario = p.scenario))))
)
, hd AS MATERIALIZED (
    SELECT scenario, g.c AS code, p.day, p.day + 1 AS entry_day, g.x AS exit_day, rws.row, 1.0 / CASE WHEN steps IS NULL THEN places ELSE list_max(steps) END AS weight
    FROM (SELECT scenario, day, unnest(got) AS g FROM pst) p JOIN rl USING (scenario) JOIN rws ON rws.code = g.c AND rws.day = p.day
)"""
#: Daily returns of the positions on both bases, and their values.
EARNED = f"""
, ce AS (SELECT scenario, hd.day + j AS day, weight, x.oret_sig AS ret FROM hd JOIN range(0, {HOLD}) t(j) ON true JOIN rws x ON x.code = hd.code AND x.row = hd.row + j WHERE x.oret_sig IS NOT NULL)
, dl AS (SELECT scenario, day, sum(weight * (ret - 0.003 / {HOLD})) AS earned, sum(weight) AS share, count(*) AS n FROM ce GROUP BY scenario, day)
, pd AS MATERIALIZED (SELECT scenario, cal.day, cal.date, coalesce(n, 0) AS n, coalesce(earned / share, 0) AS invested, coalesce(earned, 0) AS capital FROM cal CROSS JOIN (SELECT DISTINCT scenario FROM hd) LEFT JOIN dl USING (scenario, day))
, bs AS MATERIALIZED (SELECT *, product(1 + ret) OVER (PARTITION BY scenario, basis ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM (SELECT scenario, 'invested' AS basis, day, date, n, invested AS ret FROM pd UNION ALL SELECT scenario, 'capital', day, date, n, capital FROM pd))
, an AS (SELECT scenario, basis, max_by(nav, day) ** (252.0 / count(*)) - 1 AS cagr, min(fall) AS mdd, avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0) AS sharpe, avg(ret) * 252 AS ann_arith, stddev_samp(ret) * sqrt(252) AS vol
    FROM (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY scenario, basis ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM bs) GROUP BY scenario, basis)"""
#: Positions open on each day, counted where they stand.
OPEN = f"""
, oc AS (SELECT scenario, cal.day, cal.date, count(hd.code) AS held, round(coalesce(sum(weight), 0), 9) AS share FROM cal CROSS JOIN (SELECT DISTINCT scenario FROM hd) LEFT JOIN hd ON hd.scenario = hd_scenario AND cal.day >= hd.day AND cal.day < hd.day + {HOLD} GROUP BY ALL)""".replace("SELECT DISTINCT scenario FROM hd) LEFT", "SELECT DISTINCT scenario AS hd_scenario FROM hd) LEFT").replace("(SELECT scenario, cal.day", "(SELECT hd_scenario AS scenario, cal.day")
#: What became of the signals.
OFFERED = f"""
, of AS (SELECT scenario, count(*) AS n_signal, count(*) FILTER (EXISTS (SELECT 1 FROM hd WHERE hd.scenario = cd.scenario AND hd.code = cd.code AND hd.day < cd.day AND cd.day < hd.day + {HOLD + 1})) AS n_drop_dup FROM cd GROUP BY scenario)
, hn AS (SELECT scenario, count(*) AS n_hold FROM hd GROUP BY scenario)"""
DEEPEST = ", cd AS MATERIALIZED (SELECT 'deep' AS scenario, code, day, px_ma60_pct AS key FROM sg), rl(scenario, places, new, steps) AS (VALUES ('deep', 10, 2, NULL::INTEGER[]))"
STEPPED = ", cd AS MATERIALIZED (SELECT 'deep' AS scenario, code, day, px_ma60_pct AS key FROM sg), rl(scenario, places, new, steps) AS (VALUES ('deep', 0, 0, [1, 3, 5, 7, 10]))"
BOTH = ", cd AS MATERIALIZED (SELECT scenario, code, day, px_ma60_pct AS key FROM sg CROSS JOIN (SELECT unnest(['even', 'ladder']) AS scenario)), rl(scenario, places, new, steps) AS (VALUES ('even', 10, 2, NULL::INTEGER[]), ('ladder', 0, 0, [1, 3, 5, 7, 10]))"


# ---- plans ------------------------------------------------------------------------------------------------------------


def _rows(spark, sf) -> DataFrame:
    return prepared(spark, sf).select("code", "day", "row", "oret_sig", "signal", "px_ma60_pct")


def _deepest(rows: DataFrame) -> DataFrame:
    return rows.where("signal").select(F.lit("deep").alias("scenario"), "code", "day", "row", F.col("px_ma60_pct").alias("key"))


def _even_and_ladder(rows: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(i).alias("rhythm")) for i, n in enumerate(("even", "ladder"))))).alias("s")
    return rows.where("signal").select(each, "code", "day", "row", F.col("px_ma60_pct").alias("key")).select("s.*", "code", "day", "row", "key")


_HELD = "SELECT scenario, entry_day, exit_day, code, day, row, round(weight, 6) AS weight FROM hd"


@query("capacity_plan", S.with_(ROWS, DEEPEST + PLANNED + _HELD))
def capacity_plan(spark, sf):
    return K.plan(_deepest(_rows(spark, sf)), HOLD, TEN).select("scenario", "entry_day", "exit_day", "code", "day", "row", *r6("weight"))


@query("ladder_plan", S.with_(ROWS, STEPPED + PLANNED + _HELD))
def ladder_plan(spark, sf):
    return K.plan(_deepest(_rows(spark, sf)), HOLD, LADDER).select("scenario", "entry_day", "exit_day", "code", "day", "row", *r6("weight"))


@query("capacity_nav", S.with_(ROWS, DEEPEST + PLANNED + EARNED + "SELECT scenario, day, date, n, round(ret, 6) AS ret, round(nav, 6) AS nav FROM bs WHERE basis = 'capital'"))
def capacity_nav(spark, sf):
    """Value of an account of ten places by day."""
    rows = _rows(spark, sf)
    daily = K.daily_returns(K.plan(_deepest(rows), HOLD, TEN), rows, _days(spark, sf), HOLD)
    return K.with_value(daily, "capital").select("scenario", "day", "date", "n", *r6("nav", ret=F.col("capital")))


_FULL = "count(*) FILTER (share >= 1 - 1e-9) / count(*)"


@query("capacity_occupancy", S.with_(ROWS, BOTH + PLANNED + OPEN + OFFERED + f""" SELECT scenario, round(coalesce(avg(held) FILTER (held > 0), 0), 6) AS avg_pos, max(held) AS max_pos, round(count(*) FILTER (held = 0) / count(*), 6) AS empty_pct, round(count(*) FILTER (held > 0) / count(*), 6) AS active_pct,
    round(coalesce(avg(share) FILTER (share > 1e-9), 0), 6) AS avg_invested, round({_FULL}, 6) AS full_pct, round(max(share), 6) AS max_invested, any_value(n_signal) AS n_signal, any_value(n_hold) AS n_hold, any_value(n_signal - n_hold) AS n_drop, any_value(n_drop_dup) AS n_drop_dup, round(any_value(n_hold / n_signal), 6) AS fill_pct, round(any_value((n_signal - n_hold) / n_signal), 6) AS drop_pct
    FROM oc JOIN of USING (scenario) JOIN hn USING (scenario) GROUP BY scenario"""))
def capacity_occupancy(spark, sf):
    """How full an even and a stepped account were, by opened and ended positions, and what became of the signals."""
    each = _even_and_ladder(_rows(spark, sf))
    holds = staged(K.plan(each, HOLD, [TEN, LADDER]), "capacity-holds")
    full = K.occupancy(K.occupied(holds, _days(spark, sf), HOLD))
    out = full.join(K.offered(each, holds), "scenario")  # a row a scenario
    return out.select("scenario", "max_pos", "n_signal", "n_hold", "n_drop", "n_drop_dup", *r6("avg_pos", "empty_pct", "active_pct", "avg_invested", "full_pct", "max_invested", "fill_pct", "drop_pct"))


@query("capacity_result", S.with_(ROWS, BOTH + PLANNED + EARNED + OPEN + OFFERED + """, us AS (SELECT scenario, day, n, CASE WHEN steps IS NULL THEN n / places ELSE share END AS used FROM pd JOIN oc USING (scenario, day) JOIN rl USING (scenario)),
    uo AS (SELECT scenario, coalesce(avg(n) FILTER (n > 0), 0) AS avg_pos, max(n) AS max_pos, count(*) FILTER (n > 0) / count(*) AS active, coalesce(avg(used) FILTER (used > 1e-9), 0) AS invested, count(*) FILTER (used >= 1 - 1e-9) / count(*) AS filled FROM us GROUP BY scenario)
    SELECT scenario, basis, round(cagr, 6) AS cagr, round(mdd, 6) AS mdd, round(sharpe, 6) AS sharpe, round(ann_arith, 6) AS ann_arith, round(vol, 6) AS vol, n_signal, n_hold, n_signal - n_hold AS n_drop, n_drop_dup, round(n_hold / n_signal, 6) AS fill_pct, round((n_signal - n_hold) / n_signal, 6) AS drop_pct,
    round(avg_pos, 6) AS avg_pos, max_pos, round(1 - active, 6) AS empty_pct, round(active, 6) AS active_pct, round(invested, 6) AS avg_invested, round(filled, 6) AS full_pct FROM an JOIN of USING (scenario) JOIN hn USING (scenario) JOIN uo USING (scenario)"""))
def capacity_result(spark, sf):
    """An even and a stepped account on both bases: return, fall and ratio beside how much of the signals and of the money was used."""
    rows = _rows(spark, sf)
    each = _even_and_ladder(rows)
    holds, days = staged(K.plan(each, HOLD, [TEN, LADDER]), "capacity-holds"), _days(spark, sf)
    daily = staged(K.daily_returns(holds, rows, days, HOLD), "capacity-daily")
    # an even position is a tenth of the account on the days that it has a price; a stepped one from day to day
    used = F.when(F.col("scenario") == "even", F.col("n") / TEN.room).otherwise(F.col("share"))
    full = K.occupancy(daily.join(K.occupied(holds, days, HOLD).drop("date"), ["scenario", "day"]).withColumn("used", used), "n", "used").drop("max_invested")
    stats = D.annual_stats(K.by_basis(daily), ["scenario", "basis"]).drop("days")
    out = stats.join(K.offered(each, holds), "scenario").join(full, "scenario")  # a row a scenario
    return out.select("scenario", "basis", "n_signal", "n_hold", "n_drop", "n_drop_dup", "max_pos", *r6("cagr", "mdd", "sharpe", "ann_arith", "vol", "fill_pct", "drop_pct", "avg_pos", "empty_pct", "active_pct", "avg_invested", "full_pct"))


SPANS = {"early": (1995, 1997), "middle": (1998, 1999), "late": (2000, 2001), "in sample": (1992, 1998), "out of sample": (1999, 2010)}


@query("capacity_segments", S.with_(ROWS, BOTH + PLANNED + EARNED + """, cp AS (SELECT scenario, day, year(date) AS year, ret FROM bs WHERE basis = 'capital'), yv AS (SELECT *, product(1 + ret) OVER (PARTITION BY scenario, year ORDER BY day ROWS UNBOUNDED PRECEDING) AS v FROM cp), yf AS (SELECT *, v / greatest(max(v) OVER (PARTITION BY scenario, year ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS f FROM yv)
    SELECT scenario, year::VARCHAR AS span, count(*) AS days, round(max_by(v, day) - 1, 6) AS ret, round(min(f), 6) AS mdd FROM yf GROUP BY scenario, year HAVING count(*) >= 20
    UNION ALL SELECT scenario, span, count(*), round(product(1 + ret) - 1, 6), NULL FROM cp JOIN (VALUES ('early', 1995, 1997), ('middle', 1998, 1999), ('late', 2000, 2001), ('in sample', 1992, 1998), ('out of sample', 1999, 2010)) s(span, a, b) ON year BETWEEN a AND b GROUP BY scenario, span HAVING count(*) >= 20"""))
def capacity_segments(spark, sf):
    """The account's return and fall by year, and its return in spans of years."""
    rows = _rows(spark, sf)
    daily = K.daily_returns(K.plan(_even_and_ladder(rows), HOLD, [TEN, LADDER]), rows, _days(spark, sf), HOLD)
    daily = daily.select("scenario", "day", F.year("date").alias("year"), F.col("capital").alias("ret"))
    w = Window.partitionBy("scenario", "year").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    years = daily.withColumn("v", F.product(1 + F.col("ret")).over(w)).withColumn("f", F.col("v") / F.greatest(F.max("v").over(w), F.lit(1.0)) - 1)
    years = years.groupBy("scenario", F.col("year").cast("string").alias("span")).agg(F.count("*").alias("days"), (F.max_by("v", "day") - 1).alias("ret"), F.min("f").alias("mdd"))
    each = daily.select("scenario", "ret", _chosen([(F.col("year").between(a, b), {"span": F.lit(n)}) for n, (a, b) in SPANS.items()])).select("scenario", "ret", "g.span")
    spans = each.groupBy("scenario", "span").agg(F.count("*").alias("days"), (F.product(1 + F.col("ret")) - 1).alias("ret"), F.lit(None).cast("double").alias("mdd"))
    return years.unionByName(spans).where("days >= 20").select("scenario", "span", "days", *r6("ret", "mdd"))


def _controls(rows: DataFrame, draws: int) -> DataFrame:
    """The deepest first, and ``draws`` random orders; dealt by day, so that a day's candidates are trimmed where they are made."""
    each = rows.where("signal").select("code", "day", "row", "px_ma60_pct").repartition("day").withColumn("seed", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    deep = F.col("seed") < 0
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "code", "day", "seed")), 1, 12), 16, 10).cast("double")
    return each.select(F.when(deep, "deep").otherwise(F.concat(F.lit("rand"), F.col("seed"))).alias("scenario"), "code", "day", "row", F.when(deep, F.col("px_ma60_pct")).otherwise(drawn).alias("key"))


@query("random_control", S.with_(ROWS, f""", cd AS MATERIALIZED (SELECT 'deep' AS scenario, code, day, px_ma60_pct AS key FROM sg UNION ALL SELECT 'rand' || seed, code, day, ('0x' || substr(md5(code || '|' || day || '|' || seed), 1, 12))::BIGINT::DOUBLE FROM sg CROSS JOIN range(0, {DRAWS}) t(seed)),
    rl(scenario, places, new, steps) AS (SELECT DISTINCT scenario, 10, 2, NULL::INTEGER[] FROM cd)""" + PLANNED + EARNED + """, al AS (SELECT scenario, round(cagr, 12) AS cagr FROM an WHERE basis = 'capital'), ow AS (SELECT cagr AS own FROM al WHERE scenario = 'deep')
    SELECT count(*) AS n, round(avg(cagr), 6) AS mean, round(stddev_samp(cagr), 6) AS sd, round(quantile_cont(cagr, 0.05), 6) AS p05, round(quantile_cont(cagr, 0.95), 6) AS p95, round(min(cagr), 6) AS low, round(max(cagr), 6) AS high, round(avg(CASE WHEN cagr < own THEN 1.0 ELSE 0.0 END), 6) AS beaten, round(max(own), 6) AS own, round((max(own) - avg(cagr)) / nullif(stddev_samp(cagr), 0), 5) AS z FROM al CROSS JOIN ow WHERE scenario <> 'deep'"""))
def random_control(spark, sf):
    """The plan among DRAWS random ones."""
    rows = _rows(spark, sf)
    daily = K.daily_returns(K.plan(_controls(rows, DRAWS), HOLD, TEN), rows, _days(spark, sf), HOLD)
    stats = D.annual_stats(K.with_value(daily.withColumn("ret", F.col("capital")), "ret"), ["scenario"])
    stats = stats.withColumn("cagr", F.round("cagr", 12))  # no deviation from the last bit where all orders buy the same
    return K.random_control(stats, "deep").select("n", *r6("mean", "sd", "p05", "p95", "low", "high", "beaten", "own"), F.round("z", 5).alias("z"))


# ---- the search over eight axes -----------------------------------------------------------------------------------------

#: Values of the eight axes, in the order in which they are crossed; six of signals, two of how they are bought.
AXES: dict[str, tuple] = {
    "depth": ((1, 1), (1, 3), (1, 10)), "size": ((0, 2), (0, 9)), "market": ("bear", "any"), "vol": ("any", "high"), "confirm": ("none", "ma5"), "ret20": ((1, 10), (1, 5)),
    "rhythm": (K.Rhythm(10, 3), K.Rhythm(5, 2), LADDER), "pick": ("deep", "small", "none"),
}
MOST, TOP, LEAST = 240, 120, 200
SORTS = ("cap_sharpe", "cap_cagr", "inv_cagr")


def search(rows: DataFrame, days: DataFrame, axes: dict[str, tuple] = AXES, most: int = MOST, top: int = TOP, least: int = LEAST, sort_by: str = "cap_sharpe") -> DataFrame:
    """The best accounts over a grid, and how many of them gave the same result.

    Rhythm and order do not change which rows are signals, so each selection is worked out and written once, and all
    accounts that differ only in these two draw on it. A grid beyond ``most`` is thinned at an even stride; a selection
    with fewer than ``least`` signals is left out. Sorted by SORTS, the first of them if the name is another.
    """
    spark = rows.sparkSession
    grid = Q.even_stride(list(itertools.product(*axes.values())), most)
    signatures = list(dict.fromkeys(g[:6] for g in grid))
    rhythms = list(dict.fromkeys(g[6] for g in grid))

    def params(s: tuple) -> Q.Params:
        depth, size, market, vol, confirm, ret20 = s
        return Q.Params(ranges={"px_ma60_pct": depth, "ret20": ret20}, size=size, market=market, volatility=vol, confirm=() if confirm == "none" else (confirm,))

    chosen = _chosen([(Q.predicate(params(s))[0], {"sig": F.lit(i)}) for i, s in enumerate(signatures)])
    keys = [Q.PICKS[p]().cast("double").alias(f"by_{p}") for p in axes["pick"]]
    signals = staged(rows.select("code", "day", "row", "r", *keys, chosen).select("code", "day", "row", "r", *(f"by_{p}" for p in axes["pick"]), "g.sig"), "search-signals")
    own = signals.groupBy("sig").agg(F.count("*").alias("n_signal"), F.count("r").alias("n_trade"), F.avg(F.col("r") - X.COST).alias("mean")).where(F.col("n_signal") >= least)
    named = [(str(i), signatures.index(g[:6]), rhythms.index(g[6]), g[7]) for i, g in enumerate(grid)]
    accounts = spark.createDataFrame(named, "scenario string, sig int, rhythm int, pick string").join(F.broadcast(own), "sig")  # at most ``most`` rows
    key = F.coalesce(*(F.when(F.col("pick") == p, F.col(f"by_{p}")) for p in axes["pick"]))
    each = signals.repartition("day").join(F.broadcast(accounts.select("scenario", "sig", "rhythm", "pick")), "sig").select("scenario", "rhythm", "code", "day", "row", key.alias("key"))
    holds = staged(K.plan(each, HOLD, rhythms), "search-holds")
    daily = staged(K.daily_returns(holds, rows, days, HOLD), "search-daily")
    stats = D.annual_stats(K.by_basis(daily), ["scenario", "basis"]).groupBy("scenario").agg(*(F.max(F.when(F.col("basis") == b, F.col(c))).alias(f"{n}_{c}") for n, b in (("cap", "capital"), ("inv", "invested")) for c in ("cagr", "mdd", "sharpe")))
    filled = daily.groupBy("scenario").agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(0.0)).alias("avg_pos"), F.product(F.when(F.year("date") <= 1998, 1 + F.col("capital"))).alias("before"), F.product(F.when(F.year("date") > 1998, 1 + F.col("capital"))).alias("after"))
    bought = holds.groupBy("scenario").agg(F.count("*").alias("n_hold"))
    out = accounts.join(stats, "scenario").join(filled, "scenario").join(bought, "scenario")
    out = out.select(F.col("scenario").cast("int").alias("place"), "n_signal", "n_trade", "n_hold", *r6("mean", "avg_pos", "cap_cagr", "cap_mdd", "cap_sharpe", "inv_cagr", "inv_sharpe", fill_pct=F.col("n_hold") / F.col("n_signal"), in_sample=F.col("before") - 1, out_of_sample=F.col("after") - 1))
    out = out.withColumn("twins", F.count("*").over(Window.partitionBy("cap_cagr", "cap_sharpe")))
    return out.orderBy(F.desc_nulls_last(sort_by if sort_by in SORTS else SORTS[0]), "place").limit(top)


_AX = [
    "SELECT * FROM (VALUES (0, 1, 1), (1, 1, 3), (2, 1, 10)) t(i1, d_lo, d_hi)", "SELECT * FROM (VALUES (0, 0, 2), (1, 0, 9)) t(i2, s_lo, s_hi)", "SELECT * FROM (VALUES (0, 'bear'), (1, 'any')) t(i3, market)", "SELECT * FROM (VALUES (0, 'any'), (1, 'high')) t(i4, vol)",
    "SELECT * FROM (VALUES (0, 'none'), (1, 'ma5')) t(i5, confirm)", "SELECT * FROM (VALUES (0, 1, 10), (1, 1, 5)) t(i6, f_lo, f_hi)", "SELECT * FROM (VALUES (0, 10, 3, NULL::INTEGER[]), (1, 5, 2, NULL), (2, 0, 0, [1, 3, 5, 7, 10])) t(i7, places, new, steps)", "SELECT * FROM (VALUES (0, 'deep'), (1, 'small'), (2, 'none')) t(i8, pick)",
]


@query("tune_capacity", S.with_(ROWS, ", g0 AS (SELECT *, row_number() OVER (ORDER BY i1, i2, i3, i4, i5, i6, i7, i8) - 1 AS spot FROM " + " CROSS JOIN ".join(f"({a})" for a in _AX) + """),
    g1 AS MATERIALIZED (SELECT g0.*, k AS place FROM range(0, 240) q(k) JOIN g0 ON spot = (k * 864) // 240),
    fit AS MATERIALIZED (SELECT place, code, day, r, CASE pick WHEN 'deep' THEN px_ma60_pct WHEN 'small' THEN size_grp ELSE code END::DOUBLE AS key FROM rws JOIN g1 ON d_px_ma60_pct BETWEEN d_lo AND d_hi AND d_ret20 BETWEEN f_lo AND f_hi AND (s_hi = 9 OR size_grp BETWEEN s_lo AND s_hi) AND (market = 'any' OR NOT bull) AND (vol = 'any' OR mkt_hv20 > hv_med) AND (confirm = 'none' OR close > ma5)),
    sn AS MATERIALIZED (SELECT place, count(*) AS n_signal, count(r) AS n_trade, avg(r - 0.003) AS mean FROM fit GROUP BY place HAVING count(*) >= 200),
    cd AS MATERIALIZED (SELECT place::VARCHAR AS scenario, code, day, key FROM fit JOIN sn USING (place)), rl AS MATERIALIZED (SELECT place::VARCHAR AS scenario, places, new, steps FROM g1 JOIN sn USING (place))""" + PLANNED + EARNED + """,
    fl AS (SELECT scenario, coalesce(avg(n) FILTER (n > 0), 0) AS avg_pos, product(1 + capital) FILTER (year(date) <= 1998) - 1 AS before, product(1 + capital) FILTER (year(date) > 1998) - 1 AS after FROM pd GROUP BY scenario), hn AS (SELECT scenario, count(*) AS n_hold FROM hd GROUP BY scenario),
    ro AS (SELECT place, n_signal, n_trade, n_hold, round(mean, 6) AS mean, round(avg_pos, 6) AS avg_pos, round(c.cagr, 6) AS cap_cagr, round(c.mdd, 6) AS cap_mdd, round(c.sharpe, 6) AS cap_sharpe, round(i.cagr, 6) AS inv_cagr, round(i.sharpe, 6) AS inv_sharpe, round(n_hold / n_signal, 6) AS fill_pct, round(before, 6) AS in_sample, round(after, 6) AS out_of_sample
        FROM sn JOIN an c ON c.scenario = place::VARCHAR AND c.basis = 'capital' JOIN an i ON i.scenario = c.scenario AND i.basis = 'invested' JOIN fl ON fl.scenario = c.scenario JOIN hn ON hn.scenario = c.scenario)
    SELECT place::INTEGER AS place, * EXCLUDE (place), count(*) OVER (PARTITION BY cap_cagr, cap_sharpe) AS twins FROM ro QUALIFY row_number() OVER (ORDER BY cap_sharpe DESC NULLS LAST, place) <= 120"""))
def tune_capacity(spark, sf):
    """The search over eight axes, judged by the account."""
    return search(prepared(spark, sf), _days(spark, sf))
