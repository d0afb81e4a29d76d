"""Studies of scores, thresholds, factors and markets, outside series and small rules on dimensions, each with its SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bins, correlation, rank_pct, ratio
from ..operators import cross as X
from ..operators import indicators as I
from ..operators import simulate as D
from ..sources.panel import table
from . import query as Q
from . import sql as S
from .catalog_cross import CHAIN, FEATURES, GRP, MKT, STATES, deciled, r6, states
from .catalog_data import FIN, published
from .catalog_strategy import HOLD, ROWS, _days, prepared
from .catalog_windows import base, ud_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


def _structs(rows: list[dict[str, Column]]) -> Column:
    return F.explode(F.array(*(F.struct(*(c.alias(k) for k, c in r.items())) for r in rows))).alias("g")


def _chosen(tests: list[tuple[Column, dict[str, Column]]]) -> Column:
    """One row for each test that holds, with its columns."""
    return F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.struct(*(c.alias(k) for k, c in r.items()))) for t, r in tests)))).alias("g")


# ---- strength against size groups and the market --------------------------------------------------------------------

STRENGTH = FEATURES + MKT + f""", z1 AS (SELECT date, size_grp, avg(ret) AS r FROM dec WHERE size_grp IS NOT NULL GROUP BY ALL), z2 AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY size_grp ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM z1),
zz AS (SELECT date, size_grp, nav / lag(nav, 20) OVER (PARTITION BY size_grp ORDER BY date) - 1 AS size_ret20 FROM z2), m2 AS (SELECT date, product(1 + coalesce(mkt_ret, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM mkt), m3 AS (SELECT date, nav / lag(nav, 20) OVER (ORDER BY date) - 1 AS mkt_ret20 FROM m2),
st AS MATERIALIZED (SELECT d.code, d.date, round(d.ret20 - size_ret20, 9) AS rs_sz20, round(d.ret20 - mkt_ret20, 9) AS rs_mkt20 FROM dec d LEFT JOIN zz USING (date, size_grp) LEFT JOIN m3 ON m3.date = d.date)"""


def strength(spark, sf) -> DataFrame:
    """rs_sz20 and rs_mkt20: the return of 20 periods less that of the size group and of the market."""
    rows = deciled(spark, sf, "ret5")
    sizes = X.group_returns(rows.where("size_grp IS NOT NULL"), ["size_grp"], (20,), "size").select("date", "size_grp", "size_ret20")
    w = Window.orderBy("day")  # a row per period
    nav = X.market_returns(rows).withColumn("nav", F.product(1 + F.coalesce("mkt_ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nav = nav.select("date", (F.col("nav") / F.lag("nav", 20).over(w) - 1).alias("mkt_ret20"))
    # ten rows and one row a period
    out = rows.join(F.broadcast(sizes), ["date", "size_grp"], "left").join(F.broadcast(nav), "date", "left")
    return out.select("code", "date", F.round(F.col("ret20") - F.col("size_ret20"), 9).alias("rs_sz20"), F.round(F.col("ret20") - F.col("mkt_ret20"), 9).alias("rs_mkt20"))


@query("strength_deciles", S.with_(STRENGTH, f"SELECT code, date, round(rs_sz20, 6) AS rs_sz20, round(rs_mkt20, 6) AS rs_mkt20, {S.decile(S.rank_pct('rs_sz20'))} AS d_rs_sz20, {S.decile(S.rank_pct('rs_mkt20'))} AS d_rs_mkt20 FROM st"))
def strength_deciles(spark, sf):
    names = ("rs_sz20", "rs_mkt20")
    return strength(spark, sf).select("code", "date", *r6(*names), *(bins(rank_pct(c, ["date"])).alias(f"d_{c}") for c in names))


# ---- dates, outside series, alerts ----------------------------------------------------------------------------------


@query("report_days", S.with_(S.CLEAN, f", {FIN} SELECT code, report_end, cal.date AS last_date, cal.day AS last_day FROM pub ASOF LEFT JOIN cal ON pub.report_end >= cal.date"))
def report_days(spark, sf):
    """The last day of the calendar at or before the end of a report's quarter."""
    reports = published(spark, sf).select("code", "report_end")
    ends = reports.select(F.col("report_end").alias("at")).distinct().select("at", F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("day"))  # a row per quarter
    days = _days(spark, sf).select(F.col("date").alias("at"), "date", F.col("day").cast("int").alias("day"))
    w = Window.orderBy("at", F.desc_nulls_last("date")).rowsBetween(Window.unboundedPreceding, 0)
    found = days.unionByName(ends).select("at", "date", F.last("date", True).over(w).alias("last_date"), F.last("day", True).over(w).alias("last_day")).where("date IS NULL").drop("date")
    return reports.join(F.broadcast(found), F.col("report_end") == F.col("at")).select("code", "report_end", "last_date", F.col("last_day").cast("long").alias("last_day"))


_SERIES = ", ser AS (SELECT date, close, CASE WHEN count(*) OVER (ORDER BY date ROWS 59 PRECEDING) >= 60 THEN avg(close) OVER (ORDER BY date ROWS 59 PRECEDING) END AS ma60 FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, round(sum(o_totalprice) / 1000, 2)::DOUBLE AS close FROM orders GROUP BY 1))"


def outside_series(spark, sf) -> DataFrame:
    """A series from outside the panel, here the orders of a week, and its mean of 60; a row per period."""
    df = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg(F.round(F.sum("o_totalprice") / 1000, 2).cast("double").alias("close"))
    w = Window.orderBy("date").rowsBetween(-59, 0)
    return df.withColumn("ma60", F.when(F.count("*").over(w) >= 60, F.avg("close").over(w)))


@query("index_state", S.with_(S.CLEAN + _SERIES, "SELECT date, round(close, 6) AS close, round(ma60, 6) AS ma60, round(close / ma60 - 1, 6) AS dist, close > ma60 AS bull FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k, count(*) OVER () AS n FROM ser) WHERE k <= 310 AND n >= 61"))
def index_state(spark, sf):
    """The tail of a series against its own mean; no state where that has not formed, nothing below 61 values."""
    s = outside_series(spark, sf)
    s = s.withColumns({"k": F.row_number().over(Window.orderBy(F.desc("date"))), "n": F.count("*").over(Window.partitionBy())})  # a row per period
    return s.where("k <= 310 AND n >= 61").select("date", *r6("close", "ma60", dist=F.col("close") / F.col("ma60") - 1), (F.col("close") > F.col("ma60")).alias("bull"))


@query("index_alignment", S.with_(STATES + _SERIES, """, al AS (SELECT s.date, s.nav, ser.close, ser.ma60, ln(s.nav) - lag(ln(s.nav)) OVER (ORDER BY s.date) AS a, ln(ser.close) - lag(ln(ser.close)) OVER (ORDER BY s.date) AS b FROM states s JOIN ser ON ser.date = s.date WHERE s.index = 'all' AND s.ma_len = 60),
    x AS (SELECT count(*) AS n, CASE WHEN count(*) > 31 THEN corr(a, b) END AS co, max_by(nav, date) / min_by(nav, date) - 1 AS own, max_by(close, date) / min_by(close, date) - 1 AS other, max_by(close > ma60, date) AS bull FROM al HAVING count(*) >= 120)
    SELECT n, round(co, 6) AS corr, round(own, 6) AS own, round(other, 6) AS other, round((ln(1 + own) - ln(1 + other)) / n * 252, 6) AS gap, bull FROM x"""))
def index_alignment(spark, sf):
    """The market beside a series from outside on the dates that both have, 120 at least: correlation of steps and gap a year."""
    own = states(spark, sf).where("index = 'all' AND ma_len = 60").select("date", "nav")
    both = own.join(outside_series(spark, sf), "date")
    w = Window.orderBy("date")  # a row per period
    step = lambda c: F.log(c) - F.lag(F.log(c)).over(w)
    both = both.withColumns({"a": step("nav"), "b": step("close")})
    ends = lambda c: F.max_by(c, "date") / F.min_by(c, "date") - 1
    out = both.agg(F.count("*").alias("n"), correlation("a", "b").alias("co"), ends("nav").alias("own"), ends("close").alias("other"), F.max_by(F.col("close") > F.col("ma60"), "date").alias("bull")).where("n >= 120")
    gap = (F.log1p("own") - F.log1p("other")) / F.col("n") * X.YEAR
    return out.select("n", *r6("own", "other", corr=F.when(F.col("n") > 31, F.col("co")), gap=gap), "bull")


@query("market_alert", S.with_(ROWS, """, t AS (SELECT *, nav / lag(nav) OVER (PARTITION BY index ORDER BY day) - 1 AS change, row_number() OVER (PARTITION BY index ORDER BY day DESC) AS k FROM states WHERE ma_len = 60),
    hit AS (SELECT code, row_number() OVER (ORDER BY px_ma60_pct NULLS LAST, code) AS k FROM sg WHERE day = (SELECT max(day) FROM rws)), h AS (SELECT count(*) AS hits, coalesce(string_agg(code::VARCHAR, ',' ORDER BY k) FILTER (k <= 10), '') AS codes FROM hit)
    SELECT index, date, round(change, 6) AS change, round(dist, 6) AS dist, CASE WHEN ma IS NULL THEN 'unformed' WHEN bull THEN 'bull' ELSE 'bear' END AS state, hits, codes FROM t, h WHERE k = 1"""))
def market_alert(spark, sf):
    """By market the last day's change and state, and that day's signals; none are listed where that day has none."""
    w = Window.partitionBy("index").orderBy("day")
    s = states(spark, sf).where("ma_len = 60").withColumn("change", F.col("nav") / F.lag("nav").over(w) - 1)
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("index").orderBy(F.desc("day")))).where("k = 1")
    df = prepared(spark, sf)
    last = df.agg(F.max("day").alias("last"))
    today = df.where("signal").join(F.broadcast(last), F.col("day") == F.col("last"))
    k = F.row_number().over(Window.partitionBy("day").orderBy(F.asc_nulls_last("px_ma60_pct"), "code"))
    first = today.withColumn("k", k).agg(F.count("*").alias("hits"), F.sort_array(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "code")))).alias("c"))
    first = first.select("hits", F.array_join(F.transform("c", lambda x: x["code"].cast("string")), ",").alias("codes"))
    state = F.when(F.col("ma").isNull(), "unformed").when(F.col("bull"), "bull").otherwise("bear")
    return s.join(F.broadcast(first)).select("index", "date", *r6("change", "dist"), state.alias("state"), "hits", "codes")  # one row beside six


# ---- scores, thresholds, grids --------------------------------------------------------------------------------------

SCORED = ROWS + """, sc AS (SELECT day, r, round(coalesce((11 - d_ret60) * 6, 0) + coalesce((11 - d_ret40) * 3, 0) + coalesce((10 - size_grp) * 4, 0) - coalesce(greatest(-1, least(1, px_ma60_pct)) * 10, 0) - coalesce(greatest(-1, least(1, ret40)) * 5, 0), 6) AS score FROM rws WHERE r IS NOT NULL),
so AS MATERIALIZED (SELECT *, round(r - avg(r) OVER (PARTITION BY day), 9) AS ex FROM sc)"""


def _scored(spark, sf) -> DataFrame:
    df = prepared(spark, sf).where("r IS NOT NULL").select("day", "r", F.round(Q.score() + S.NUDGE, 6).alias("score"))
    return df.withColumn("ex", F.round(F.col("r") - F.avg("r").over(Window.partitionBy("day")), 9))


@query("score_monotonicity", S.with_(SCORED, "SELECT greatest(0, least(7, floor(score / 20)))::INTEGER AS bin, count(*) AS n, round(avg(score), 6) AS score_mean, round(avg(r), 6) AS mean, round(avg(ex), 6) AS mean_ex, round(avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_ex FROM so GROUP BY 1"))
def score_monotonicity(spark, sf):
    """What followed, by bins of 20 points of the score."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.col("score") / 20))).cast("int").alias("bin")
    out = _scored(spark, sf).groupBy(bin_).agg(F.count("*").alias("n"), F.avg("score").alias("score_mean"), F.avg("r").alias("mean"), F.avg("ex").alias("mean_ex"), F.avg((F.col("ex") > 0).cast("double")).alias("win_ex"))
    return out.select("bin", "n", *r6("score_mean", "mean", "mean_ex", "win_ex"))


@query("score_threshold", S.with_(SCORED, "SELECT t.threshold, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM so), 6) AS share, round(avg(r), 6) AS mean, round(avg(ex), 6) AS mean_ex, round(avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_ex FROM so JOIN (SELECT unnest([30, 40, 50, 60, 70, 80, 90, 100, 110, 120]) AS threshold) t ON score >= t.threshold GROUP BY 1"))
def score_threshold(spark, sf):
    """What followed scores of a threshold or more: sums by tens of points, then sums of those above."""
    tens = F.least(F.lit(12), F.floor(F.col("score") / 10)).cast("int").alias("tens")
    parts = _scored(spark, sf).groupBy(tens).agg(F.count("*").alias("k"), F.sum("r").alias("r"), F.sum("ex").alias("ex"), F.sum((F.col("ex") > 0).cast("long")).alias("won"))  # a few rows
    above = Window.orderBy(F.desc("tens")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("k").over(Window.partitionBy())
    steps = parts.withColumns({"n": F.sum("k").over(above), "all": total, "s": F.sum("r").over(above), "e": F.sum("ex").over(above), "w": F.sum("won").over(above)})
    # a threshold without rows of its own tens takes the sums of the next tens above
    steps = steps.withColumn("below", F.coalesce(F.lag("tens").over(Window.orderBy("tens")), F.lit(2)))
    each = F.sequence(F.greatest(F.col("below") + 1, F.lit(3)), F.greatest("tens", F.lit(3)))
    out = steps.withColumn("step", F.explode(each)).where("step <= tens").withColumn("threshold", F.col("step") * 10)
    return out.select("threshold", "n", *r6(share=F.col("n") / F.col("all"), mean=F.col("s") / F.col("n"), mean_ex=F.col("e") / F.col("n"), win_ex=F.col("w") / F.col("n")))


_AXES = {"volume": ("rvol20 >= {}", (0.8, 1.0, 1.2, 1.5, 2.0)), "pullback": ("abs(px_ma20_pct) <= {}", (0.02, 0.05, 0.1, 0.2)), "trend": ("px_ma60_pct <= -{}", (0.0, 0.05, 0.1, 0.2))}


@query("sensitivity", S.with_(ROWS, """, ax AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS axis, {v}::DOUBLE AS level, date, round(r - 0.003, 9) AS net FROM tr WHERE {c.format(v)}" for k, (c, at) in _AXES.items() for v in at) + """),
    sp AS (SELECT *, CASE WHEN year(date) <= 1996 THEN 'train' WHEN year(date) = 1997 THEN 'valid' ELSE 'test' END AS part FROM ax)
    SELECT axis, level, part, count(*) AS n, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(net) FILTER (net > 0) / nullif(-avg(net) FILTER (net < 0), 0), 6) AS payoff FROM sp GROUP BY axis, level, part"""))
def sensitivity(spark, sf):
    """The flagship's trades by further thresholds, in the years of training, validation and test."""
    tests = [(F.expr(c.format(v)), {"axis": F.lit(k), "level": F.lit(float(v))}) for k, (c, at) in _AXES.items() for v in at]
    year = F.year("date")
    part = F.when(year <= 1996, "train").when(year == 1997, "valid").otherwise("test").alias("part")
    each = D.trades(prepared(spark, sf).where("signal")).select(part, F.round("net", 9).alias("net"), _chosen(tests)).select("part", "net", "g.*")
    v = F.col("net")
    out = each.groupBy("axis", "level", "part").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg((v > 0).cast("double")).alias("win"), ratio(F.avg(F.when(v > 0, v)), -F.avg(F.when(v < 0, v))).alias("payoff"))
    return out.select("axis", "level", "part", "n", *r6("mean", "win", "payoff"))


@query("neighbourhood", S.with_(ROWS, """, c AS MATERIALIZED (SELECT deep, small, count(*) AS n, avg(r) AS m FROM rws JOIN (SELECT unnest(range(1, 7)) AS deep) a ON d_px_ma60_pct <= deep JOIN (SELECT unnest(range(0, 6)) AS small) b ON size_grp <= small WHERE r IS NOT NULL AND NOT bull GROUP BY ALL)
    SELECT x.deep::INTEGER AS deep, x.small::INTEGER AS small, any_value(x.n) AS n, round(any_value(x.m), 6) AS mean, count(*) AS neighbours, round(avg(y.m), 6) AS near_mean, round(min(y.m), 6) AS near_least, round(avg(CASE WHEN y.m > 0 THEN 1.0 ELSE 0.0 END), 6) AS near_won
    FROM c x JOIN c y ON abs(x.deep - y.deep) <= 1 AND abs(x.small - y.small) <= 1 AND (x.deep, x.small) <> (y.deep, y.small) GROUP BY x.deep, x.small"""))
def neighbourhood(spark, sf):
    """Means of nested selections, and those of the cells around them: a plateau is to be trusted, a peak is not."""
    tests = [((F.col("d_px_ma60_pct") <= d) & (F.col("size_grp") <= s) & ~F.col("bull"), {"deep": F.lit(d), "small": F.lit(s)}) for d in range(1, 7) for s in range(6)]
    cells = prepared(spark, sf).where("r IS NOT NULL").select("r", _chosen(tests)).select("r", "g.*").groupBy("deep", "small").agg(F.count("*").alias("n"), F.avg("r").alias("mean"))
    around = [{"deep": F.col("deep") + a, "small": F.col("small") + b} for a, b in itertools.product((-1, 0, 1), repeat=2) if (a, b) != (0, 0)]
    near = cells.select("mean", _structs(around)).select("mean", "g.*").groupBy("deep", "small").agg(F.count("*").alias("neighbours"), F.avg("mean").alias("near_mean"), F.min("mean").alias("near_least"), F.avg((F.col("mean") > 0).cast("double")).alias("near_won"))
    return cells.join(near, ["deep", "small"]).select("deep", "small", "n", "neighbours", *r6("mean", "near_mean", "near_least", "near_won"))


#: Axes of the search and their values; a grid beyond MOST is thinned at an even stride, so that every value stays.
GRID = {"deep": (1, 2, 3), "fallen": (5, 8, 10), "small": (0, 2, 4), "market": ("any", "bear", "bull"), "vol": ("any", "high", "low"), "confirm": ("none", "ma5", "volup")}
MOST, TOP, LEAST = 240, 120, 200

_PICKED = ", ".join(f"SELECT unnest({list(v)}) AS {k}, unnest([0, 1, 2]) AS i_{k}" for k, v in GRID.items()).replace(", SELECT", "|SELECT").split("|")
_CROSS = " CROSS JOIN ".join(f"({s}) t{i}" for i, s in enumerate(_PICKED))


@query("tune_axes", S.with_(ROWS, f""", g0 AS (SELECT *, row_number() OVER (ORDER BY i_deep, i_fallen, i_small, i_market, i_vol, i_confirm) - 1 AS place, count(*) OVER () AS size FROM {_CROSS}),
    gr AS MATERIALIZED (SELECT * FROM g0 WHERE size <= {MOST} OR place IN (SELECT (k * 729) // {MOST} FROM range({MOST}) q(k))),
    fit AS (SELECT place, round(r - 0.003, 9) AS net FROM rws JOIN gr ON d_px_ma60_pct <= deep AND d_ret20 <= fallen AND size_grp <= small AND (market = 'any' OR bull = (market = 'bull')) AND (vol = 'any' OR (mkt_hv20 > hv_med) = (vol = 'high')) AND (confirm = 'none' OR (confirm = 'ma5' AND close > ma5) OR (confirm = 'volup' AND rvol20 > 1.2)) WHERE r IS NOT NULL),
    ag AS (SELECT place, count(*) AS n, avg(net) AS mean, stddev_samp(net) AS sd, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0) AS pf FROM fit GROUP BY place HAVING count(*) >= {LEAST}),
    ro AS (SELECT place, n, round(mean, 6) AS mean, round(mean / nullif(sd, 0), 6) AS sharpe, round(win, 6) AS win, round(pf, 6) AS pf FROM ag), tw AS (SELECT *, count(*) OVER (PARTITION BY n, mean, sharpe) AS twins, row_number() OVER (ORDER BY sharpe DESC, place) AS k FROM ro)
    SELECT deep, fallen, small, market, vol, confirm, n, mean, sharpe, win, pf, twins FROM tw JOIN gr USING (place) WHERE k <= {TOP}"""))
def tune_axes(spark, sf):
    """A search over six axes in one pass: the best by return over spread, and how many selections gave the same result."""
    grid = Q.even_stride(list(itertools.product(*GRID.values())), MOST)
    both = {"any": F.lit(True), "bear": ~F.col("bull"), "bull": F.col("bull")}
    wild = F.col("mkt_hv20") > F.col("hv_med")
    vol = {"any": F.lit(True), "high": wild, "low": ~wild}
    confirm = {"none": F.lit(True), "ma5": Q.CONFIRM["ma5"](), "volup": Q.CONFIRM["volup"]()}
    tests = [((F.col("d_px_ma60_pct") <= d) & (F.col("d_ret20") <= f) & (F.col("size_grp") <= s) & both[m] & vol[v] & confirm[c], {"place": F.lit(i)}) for i, (d, f, s, m, v, c) in enumerate(grid)]
    # one row a combination: at most MOST
    names = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "place int, deep int, fallen int, small int, market string, vol string, confirm string")
    some = prepared(spark, sf).where(F.col("r").isNotNull() & (F.col("d_px_ma60_pct") <= max(GRID["deep"])) & (F.col("size_grp") <= max(GRID["small"])))
    each = some.select(F.round(F.col("r") - X.COST, 9).alias("net"), _chosen(tests)).select("net", "g.place")
    v = F.col("net")
    out = each.groupBy("place").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg((v > 0).cast("double")).alias("win"), ratio(F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))).alias("pf")).where(F.col("n") >= LEAST)
    out = out.select("place", "n", *r6("mean", "win", "pf", sharpe=ratio("mean", "sd"))).withColumn("twins", F.count("*").over(Window.partitionBy("n", "mean", "sharpe")))
    return out.join(F.broadcast(names), "place").orderBy(F.desc("sharpe"), "place").limit(TOP).select(*GRID, "n", "mean", "sharpe", "win", "pf", "twins")


# ---- factors, cases -------------------------------------------------------------------------------------------------

FACTORS = ("ret5", "ret10", "ret20", "ret40", "ret60", "px_ma20_pct", "px_ma60_pct", "px_ma120_pct", "hv20", "rvol20", "vt_5_20", "turnover", "amt20_lag")


def _regime_sql(source: str, factors: tuple[str, ...]) -> str:
    return ", lg AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, day, code, bull, round({f} + {S.NUDGE}, 7) AS x, round(oret_sig + {S.NUDGE}, 7) AS y FROM {source}" for f in factors) + f"""),
    k1 AS (SELECT *, count(*) OVER (PARTITION BY factor, day) AS n, row_number() OVER (PARTITION BY factor, day ORDER BY x, code) AS rk, {S.rank_pct('x', 'factor, day')} AS rx, {S.rank_pct('y', 'factor, day')} AS ry FROM lg WHERE x IS NOT NULL AND y IS NOT NULL AND bull IS NOT NULL),
    k2 AS (SELECT *, least(4, floor((rk - 1) * 5.0 / n))::INTEGER AS q FROM k1 WHERE n >= 30), dq AS (SELECT factor, bull, day, corr(rx, ry) AS ic FROM k2 GROUP BY ALL), ic AS (SELECT factor, bull, count(*) AS days, avg(ic) AS ic, avg(ic) * sqrt(count(*)) / nullif(stddev_samp(ic), 0) AS t FROM dq WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY ALL),
    qs AS (SELECT factor, bull, {', '.join(f'avg(y) FILTER (q = {i}) AS q{i + 1}' for i in range(5))}, count(*) AS n FROM k2 GROUP BY ALL)
    SELECT factor, bull, n, days, {', '.join(f'round(q{i}, 6) AS q{i}' for i in range(1, 6))}, round(q5 - q1, 6) AS spread, round(ic, 6) AS ic, round(t, 5) AS t FROM qs JOIN ic USING (factor, bull)"""


def _regimes(rows: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    seven = lambda c: F.round(F.col(c).cast("double") + S.NUDGE, 7)  # noqa: E731  (ranks do not hang on a last bit)
    days = X.factor_days(rows.where("bull IS NOT NULL AND oret_sig IS NOT NULL").select("day", "code", "bull", seven("oret_sig").alias("y"), *(seven(f).alias(f) for f in factors)), factors)
    ic = F.when(~F.isnan("ic"), F.col("ic"))
    out = days.groupBy("factor", "bull").agg(F.sum("k").alias("n"), F.count(ic).alias("days"), F.avg(ic).alias("ic"), F.stddev_samp(ic).alias("sd"), *((F.sum(f"s{i}") / F.sum(f"c{i}")).alias(f"q{i + 1}") for i in range(5))).where("days > 0")
    t = ratio(F.col("ic") * F.sqrt(F.col("days").cast("double")), "sd")
    return out.select("factor", "bull", "n", "days", *r6(*(f"q{i}" for i in range(1, 6)), "ic", spread=F.col("q5") - F.col("q1")), F.round(t, 5).alias("t"))


@query("factor_regimes", S.with_(ROWS, _regime_sql("rws", FACTORS)))
def factor_regimes(spark, sf):
    """By factor and market: mean return of five first-come groups a day, and the rank correlation over days of 30 rows."""
    return _regimes(prepared(spark, sf), FACTORS)


#: Factors of an entity's group, its strength, its volume, its oscillator and its range.
WIDER = ("ind_ret20", "ind_ret60", "rs_mkt20", "rs_mkt60", "rs_ind20", "vr20", "volz20", "ud_vol20", "hist", "atr_pct")
WIDER_SQL = ROWS + GRP + MKT + f""", mn AS (SELECT date, day, product(1 + coalesce(mkt_ret, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM mkt), mr AS (SELECT date, nav / lag(nav, 20) OVER (ORDER BY day) - 1 AS mkt_ret20, nav / lag(nav, 60) OVER (ORDER BY day) - 1 AS mkt_ret60 FROM mn),
    e1 AS ({S.ewm('rws', 'close', 12, 'f')}), e2 AS ({S.ewm('rws', 'close', 26, 's')}), df AS MATERIALIZED (SELECT code, date, f - s AS dif FROM e1 JOIN e2 USING (code, date)), e3 AS ({S.ewm('df', 'dif', 9, 'dea')}),
    vo AS (SELECT code, date, close, {S.ratio('volume', S.mean('volume', 20, past=True))} AS vr20, (volume - {S.mean('volume', 20, past=True)}) / nullif({S.rolling('stddev_samp(volume)', 'volume', 20, past=True)}, 0) AS volz20, {ud_sql(20)},
        CASE WHEN {S.lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')})) END AS range FROM rws),
    tw AS (SELECT *, {S.mean('range', 14)} / close AS atr_pct FROM vo),
    wd AS MATERIALIZED (SELECT r.day, r.code, r.bull, r.oret_sig, ind_ret20, ind_ret60, ret20 - mkt_ret20 AS rs_mkt20, ret60 - mkt_ret60 AS rs_mkt60, ret20 - ind_ret20 AS rs_ind20, vr20, volz20, ud_vol20, 2 * (dif - dea) AS hist, atr_pct
        FROM rws r JOIN tw USING (code, date) JOIN df USING (code, date) JOIN e3 USING (code, date) LEFT JOIN grp ON grp.date = r.date AND grp.ind_code = r.ind_code LEFT JOIN mr ON mr.date = r.date)"""


def wider_factors(spark, sf) -> DataFrame:
    """The rows with WIDER: what runs along time shares one shuffle by entity, groups and the market join behind it."""
    rows = prepared(spark, sf).select("code", "date", "day", "ind_code", "high", "low", "close", "volume", "ret", "ret20", "ret60", "bull", "oret_sig")
    along = I.macd(I.ranges(I.up_down_volume(I.volume_trend(I.relative_volume(rows)))))
    kept = along.select("code", "date", "day", "ind_code", "ret20", "ret60", "bull", "oret_sig", "vr20", "volz20", "ud_vol20", "hist", "atr_pct")
    groups = X.group_returns(base(spark, sf), ["ind_code"], (20, 60), "ind").select("date", "ind_code", "ind_ret20", "ind_ret60")
    w = Window.orderBy("day")  # a row per period
    nav = X.market_returns(base(spark, sf)).withColumn("nav", F.product(1 + F.coalesce("mkt_ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nav = nav.select("date", *((F.col("nav") / F.lag("nav", k).over(w) - 1).alias(f"mkt_ret{k}") for k in (20, 60)))
    out = kept.join(groups, ["date", "ind_code"], "left").join(F.broadcast(nav), "date", "left")
    return out.withColumns({f"rs_mkt{k}": F.col(f"ret{k}") - F.col(f"mkt_ret{k}") for k in (20, 60)} | {"rs_ind20": F.col("ret20") - F.col("ind_ret20")})


@query("factor_regimes_wider", S.with_(WIDER_SQL, _regime_sql("wd", WIDER)))
def factor_regimes_wider(spark, sf):
    """The same study over strength, groups, volume, oscillator and range, which the prepared rows do not hold."""
    return _regimes(wider_factors(spark, sf), WIDER)


CASES = ROWS + f""", kinds AS (SELECT unnest(['any', 'bear', 'bull']) AS kind), cs0 AS (SELECT kind, code, row, day FROM rws JOIN kinds ON kind = 'any' OR bull = (kind = 'bull') WHERE d_px_ma60_pct BETWEEN 1 AND 3 AND size_grp BETWEEN 0 AND 2),
    csl AS (SELECT kind, c.day + j AS day, x.oret_sig AS ret FROM cs0 c JOIN range(0, {HOLD}) t(j) ON true JOIN rws x ON x.code = c.code AND x.row = c.row + j WHERE x.oret_sig IS NOT NULL), cdl AS (SELECT kind, day, avg(ret) AS gross FROM csl GROUP BY ALL),
    cpf AS (SELECT kind, cal.day, cal.date, coalesce(gross - 0.003 / {HOLD}, 0) AS ret, gross IS NULL AS idle FROM cal CROSS JOIN kinds LEFT JOIN cdl USING (kind, day)), cnv AS MATERIALIZED (SELECT *, product(1 + ret) OVER (PARTITION BY kind ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM cpf)"""


def _cases(spark, sf) -> DataFrame:
    """Daily return and value of the flagship in any, a falling and a rising market: (kind, day, date, ret, idle, nav)."""
    rows = prepared(spark, sf)
    df = rows.where("d_px_ma60_pct BETWEEN 1 AND 3 AND size_grp BETWEEN 0 AND 2")
    tests = [(F.lit(True), {"kind": F.lit("any")}), (~F.col("bull"), {"kind": F.lit("bear")}), (F.col("bull"), {"kind": F.lit("bull")})]
    chosen = df.select("code", "row", "day", _chosen(tests)).select("code", "row", "day", "g.kind")
    daily = D.slots(chosen, rows, HOLD, "kind").groupBy("kind", "day").agg(F.avg("ret").alias("gross"))
    grid = _days(spark, sf).select("day", "date", F.explode(F.array(*map(F.lit, ("any", "bear", "bull")))).alias("kind"))
    out = grid.join(daily, ["kind", "day"], "left").select("kind", "day", "date", F.coalesce(F.col("gross") - X.COST / HOLD, F.lit(0.0)).alias("ret"), F.col("gross").isNull().alias("idle"))
    return out.withColumn("nav", F.product(1 + F.col("ret")).over(Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("case_runner", S.with_(CASES, "SELECT kind, count(*) AS days, round(max_by(nav, day) ** (252.0 / count(*)) - 1, 6) AS cagr, round(min(fall), 6) AS mdd, round(avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0), 6) AS sharpe, round(avg(CASE WHEN idle THEN 1.0 ELSE 0.0 END), 6) AS idle FROM (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY kind ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM cnv) GROUP BY kind"))
def case_runner(spark, sf):
    top = F.max("nav").over(Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    df = _cases(spark, sf).withColumn("fall", F.col("nav") / F.greatest(top, F.lit(1.0)) - 1)
    out = df.groupBy("kind").agg(F.count("*").alias("days"), F.max_by("nav", "day").alias("end"), F.min("fall").alias("mdd"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.avg(F.col("idle").cast("double")).alias("idle"))
    return out.select("kind", "days", *r6("mdd", "idle", cagr=F.pow("end", X.YEAR / F.col("days")) - 1, sharpe=ratio(F.col("m") * X.YEAR**0.5, "sd")))


@query("robust_years", S.with_(CASES, "SELECT year(date)::INTEGER AS year, round(product(1 + ret) FILTER (kind = 'bear') - 1, 6) AS bear, round(product(1 + ret) FILTER (kind = 'bull') - 1, 6) AS bull, round(product(1 + ret) FILTER (kind = 'bear') - product(1 + ret) FILTER (kind = 'bull'), 6) AS diff, CASE WHEN round(product(1 + ret) FILTER (kind = 'bear') - product(1 + ret) FILTER (kind = 'bull'), 9) > 0 THEN 'bear' ELSE 'bull' END AS winner FROM cnv GROUP BY 1 HAVING count(DISTINCT day) >= 20"))
def robust_years(spark, sf):
    """Which of two markets paid in each year of at least 20 periods."""
    part = lambda k: F.product(F.when(F.col("kind") == k, 1 + F.col("ret")))
    out = _cases(spark, sf).groupBy(F.year("date").alias("year")).agg(part("bear").alias("a"), part("bull").alias("b"), F.countDistinct("day").alias("days")).where("days >= 20")
    won = F.when(F.round(F.col("a") - F.col("b"), 9) > 0, "bear").otherwise("bull")
    return out.select("year", *r6(bear=F.col("a") - 1, bull=F.col("b") - 1, diff=F.col("a") - F.col("b")), won.alias("winner"))


_H = (1, 5, 10, 20, 40, 60)


@query("stats_bundle", S.with_(ROWS + MKT + CHAIN, ", fx AS (SELECT code, row, day, " + ", ".join(f"{S.lead('open', h + 1)} / {S.lead('open')} - 1 AS f{h}" for h in _H) + " FROM rws), fs AS (SELECT fx.* FROM fx JOIN sg ON sg.code = fx.code AND sg.row = fx.row), fe AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, round(f{h}, 9) AS v, round(f{h} - chain{h}, 9) AS e FROM fs JOIN chain USING (day)" for h in _H) + ") SELECT horizon, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(e), 6) AS mean_ex, round(avg(CASE WHEN e > 0 THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END), 6) AS win_ex FROM fe WHERE v IS NOT NULL GROUP BY horizon HAVING count(v) >= 50"))
def stats_bundle(spark, sf):
    """The headline figures of a signal at six horizons, beside the market's chained return; none below 50 signals."""
    chain = X.forward_chain(X.market_returns(base(spark, sf)), _H).select("day", *(f"chain{h}" for h in _H))  # a row per period
    df = I.returns(prepared(spark, sf), back=(), ahead=_H).where("signal").join(F.broadcast(chain), "day")
    each = df.select(_structs([{"horizon": F.lit(h), "v": F.round(f"fwd{h}", 9), "e": F.round(F.col(f"fwd{h}") - F.col(f"chain{h}"), 9)} for h in _H])).select("g.*").where("v IS NOT NULL")
    out = each.groupBy("horizon").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.avg((F.col("v") > 0).cast("double")).alias("win"), F.avg("e").alias("mean_ex"), F.avg((F.col("e") > 0).cast("double")).alias("win_ex")).where("n >= 50")
    out = X.with_quantiles(out, each, ["horizon"], "v", {"median": 0.5})
    return out.select("horizon", "n", *r6("mean", "median", "win", "mean_ex", "win_ex"))


# ---- small rules ----------------------------------------------------------------------------------------------------


@query("null_fills", "SELECT s_suppkey AS code, coalesce(n_name, '未知') AS ind_name, coalesce(nullif(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END, ''), '') AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = s_nationkey")
def null_fills(spark, sf):
    """Dimensions that are missing get their fixed label, names an empty text."""
    known = table(spark, sf, "nation").where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("ind_name"))  # a fixed number of rows
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_name")).alias("name"))
    return rows.join(F.broadcast(known), F.col("s_nationkey") == F.col("n_nationkey"), "left").fillna({"ind_name": "未知", "name": ""}).select("code", "ind_name", "name")


@query("ordered_unique", "WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderdate) AS d, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY ALL) SELECT o_custkey AS cust, string_agg(p, ',' ORDER BY d, k) AS priorities FROM f GROUP BY 1")
def ordered_unique(spark, sf):
    """Distinct values in the order of their first appearance: first places by value, so that no list holds repeats."""
    first = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("at"))
    out = first.groupBy(F.col("o_custkey").alias("cust")).agg(F.sort_array(F.collect_list(F.struct("at", "o_orderpriority"))).alias("l"))
    return out.select("cust", F.array_join(F.transform("l", lambda x: x["o_orderpriority"]), ",").alias("priorities"))
