"""Queries from signals to trades, portfolios and studies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entity, lead, ratio
from ..operators import cross as X
from ..operators import simulate as D
from ..sources.files import staged
from ..sources.panel import panel
from . import query as Q
from . import sql as S
from .catalog_cross import HOLD, STATES, along, periods, r6, states
from .catalog_windows import base
from .catalog_windows import days as _days

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The flagship selection: deepest three deciles against the 60-period mean, smallest 30 %, falling market.
DEEP = Q.Params(ranges={"px_ma60_pct": (1, 3)})


def query(name: str, oracle: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = S.nudged(oracle)
        return f

    return add


def prepared(spark, sf) -> DataFrame:
    """Rows with deciles, market state, fills and the flagship's signal.

    Written are only what runs along time and, a row a period, the bounds of the bins and the market; a query binds the
    two by a broadcast join and works out the bins that it asks for, so wide rows are never dealt out by period.
    """
    of_period = periods(spark, sf)
    df = X.with_deciles(along(spark, sf), cuts=of_period)
    market = F.broadcast(of_period.select("date", "bull", "mkt_hv20", "hv_med", "breadth"))  # a row a period
    return df.join(market, "date", "left").withColumn("signal", Q.predicate(DEEP)[0])


ROWS = STATES + f""", f1 AS (SELECT dec.*, round({S.lead('open')} / open - 1, 10) AS oret, {S.lead('open', 2)} / {S.lead('open')} - 1 AS oret_sig,
    first_value(CASE WHEN can_sell THEN open END IGNORE NULLS) OVER ({S.E_} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS so FROM dec),
f2 AS (SELECT f1.*, {S.lead('CASE WHEN can_buy THEN open END')} AS buy_px, {S.lead('so', 1 + HOLD)} AS sell_px, {S.lead('day')} AS entry_day, {S.lead('day', 1 + HOLD)} AS due_day, {S.lead('open')} IS NOT NULL AS has_entry, {S.lead('open', 1 + HOLD)} IS NOT NULL AS has_exit FROM f1),
rws AS MATERIALIZED (SELECT f2.*, sell_px / buy_px - 1 AS r, bull, s.hv20 AS mkt_hv20, hv_med, breadth, coalesce(d_px_ma60_pct BETWEEN 1 AND 3, false) AND coalesce(size_grp BETWEEN 0 AND 2, false) AND coalesce(NOT bull, false) AS signal
    FROM f2 LEFT JOIN (SELECT * FROM states WHERE index = 'all' AND ma_len = 60) s USING (day)),
sg AS MATERIALIZED (SELECT * FROM rws WHERE signal), tr AS MATERIALIZED (SELECT *, r - 0.003 AS net FROM sg WHERE r IS NOT NULL)"""


@query("signal_mask", S.with_(ROWS, "SELECT code, date, d_px_ma60_pct, size_grp, bull, signal FROM rws"))
def signal_mask(spark, sf):
    return prepared(spark, sf).select("code", "date", "d_px_ma60_pct", "size_grp", "bull", "signal")


CONFIRMED = Q.Params(ranges={"ret20": (1, 4), "hv20": (None, 9)}, size=(9, 1), market="bull", volatility="low", breadth=(0.2, 0.9), deep=False, confirm=("ma5", "volup", "up2"))


@query("signal_mask_confirmed", S.with_(ROWS, "SELECT code, date FROM rws WHERE d_ret20 BETWEEN 1 AND 4 AND d_hv20 BETWEEN 1 AND 9 AND size_grp BETWEEN 1 AND 9 AND bull AND mkt_hv20 <= hv_med AND breadth >= 0.2 AND breadth <= 0.9 AND close > ma5 AND rvol20 > 1.2 AND oret > 0"))
def signal_mask_confirmed(spark, sf):
    return prepared(spark, sf).where(Q.predicate(CONFIRMED)[0]).select("code", "date")


@query("pool_filter", S.with_(ROWS, "SELECT code, date FROM rws WHERE ind_code IN (3, 5, 9, 16) AND board IN ('ASIA', 'EUROPE')"))
def pool_filter(spark, sf):
    pool = Q.Pool(industries=(3, 5, 9, 16), boards=("ASIA", "EUROPE"))
    return prepared(spark, sf).where(Q.in_pool(pool, F.col("code"), F.col("ind_code"), F.col("board"))).select("code", "date")


@query("penny_filter", S.with_(S.CLEAN, f", p AS (SELECT code, date, sum(CASE WHEN close < 95 THEN 1 ELSE 0 END) OVER {S.frame(20)} AS below, count(close) OVER {S.frame(20)} AS n FROM base) SELECT code, date, CASE WHEN n >= 20 THEN below ELSE 0 END AS below, (CASE WHEN n >= 20 THEN below ELSE 0 END) >= 10 AS penny FROM p"))
def penny_filter(spark, sf):
    w = entity().rowsBetween(-19, 0)
    below = F.when(F.count("close").over(w) >= 20, F.sum(F.when(F.col("close") < 95, 1).otherwise(0)).over(w)).otherwise(0)
    return base(spark, sf).select("code", "date", below.alias("below"), (below >= 10).alias("penny"))


@query("scan_latest", S.with_(ROWS, """, big AS (SELECT day FROM rws GROUP BY day HAVING count(*) > (SELECT count(DISTINCT code) FROM rws) / 2), lastd AS (SELECT max(day) AS day FROM sg WHERE day IN (SELECT day FROM big) AND day >= (SELECT max(day) FROM big) - 180)
    SELECT code, date, round(close, 6) AS close, d_ret60, d_ret40, size_grp, bull, round(coalesce((11 - d_ret60) * 6, 0) + coalesce((11 - d_ret40) * 3, 0) + coalesce((10 - size_grp) * 4, 0) - coalesce(greatest(-1, least(1, px_ma60_pct)) * 10, 0) - coalesce(greatest(-1, least(1, ret40)) * 5, 0), 6) AS score
    FROM sg WHERE day = (SELECT day FROM lastd) ORDER BY score DESC, code LIMIT 200"""))
def scan_latest(spark, sf):
    df = prepared(spark, sf)
    per_day = df.groupBy("day").agg(F.count("*").alias("n"), F.count(F.when(F.col("signal"), 1)).alias("hits"))
    total = df.select(F.countDistinct("code").alias("codes"))
    big = per_day.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("codes") / 2)  # one row beside one per period
    last = big.agg(F.max("day").alias("end"), F.max(F.when(F.col("hits") > 0, F.col("day"))).alias("last")).where("last >= end - 180")
    found = df.where("signal").join(F.broadcast(last), F.col("day") == F.col("last")).withColumn("score", F.round(Q.score() + S.NUDGE, 6))
    return found.orderBy(F.desc("score"), "code").limit(200).select("code", "date", *r6("close"), "d_ret60", "d_ret40", "size_grp", "bull", "score")


@query("top_k_daily", S.with_(ROWS, " SELECT day, code, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY px_ma60_pct NULLS LAST, code) AS rk FROM sg) WHERE rk <= 3"))
def top_k_daily(spark, sf):
    w = Window.partitionBy("day").orderBy(Q.PICKS["deep"]().asc_nulls_last(), "code")
    return prepared(spark, sf).where("signal").withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("day", "code", "rk")


def _trades(spark, sf):
    return D.trades(prepared(spark, sf).where("signal"))


@query("trades_fixed_hold", S.with_(ROWS, "SELECT code, date, entry_day, due_day, round(buy_px, 6) AS buy_px, round(sell_px, 6) AS sell_px, round(net, 6) AS net FROM tr"))
def trades_fixed_hold(spark, sf):
    return _trades(spark, sf).select("code", "date", "entry_day", "due_day", *r6("buy_px", "sell_px", "net"))


@query("open_positions", S.with_(ROWS, "SELECT state, count(*) AS n FROM (SELECT CASE WHEN r IS NOT NULL THEN 'closed' WHEN has_entry AND buy_px IS NULL THEN 'nobuy' WHEN NOT has_entry THEN 'pending' WHEN has_exit THEN 'stuck' ELSE 'holding' END AS state FROM sg) GROUP BY state"))
def open_positions(spark, sf):
    return prepared(spark, sf).where("signal").groupBy(D.open_state().alias("state")).agg(F.count("*").alias("n"))


STATS = "count({v}) AS n, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median, round(avg(CASE WHEN {v} > 0 THEN 1.0 WHEN {v} IS NOT NULL THEN 0.0 END), 6) AS win, round(quantile_cont({v}, 0.1), 6) AS p10, round(quantile_cont({v}, 0.9), 6) AS p90, round(avg({v}) FILTER ({v} > 0) / nullif(-avg({v}) FILTER ({v} < 0), 0), 6) AS payoff, round(sum({v}) FILTER ({v} > 0) / nullif(-sum({v}) FILTER ({v} < 0), 0), 6) AS pf"
_T = ["mean", "median", "win", "p10", "p90", "payoff", "pf"]


@query("trade_stats", S.with_(ROWS, f"SELECT {STATS.format(v='net')} FROM tr"))
def trade_stats(spark, sf):
    return D.trade_stats(_trades(spark, sf)).select("n", *r6(*_T))


CHAINED = ROWS + ", mkt AS (SELECT day, avg(oret) AS m FROM rws GROUP BY day), mc AS (SELECT *, sum(ln(1 + coalesce(m, 0))) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS s FROM mkt), bench AS (SELECT day, exp(lead(s, 20) OVER (ORDER BY day) - s) - 1 AS b FROM mc), ex AS (SELECT tr.*, net - b AS excess FROM tr LEFT JOIN bench ON bench.day = tr.entry_day)"


def _excess(spark, sf):
    df = prepared(spark, sf)
    w = Window.orderBy("day")
    daily = df.groupBy("day").agg(F.avg("oret").alias("m")).withColumn("s", F.sum(F.log1p(F.coalesce("m", F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bench = daily.select(F.col("day").alias("entry_day"), F.expm1(F.lead("s", HOLD).over(w) - F.col("s")).alias("b"))
    return D.trades(df.where("signal")).join(F.broadcast(bench), "entry_day", "left").withColumn("excess", F.col("net") - F.col("b"))


@query("trade_summary", S.with_(CHAINED, "SELECT count(net) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS std, round(max(net), 6) AS best, round(min(net), 6) AS worst, round(quantile_cont(net, 0.25), 6) AS p25, round(quantile_cont(net, 0.75), 6) AS p75, round(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net <= 0), 0), 6) AS pf, round(avg(excess), 6) AS avg_excess, round(avg(CASE WHEN excess > 0 THEN 1.0 WHEN excess IS NOT NULL THEN 0.0 END), 6) AS excess_win, count(DISTINCT code) AS n_stock, min(date) AS first, max(date) AS last FROM ex"))
def trade_summary(spark, sf):
    return D.trade_summary(_excess(spark, sf)).select("n", *r6("mean", "std", "best", "worst", "p25", "p75", "pf", "avg_excess", "excess_win"), "n_stock", "first", "last")


#: Written out, apart from the code that it checks.
_HB = """WHEN v >= -1 AND v < -0.5 THEN 0 WHEN v >= -0.5 AND v < -0.3 THEN 1 WHEN v >= -0.3 AND v < -0.2 THEN 2 WHEN v >= -0.2 AND v < -0.1 THEN 3
    WHEN v >= -0.1 AND v < -0.05 THEN 4 WHEN v >= -0.05 AND v < 0 THEN 5 WHEN v >= 0 AND v < 0.05 THEN 6 WHEN v >= 0.05 AND v < 0.1 THEN 7
    WHEN v >= 0.1 AND v < 0.2 THEN 8 WHEN v >= 0.2 AND v < 0.3 THEN 9 WHEN v >= 0.3 AND v < 0.5 THEN 10 WHEN v >= 0.5 AND v < 1 THEN 11 WHEN v >= 1 AND v <= 2 THEN 12"""


@query("trade_hist", S.with_(ROWS, f"SELECT bin, count(*) AS n FROM (SELECT CASE {_HB} END AS bin FROM (SELECT round(net, 9) AS v FROM tr)) WHERE bin IS NOT NULL GROUP BY bin"))
def trade_hist(spark, sf):
    return D.histogram(_trades(spark, sf).withColumn("net", F.round("net", 9)))


@query("yearly_trades", S.with_(ROWS, "SELECT year(cal.date)::INTEGER AS year, count(*) AS n, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(sum(net), 6) AS total FROM tr JOIN cal ON cal.day = tr.entry_day GROUP BY 1 HAVING count(*) >= 5"))
def yearly_trades(spark, sf):
    days = _days(spark, sf).select(F.col("day").alias("entry_day"), F.year("date").alias("year"))
    out = _trades(spark, sf).join(F.broadcast(days), "entry_day").groupBy("year").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win"), F.sum("net").alias("total"))
    return out.where("n >= 5").select("year", "n", *r6("mean", "win", "total"))


@query("best_worst_trades", S.with_(ROWS, "(SELECT 'best' AS side, code, date, round(net, 6) AS net FROM tr ORDER BY round(net, 6) DESC, code, date LIMIT 20) UNION ALL (SELECT 'worst', code, date, round(net, 6) FROM tr ORDER BY round(net, 6), code, date LIMIT 20)"))
def best_worst_trades(spark, sf):
    df = _trades(spark, sf).select("code", "date", *r6("net"))
    best = df.orderBy(F.desc("net"), "code", "date").limit(20).select(F.lit("best").alias("side"), "*")
    return best.unionByName(df.orderBy("net", "code", "date").limit(20).select(F.lit("worst").alias("side"), "*"))


@query("trades_page", S.with_(ROWS, "SELECT code, date, round(net, 6) AS net FROM tr WHERE net > 0 AND net <= 0.5 ORDER BY round(net, 6) DESC, code, date LIMIT 50 OFFSET 50"))
def trades_page(spark, sf):
    return _trades(spark, sf).where("net > 0 AND net <= 0.5").select("code", "date", *r6("net")).orderBy(F.desc("net"), "code", "date").offset(50).limit(50)


#: Overlapping tranches of the flagship.
PORT = ROWS + f""", sl AS (SELECT sg.day + j AS day, x.oret_sig AS ret FROM sg JOIN range(0, {HOLD}) t(j) ON true JOIN rws x ON x.code = sg.code AND x.row = sg.row + j WHERE x.oret_sig IS NOT NULL),
dl AS (SELECT day, avg(ret) AS gross, count(*) AS n FROM sl GROUP BY day), pf AS (SELECT cal.day, cal.date, coalesce(n, 0) AS n, coalesce(gross - 0.003 / {HOLD}, 0) AS ret FROM cal LEFT JOIN dl USING (day)),
nv AS MATERIALIZED (SELECT *, product(1 + ret) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM pf)"""


def _portfolio(spark, sf):
    return D.portfolio(prepared(spark, sf), _days(spark, sf), HOLD)


@query("portfolio_nav", S.with_(PORT, "SELECT day, date, n, round(ret, 6) AS ret, round(nav, 6) AS nav FROM nv"))
def portfolio_nav(spark, sf):
    return _portfolio(spark, sf).select("day", "date", "n", *r6("ret", "nav"))


@query("state_nav", S.with_(ROWS, ", d AS (SELECT day, avg(oret_sig) AS g, count(oret_sig) AS n FROM sg GROUP BY day), p AS (SELECT cal.day, cal.date, coalesce(n, 0) AS n, coalesce(g, 0) AS ret FROM cal LEFT JOIN d USING (day)) SELECT day, date, n, round(ret, 6) AS ret, round(product(1 + ret) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS nav FROM p"))
def state_nav(spark, sf):
    return D.state_portfolio(prepared(spark, sf).where("signal"), _days(spark, sf)).select("day", "date", "n", *r6("ret", "nav"))


@query("annual_stats", S.with_(PORT, ", x AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM nv) SELECT count(*) AS days, round(max_by(nav, day) ** (252.0 / count(*)) - 1, 6) AS cagr, round(min(fall), 6) AS mdd, round(avg(ret) * sqrt(252) / stddev_samp(ret), 6) AS sharpe, round(avg(ret) * 252, 6) AS ann_arith, round(stddev_samp(ret) * sqrt(252), 6) AS vol FROM x"))
def annual_stats(spark, sf):
    return D.annual_stats(_portfolio(spark, sf)).select("days", *r6("cagr", "mdd", "sharpe", "ann_arith", "vol"))


@query("yearly_nav", S.with_(PORT, ", y AS (SELECT *, year(date)::INTEGER AS year, product(1 + ret) OVER (PARTITION BY year(date) ORDER BY day ROWS UNBOUNDED PRECEDING) AS v FROM nv), z AS (SELECT *, v / greatest(max(v) OVER (PARTITION BY year ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS f FROM y) SELECT year, count(*) AS days, round(max_by(v, day) - 1, 6) AS ret, round(min(f), 6) AS mdd FROM z GROUP BY year HAVING count(*) >= 20"))
def yearly_nav(spark, sf):
    return D.yearly(_portfolio(spark, sf)).select("year", "days", *r6("ret", "mdd"))


CUTS = {"early": (1995, 1997), "middle": (1998, 1999), "late": (2000, 2001), "in_sample": (1995, 1998), "out_of_sample": (1999, 2001)}


@query("segments", S.with_(PORT, "SELECT " + ", ".join(f"round(coalesce(product(1 + ret) FILTER (year(date) BETWEEN {a} AND {b}), 1) - 1, 6) AS {k}" for k, (a, b) in CUTS.items()) + " FROM nv"))
def segments(spark, sf):
    return D.segments(_portfolio(spark, sf), CUTS).select(*r6(*CUTS))


@query("nav_sample", S.with_(PORT, "SELECT day, round(nav, 6) AS nav FROM nv WHERE day % greatest(1, (SELECT count(*) FROM nv) // 100) = 0"))
def nav_sample(spark, sf):
    nav = _portfolio(spark, sf)
    size = nav.agg(F.count("*").alias("days"))
    step = F.greatest(F.lit(1), F.floor(F.col("days") / 100))
    return nav.crossJoin(F.broadcast(size)).where(F.col("day") % step == 0).select("day", *r6("nav"))  # one row


def _stop_sql(kind: str) -> str:
    low = "close" if kind == "close" else "low"
    out = "b2.open" if kind == "close" else "CASE WHEN b.open <= line * (1 + 1e-9) THEN b.open ELSE line END"
    last = HOLD + 1
    return S.with_(ROWS, f""", e AS (SELECT sg.code, sg.date, sg.row, x.open AS entry, sl.stop, x.open * (1 - sl.stop) AS line FROM sg JOIN rws x ON x.code = sg.code AND x.row = sg.row + 1 CROSS JOIN (SELECT unnest([0.02, 0.05, 0.1]) AS stop) sl
        WHERE EXISTS (SELECT 1 FROM rws z WHERE z.code = sg.code AND z.row = sg.row + {last})),
    h AS (SELECT e.code, e.date, e.stop, min(y.row) AS at FROM e JOIN rws y ON y.code = e.code AND y.row BETWEEN e.row + 1 AND e.row + {HOLD} AND y.{low} <= e.line * (1 + 1e-9) GROUP BY ALL),
    o AS (SELECT e.*, h.at, CASE WHEN h.at IS NOT NULL THEN {out} ELSE f.open END / entry - 1 AS r FROM e LEFT JOIN h USING (code, date, stop) LEFT JOIN rws b ON b.code = e.code AND b.row = h.at LEFT JOIN rws b2 ON b2.code = e.code AND b2.row = h.at + 1 LEFT JOIN rws f ON f.code = e.code AND f.row = e.row + {last})
    SELECT stop, count(r) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS win FROM o GROUP BY stop""")


def _stops(spark, sf, kind):
    df = D.with_bars(prepared(spark, sf), HOLD, which="signal")
    grid = F.array(*(F.struct(F.lit(s).alias("stop"), D.stop_return(HOLD, s, kind).alias("r")) for s in (0.02, 0.05, 0.1)))
    out = df.select(F.explode(grid).alias("g")).select("g.*").groupBy("stop").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("win"))
    return out.select("stop", "n", *r6("mean", "win"))


@query("stop_loss_close", _stop_sql("close"))
def stop_loss_close(spark, sf):
    return _stops(spark, sf, "close")


@query("stop_loss_intraday", _stop_sql("intraday"))
def stop_loss_intraday(spark, sf):
    return _stops(spark, sf, "intraday")


@query("signal_lag", S.with_(ROWS, " UNION ALL ".join(f"SELECT {k} AS lag, count(net) AS n, round(avg(net), 6) AS mean FROM (SELECT r - 0.003 AS net, lag(signal, {k}, false) OVER ({S.E_}) AS s FROM rws) WHERE s AND net IS NOT NULL" for k in (0, 1, 2, 3, 5, 10))))
def signal_lag(spark, sf):
    df = prepared(spark, sf)
    late = df.select("r", *((F.lag("signal", k, False).over(entity()) if k else F.col("signal")).alias(f"s{k}") for k in (0, 1, 2, 3, 5, 10)))
    each = late.where("r IS NOT NULL").select("r", F.explode(F.array(*(F.when(F.col(f"s{k}"), k) for k in (0, 1, 2, 3, 5, 10)))).alias("lag")).where("lag IS NOT NULL")
    return each.groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.col("r") - X.COST).alias("mean")).select("lag", "n", *r6("mean"))


@query("cost_grid", S.with_(ROWS, "SELECT cost, count(*) AS n, round(avg(r - cost), 6) AS mean, round(avg(CASE WHEN r - cost > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM tr CROSS JOIN (SELECT unnest([0.0, 0.003, 0.006, 0.012])::DOUBLE AS cost) GROUP BY cost"))
def cost_grid(spark, sf):
    each = _trades(spark, sf).select("r", F.explode(F.array(*(F.lit(c) for c in (0.0, 0.003, 0.006, 0.012)))).alias("cost"))
    net = F.col("r") - F.col("cost")
    return each.groupBy("cost").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), F.avg((net > 0).cast("double")).alias("win")).select("cost", "n", *r6("mean", "win"))


@query("executability", S.with_(ROWS, f"SELECT count(*) AS n, round(avg(CASE WHEN has_entry AND buy_px IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_buy, round(avg(CASE WHEN has_exit AND NOT due_sell THEN 1.0 ELSE 0.0 END), 6) AS late_sell FROM (SELECT *, coalesce({S.lead('can_sell', 1 + HOLD)}, false) AS due_sell FROM rws) WHERE signal"))
def executability(spark, sf):
    df = prepared(spark, sf).withColumn("due_sell", F.coalesce(lead("can_sell", 1 + HOLD), F.lit(False))).where("signal")
    return df.agg(F.count("*").alias("n"), F.avg((F.col("has_entry") & F.col("buy_px").isNull()).cast("double")).alias("no_buy"), F.avg((F.col("has_exit") & ~F.col("due_sell")).cast("double")).alias("late_sell")).select("n", *r6("no_buy", "late_sell"))


@query("bias_audit", S.with_(S.CLEAN, "SELECT board, count(*) AS rows, count(*) FILTER (is_st) AS st_rows, count(*) FILTER (days_since_list < 120) AS young_rows, count(DISTINCT code) AS codes, count(DISTINCT code) FILTER (date = (SELECT max(date) FROM panel)) AS alive FROM aged GROUP BY board"))
def bias_audit(spark, sf):
    from ..sources.panel import with_listing

    df = with_listing(panel(spark, sf))
    end = df.agg(F.max("date").alias("end"))
    return df.join(F.broadcast(end)).groupBy("board").agg(F.count("*").alias("rows"), F.count(F.when(F.col("is_st"), 1)).alias("st_rows"), F.count(F.when(F.col("days_since_list") < 120, 1)).alias("young_rows"), F.countDistinct("code").alias("codes"), F.countDistinct(F.when(F.col("date") == F.col("end"), F.col("code"))).alias("alive"))


def _variants(df: DataFrame, masks: dict) -> DataFrame:
    """One row per variant that a trade belongs to."""
    return df.where("r IS NOT NULL").select("code", "day", "r", (F.col("r") - X.COST).alias("net"), F.explode(F.array_compact(F.array(*(F.when(m, F.lit(k)) for k, m in masks.items())))).alias("variant"))


_PARTS = {"deep": "d_px_ma60_pct <= 3", "small": "size_grp <= 2", "bear": "NOT bull", "calm": "mkt_hv20 <= hv_med"}


def _by_variant(masks: dict[str, str]) -> str:
    return S.with_(ROWS, "SELECT variant, count(net) AS n, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, r - 0.003 AS net FROM rws WHERE r IS NOT NULL AND {m}" for k, m in masks.items()) + ") GROUP BY variant")


def _variant_stats(spark, sf, masks):
    out = _variants(prepared(spark, sf), {k: F.coalesce(F.expr(m), F.lit(False)) for k, m in masks.items()}).groupBy("variant").agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win"))
    return out.select("variant", "n", *r6("mean", "win"))


_FUNNEL = {f"{i}_{k}": " AND ".join(list(_PARTS.values())[: i + 1]) for i, k in enumerate(_PARTS)}
_ABLATION = {f"without_{k}": " AND ".join(v for j, v in _PARTS.items() if j != k) for k in _PARTS} | {f"only_{k}": v for k, v in _PARTS.items()}
_CONFIRM = {"baseline": "signal", "ma5": "signal AND close > ma5", "ma10": "signal AND close > ma10", "ma20": "signal AND close > ma20", "volup": "signal AND rvol20 > 1.2", "up2": "signal AND oret > 0"}
_BENCH = {"all": "true", "small": "size_grp <= 2", "cheap20": "d_px_ma60_pct <= 2", "strong20": "d_px_ma60_pct >= 9", "losers": "d_ret60 = 1", "winners": "d_ret60 = 10", "calm": "d_hv20 <= 2", "wild": "d_hv20 >= 9", "quiet": "d_rvol20 <= 2"}
_STAGES = {"1_oversold": "d_ret60 <= 2", "2_drying": "d_ret60 <= 2 AND vt_5_20 < 1", "3_reversal": "d_ret60 <= 2 AND vt_5_20 < 1 AND close > ma5"}


def _register(name: str, masks: dict[str, str], doc: str) -> None:
    def run(spark, sf):
        return _variant_stats(spark, sf, masks)

    run.__doc__ = doc
    query(name, _by_variant(masks))(run)


_register("funnel", _FUNNEL, "Conditions added one by one.")
_register("ablation", _ABLATION, "All conditions but one, and each alone.")
_register("confirm_grid", _CONFIRM, "The flagship with each confirmation.")
_register("benchmarks", _BENCH, "Plain selections to compare with.")
_register("stage_pipeline", _STAGES, "Oversold, then quiet, then turning.")


@query("funnel_deltas", S.with_(ROWS, ", v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, r - 0.003 AS net FROM rws WHERE r IS NOT NULL AND {m}" for k, m in _FUNNEL.items()) + "), a AS (SELECT variant, count(net) AS n, avg(net) AS mean FROM v GROUP BY variant) SELECT variant, n, round(mean - lag(mean) OVER (ORDER BY variant), 6) AS delta FROM a"))
def funnel_deltas(spark, sf):
    out = _variants(prepared(spark, sf), {k: F.coalesce(F.expr(m), F.lit(False)) for k, m in _FUNNEL.items()}).groupBy("variant").agg(F.count("net").alias("n"), F.avg("net").alias("mean"))
    return out.select("variant", "n", *r6(delta=F.col("mean") - F.lag("mean").over(Window.orderBy("variant"))))  # a row per stage


@query("entry_year", S.with_(ROWS, "SELECT year(date)::INTEGER AS year, size_grp, count(*) AS n, round(avg(net), 6) AS mean FROM tr GROUP BY ALL"))
def entry_year(spark, sf):
    return _trades(spark, sf).groupBy(F.year("date").alias("year"), "size_grp").agg(F.count("*").alias("n"), F.avg("net").alias("mean")).select("year", "size_grp", "n", *r6("mean"))


_H = (1, 5, 10, 20, 60)


@query("event_study", S.with_(ROWS, f", f AS (SELECT *, {', '.join(f'{S.lead("open", h + 1)} / {S.lead("open")} - 1 AS fwd{h}' for h in _H)} FROM rws), u AS (" + " UNION ALL ".join(f"SELECT CASE WHEN bull THEN 'bull' ELSE 'bear' END AS regime, {h} AS horizon, fwd{h} AS v FROM f WHERE d_ret20 = 1" for h in _H) + f") SELECT regime, horizon, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS med, round(stddev_samp(v), 6) AS std, round(avg(CASE WHEN v > 0 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 6) AS win, round(avg(v) * sqrt(count(v)) / stddev_samp(v), 6) AS t, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM u GROUP BY ALL"))
def event_study(spark, sf):
    df = prepared(spark, sf).withColumns({f"fwd{h}": lead("open", h + 1) / lead("open") - 1 for h in _H}).where("d_ret20 = 1")
    each = df.select(F.when(F.col("bull"), "bull").otherwise("bear").alias("regime"), F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd{h}").alias("v")) for h in _H))).alias("g")).select("regime", "g.*")
    out = each.groupBy("regime", "horizon").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.avg((F.col("v") > 0).cast("double")).alias("win"))
    out = X.with_quantiles(out, each, ["regime", "horizon"], "v", {"med": 0.5, "p10": 0.1, "p90": 0.9})
    return out.withColumn("t", ratio(F.col("mean") * F.sqrt(F.col("n").cast("double")), "std")).select("regime", "horizon", "n", *r6("mean", "med", "std", "win", "t", "p10", "p90"))


@query("binned_event_study", S.with_(ROWS, "SELECT CASE WHEN rvol20 <= 0.5 THEN 0 WHEN rvol20 <= 1 THEN 1 WHEN rvol20 <= 1.5 THEN 2 WHEN rvol20 <= 2 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(r), 6) AS mean FROM rws WHERE rvol20 IS NOT NULL AND r IS NOT NULL GROUP BY bin"))
def binned_event_study(spark, sf):
    v = F.col("rvol20")
    bin_ = F.when(v <= 0.5, 0).when(v <= 1, 1).when(v <= 1.5, 2).when(v <= 2, 3).otherwise(4)
    return prepared(spark, sf).where("rvol20 IS NOT NULL AND r IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("r").alias("mean")).select("bin", "n", *r6("mean"))


@query("filter_swap", S.with_(ROWS, "SELECT index, ma_len, s.bull, count(*) AS n, round(avg(r - 0.003), 6) AS mean, round(avg(r - 0.003) FILTER (year(rws.date) <= 1998), 6) AS in_sample, round(avg(r - 0.003) FILTER (year(rws.date) > 1998), 6) AS out_of_sample FROM rws JOIN states s USING (day) WHERE d_px_ma60_pct <= 3 AND size_grp <= 2 AND r IS NOT NULL GROUP BY ALL"))
def filter_swap(spark, sf):
    df = prepared(spark, sf).drop("bull", "hv_med", "breadth").where("d_px_ma60_pct <= 3 AND size_grp <= 2 AND r IS NOT NULL")
    swapped = df.join(F.broadcast(states(spark, sf).select("index", "ma_len", "day", "bull")), "day")  # 18 rows a period
    net, y = F.col("r") - X.COST, F.year("date")
    return swapped.groupBy("index", "ma_len", "bull").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), F.avg(F.when(y <= 1998, net)).alias("in_sample"), F.avg(F.when(y > 1998, net)).alias("out_of_sample")).select("index", "ma_len", "bull", "n", *r6("mean", "in_sample", "out_of_sample"))


@query("walk_forward", S.with_(ROWS, f", f AS (SELECT *, year(date)::INTEGER AS y, {', '.join(f'{S.lead("open", h + 1)} / {S.lead("open")} - 1 AS fwd{h}' for h in (5, 10, 20))} FROM rws), u AS (" + " UNION ALL ".join(f"SELECT y, {h} AS horizon, fwd{h} / {h} AS v FROM f WHERE signal AND fwd{h} IS NOT NULL" for h in (5, 10, 20)) + "), a AS (SELECT y, horizon, sum(v) AS s, count(*) AS n FROM u GROUP BY ALL), tr2 AS (SELECT t.y AS test, a.horizon, sum(a.s) / sum(a.n) AS m FROM (SELECT DISTINCT y FROM a) t JOIN a ON a.y BETWEEN t.y - 3 AND t.y - 1 GROUP BY ALL), best AS (SELECT test, max_by(horizon, m) AS horizon FROM tr2 GROUP BY test) SELECT test, best.horizon, round(a.s / a.n, 6) AS mean, a.n FROM best JOIN a ON a.y = test AND a.horizon = best.horizon"))
def walk_forward(spark, sf):
    df = prepared(spark, sf).withColumns({f"fwd{h}": lead("open", h + 1) / lead("open") - 1 for h in (5, 10, 20)}).where("signal")
    each = df.select(F.year("date").alias("y"), F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col(f"fwd{h}") / h).alias("v")) for h in (5, 10, 20)))).alias("g")).select("y", "g.*").where("v IS NOT NULL")
    a = each.groupBy("y", "horizon").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    train = a.select(F.explode(F.sequence(F.col("y") + 1, F.col("y") + 3)).alias("test"), "horizon", "s", "n").groupBy("test", "horizon").agg((F.sum("s") / F.sum("n")).alias("m"))
    best = train.groupBy("test").agg(F.max_by("horizon", "m").alias("horizon"))
    return best.join(a, (F.col("y") == F.col("test")) & (best["horizon"] == a["horizon"])).select("test", best["horizon"], *r6(mean=F.col("s") / F.col("n")), "n")


@query("compounding_bias", S.with_(PORT, "SELECT round(exp(sum(ln(1 + ret))) - 1, 6) AS chained, round(sum(ret), 6) AS summed, round((SELECT avg(net) FROM tr) * count(*) / 20, 6) AS overlapped FROM nv"))
def compounding_bias(spark, sf):
    mean = _trades(spark, sf).agg(F.avg("net").alias("m"))
    total = _portfolio(spark, sf).agg(F.sum(F.log1p("ret")).alias("l"), F.sum("ret").alias("s"), F.count("*").alias("n"))
    return total.crossJoin(mean).select(*r6(chained=F.exp("l") - 1, summed=F.col("s"), overlapped=F.col("m") * F.col("n") / 20))  # one row each


@query("exit_rules", S.with_(ROWS, f""", e AS (SELECT sg.code, sg.date, sg.row, x.open AS entry FROM sg JOIN rws x ON x.code = sg.code AND x.row = sg.row + 1 WHERE EXISTS (SELECT 1 FROM rws z WHERE z.code = sg.code AND z.row = sg.row + 21)),
    p AS (SELECT e.code, e.date, e.row, entry, y.row AS hit, y.close, greatest(entry, max(y.close) OVER (PARTITION BY e.code, e.date ORDER BY y.row ROWS UNBOUNDED PRECEDING)) AS top FROM e JOIN rws y ON y.code = e.code AND y.row BETWEEN e.row + 1 AND e.row + {HOLD}),
    h AS (SELECT code, date, min(hit) FILTER (close <= top * 0.96 * (1 + 1e-9)) AS hit FROM p GROUP BY ALL), o AS (SELECT e.*, f.open / entry - 1 AS r FROM e JOIN h USING (code, date) JOIN rws f ON f.code = e.code AND f.row = coalesce(h.hit + 1, e.row + 21))
    SELECT count(*) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM o"""))
def exit_rules(spark, sf):
    """A trailing stop: 4 % below the best close since the entry, sold at the next open."""
    df = D.with_bars(prepared(spark, sf), HOLD, which="signal").where(F.size("bars") > HOLD)
    r = D.exit_return(HOLD, lambda bar, top: bar["close"] <= top * 0.96 * (1 + 1e-9))
    return df.select(r.alias("r")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("win")).select("n", *r6("mean", "win"))


@query("drawdown_depth", S.with_(ROWS, f""", e AS (SELECT tr.code, tr.date, tr.row, tr.buy_px, tr.net FROM tr), d AS (SELECT e.code, e.date, e.net, min(y.low) / any_value(e.buy_px) - 1 AS depth FROM e JOIN rws y ON y.code = e.code AND y.row BETWEEN e.row + 1 AND e.row + {HOLD} GROUP BY ALL)
    SELECT least(floor(round(-depth, 9) / 0.02), 7)::INTEGER AS bucket, count(*) AS n, round(avg(net), 6) AS mean, round(median(net), 6) AS med FROM d GROUP BY 1 HAVING count(*) >= 20"""))
def drawdown_depth(spark, sf):
    df = D.with_bars(prepared(spark, sf), HOLD, which="signal AND r IS NOT NULL")
    depth = F.array_min(F.transform(F.slice("bars", 1, HOLD), lambda b: b["low"])) / F.col("buy_px") - 1
    bucket = F.least(F.floor(F.round(-depth, 9) / 0.02), F.lit(7)).cast("int")
    each = staged(df.select(bucket.alias("bucket"), (F.col("r") - X.COST).alias("net")), "drawdowns")
    out = X.with_quantiles(each.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("net").alias("mean")), each, ["bucket"], "net", {"med": 0.5})
    return out.where("n >= 20").select("bucket", "n", *r6("mean", "med"))


@query("tune_grid", S.with_(ROWS, "SELECT deep, small, market, count(*) AS n, round(avg(r - 0.003), 6) AS mean FROM rws JOIN (SELECT unnest([1, 2, 3]) AS deep) a ON d_px_ma60_pct <= deep JOIN (SELECT unnest([0, 2, 4]) AS small) b ON size_grp <= small JOIN (SELECT unnest(['any', 'bear', 'bull']) AS market) c ON market = 'any' OR bull = (market = 'bull') WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= 200"))
def tune_grid(spark, sf):
    """A grid of selections in one pass: each row joins the few combinations that it satisfies."""
    import itertools

    grid = list(itertools.product((1, 2, 3), (0, 2, 4), ("any", "bear", "bull")))
    hit = lambda d, s, m: F.coalesce((F.col("d_px_ma60_pct") <= d) & (F.col("size_grp") <= s) & (F.lit(True) if m == "any" else F.col("bull") == (m == "bull")), F.lit(False))
    each = prepared(spark, sf).where("r IS NOT NULL").select("r", F.explode(F.array_compact(F.array(*(F.when(hit(*g), F.struct(F.lit(g[0]).alias("deep"), F.lit(g[1]).alias("small"), F.lit(g[2]).alias("market"))) for g in grid)))).alias("g"))
    return each.groupBy("g.deep", "g.small", "g.market").agg(F.count("*").alias("n"), F.avg(F.col("r") - X.COST).alias("mean")).where("n >= 200").select("deep", "small", "market", "n", *r6("mean"))


@query("market_series", S.with_(STATES, "SELECT day, date, round(nav, 6) AS nav, round(ma, 6) AS ma, CASE WHEN ma IS NOT NULL THEN bull END AS bull FROM states WHERE index = 'small30' AND ma_len = 20 AND day > (SELECT max(day) FROM states) - 120"))
def market_series(spark, sf):
    """The tail of a market, with no state where its average has not formed."""
    s = states(spark, sf)
    end = s.agg(F.max("day").alias("end"))
    return s.join(F.broadcast(end)).where("index = 'small30' AND ma_len = 20 AND day > end - 120").select("day", "date", *r6("nav", "ma"), F.when(F.col("ma").isNotNull(), F.col("bull")).alias("bull"))


@query("stock_detail", S.with_(ROWS, "SELECT date, round(close, 6) AS close, signal, round(r, 6) AS r FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM rws WHERE code = 5) WHERE k <= 250"))
def stock_detail(spark, sf):
    one = prepared(spark, sf).where("code = 5")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("k <= 250").select("date", *r6("close"), "signal", *r6("r"))


@query("quotes_stale", S.with_(S.PANEL, "SELECT code, max(date) AS date, round(max_by(close, date), 6) AS price, ((SELECT max(date) FROM panel) - max(date))::INTEGER AS stale_days, ((SELECT max(date) FROM panel) - max(date)) <= 4 AS fresh FROM panel GROUP BY code"))
def quotes_stale(spark, sf):
    df = panel(spark, sf)
    end = df.agg(F.max("date").alias("end"))
    out = df.groupBy("code").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("price")).join(F.broadcast(end))
    return out.select("code", "date", *r6("price"), F.datediff("end", "date").alias("stale_days"), (F.datediff("end", "date") <= 4).alias("fresh"))


@query("ledger_pnl", S.with_(S.PANEL, ", q AS (SELECT code, max_by(close, date) AS price FROM panel GROUP BY code), l AS (SELECT c_custkey % 150 AS code, c_custkey AS lot, 80 + c_custkey % 40 AS cost, 100 * (1 + c_custkey % 5) AS shares FROM customer) SELECT l.lot, l.code, q.price IS NULL AS noquote, round((q.price - cost) * shares, 6) AS pnl, round(q.price / cost - 1, 6) AS pnl_pct FROM l LEFT JOIN q USING (code)"))
def ledger_pnl(spark, sf):
    quotes = panel(spark, sf).groupBy("code").agg(F.max_by("close", "date").alias("price"))
    lots = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 150).alias("code"), F.col("c_custkey").alias("lot"), (80 + F.col("c_custkey") % 40).alias("cost"), (100 * (1 + F.col("c_custkey") % 5)).alias("shares"))
    return lots.join(quotes, "code", "left").select("lot", "code", F.col("price").isNull().alias("noquote"), *r6(pnl=(F.col("price") - F.col("cost")) * F.col("shares"), pnl_pct=F.col("price") / F.col("cost") - 1))


@query("plan_vs_trades", S.with_(ROWS, "SELECT 'settled' AS kind, count(*) AS n FROM sg WHERE EXISTS (SELECT 1 FROM tr WHERE tr.code = sg.code AND tr.row = sg.row) UNION ALL SELECT 'unsettled', count(*) FROM sg WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.code = sg.code AND tr.row = sg.row)"))
def plan_vs_trades(spark, sf):
    df = prepared(spark, sf).where("signal")
    done = D.trades(df).select("code", "row")
    n = lambda how, kind: df.join(done, ["code", "row"], how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("left_semi", "settled").unionByName(n("left_anti", "unsettled"))


@query("pool_benchmark", S.with_(ROWS, f"SELECT {STATS.format(v='net')} FROM (SELECT r - 0.003 AS net FROM rws WHERE r IS NOT NULL)"))
def pool_benchmark(spark, sf):
    return D.trade_stats(D.trades(prepared(spark, sf))).select("n", *r6(*_T))

