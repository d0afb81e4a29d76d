"""Queries on the choice, the exits and the listing of trades, on positions and on events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import simulate as D
from ..operators.cross import with_quantiles
from ..sources.files import staged
from ..sources.panel import panel
from . import query as Q
from . import sql as S
from .catalog_cross import r6
from .catalog_strategy import CHAINED, HOLD, ROWS, _days, _excess, prepared
from .catalog_windows import ROUNDED, P, rounded_macd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


_ORDERS = {"deep": "px_ma60_pct", "amount": "turnover DESC", "small": "size_grp", "big": "size_grp DESC", "drop60": "ret60", "none": "code", "rand": "substr(md5(code || '|' || day || '|7'), 1, 12)"}


@query("pick_rules", S.with_(ROWS, " UNION ALL ".join(f"SELECT '{k}' AS rule, day, code, rk::INTEGER AS rk FROM (SELECT day, code, row_number() OVER (PARTITION BY day ORDER BY {o} NULLS LAST, code) AS rk FROM sg) WHERE rk <= 3" for k, o in _ORDERS.items())))
def pick_rules(spark, sf):
    """The three choices of each day by each rule; unknown keys come last, ties by code."""
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), key().alias("key")) for k, key in Q.PICKS.items()))).alias("k")
    each = prepared(spark, sf).where("signal").select("day", "code", keys).select("day", "code", "k.*")
    w = Window.partitionBy("rule", "day").orderBy(F.asc_nulls_last("key"), "code")
    return each.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("rule", "day", "code", "rk")


LISTED = CHAINED + """, lst AS (SELECT ex.code, ex.date, c1.date AS entry_date, c2.date AS exit_date, round(net, 9) AS net, round(excess, 9) AS excess FROM ex JOIN cal c1 ON c1.day = ex.entry_day LEFT JOIN cal c2 ON c2.day = ex.due_day),
    won AS (SELECT * FROM lst WHERE net > 0 AND net >= 0.01 AND net <= 0.4 AND year(entry_date) = 1997)"""


def _listed(spark, sf) -> DataFrame:
    days = _days(spark, sf)  # a row per period
    df = _excess(spark, sf).withColumns({c: F.round(c, 9) for c in ("net", "excess")})
    df = df.join(F.broadcast(days.select(F.col("day").alias("entry_day"), F.col("date").alias("entry_date"))), "entry_day")
    df = df.join(F.broadcast(days.select(F.col("day").alias("due_day"), F.col("date").alias("exit_date"))), "due_day", "left")
    return df.withColumn("hold", F.col("due_day") - F.col("entry_day"))


_WON = {"win": True, "year": 1997, "least": 0.01, "most": 0.4}


@query("trades_filtered", S.with_(LISTED, ", k AS (SELECT *, row_number() OVER (ORDER BY excess NULLS LAST, code, date) - 1 AS i, count(*) OVER () AS n FROM won) SELECT code, date, entry_date, exit_date, round(net, 6) AS net, round(excess, 6) AS excess FROM k WHERE i // 15 = least(98, greatest(0, (n + 14) // 15 - 1))"))
def trades_filtered(spark, sf):
    """The last page (page 99 is none) of the won trades of a year, by rising excess."""
    rows = D.trade_page(D.filtered_trades(_listed(spark, sf), **_WON), "excess", "asc", page=99, size=15)
    return rows.select("code", "date", "entry_date", "exit_date", *r6("net", "excess"))


@query("trades_filtered_total", S.with_(LISTED, "SELECT count(*) AS n, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(net), 6) AS mean, round(median(net), 6) AS median, round(sum(net), 6) AS total, round(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net <= 0), 0), 6) AS pf, round(max(net), 6) AS best, round(min(net), 6) AS worst FROM lst WHERE net >= -0.1 AND net <= 0.4 AND year(entry_date) = 1997"))
def trades_filtered_total(spark, sf):
    v = F.col("net")
    out = D.filtered_trades(_listed(spark, sf), year=1997, least=-0.1, most=0.4).agg(F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("win"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.sum(v).alias("total"), F.try_divide(F.sum(F.when(v > 0, v)), -F.sum(F.when(v <= 0, v))).alias("pf"), F.max(v).alias("best"), F.min(v).alias("worst"))
    return out.select("n", *r6("win", "mean", "median", "total", "pf", "best", "worst"))


#: Rules of leaving, by what the close of a bar must be at most; a death cross needs no price.
_EXITS = {"atr2": "close <= entry - 2 * atr", "atr3": "close <= entry - 3 * atr", "fixed15": "close <= entry * 0.85", "trail12": "close <= top * 0.88", "macd": "dead"}
_ATR = f"greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')}))"


@query("exit_indicators", S.with_(ROWS + ROUNDED.removeprefix(P), f""", dc AS (SELECT code, date, coalesce(dea > dif AND {S.lag('dea')} <= {S.lag('dif')}, false) AS dead FROM q),
    t1 AS (SELECT code, date, row, CASE WHEN {S.lag('close')} IS NOT NULL THEN {_ATR} END AS tr FROM rws), t2 AS (SELECT code, row, {S.mean('tr', 14)} AS atr FROM t1),
    e AS (SELECT sg.code, sg.date, sg.row, t2.atr, x.open AS entry FROM sg JOIN t2 ON t2.code = sg.code AND t2.row = sg.row JOIN rws x ON x.code = sg.code AND x.row = sg.row + 1 WHERE EXISTS (SELECT 1 FROM rws z WHERE z.code = sg.code AND z.row = sg.row + 21)),
    p AS (SELECT e.code, e.row, e.entry, e.atr, y.row AS bar, y.close, dc.dead, greatest(entry, max(y.close) OVER (PARTITION BY e.code, e.row ORDER BY y.row ROWS UNBOUNDED PRECEDING)) AS top FROM e JOIN rws y ON y.code = e.code AND y.row BETWEEN e.row + 1 AND e.row + 20 JOIN dc ON dc.code = y.code AND dc.date = y.date),
    h AS ({' UNION ALL '.join(f"SELECT '{k}' AS rule, code, row, any_value(entry) AS entry, min(bar) FILTER ({c}) AS hit FROM p GROUP BY code, row" for k, c in _EXITS.items())}),
    o AS (SELECT rule, h.hit IS NOT NULL AS early, coalesce(h.hit, h.row + 20) - h.row AS held, f.open / entry - 1 AS r FROM h JOIN rws f ON f.code = h.code AND f.row = coalesce(h.hit + 1, h.row + 21))
    SELECT rule, count(*) AS n, count(*) FILTER (early) AS early, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM o GROUP BY rule"""))
def exit_indicators(spark, sf):
    """Stops at two and three true ranges and at 15 %, a trailing stop of 12 %, and the death cross; sold at the next open."""
    crossed = I.macd_events(rounded_macd(spark, sf)).select("code", "date", F.col("death_cross").alias("dead"))
    df = I.ranges(prepared(spark, sf).drop("hv20")).select("code", "date", "row", "open", "high", "low", "close", "atr14", "signal").join(crossed, ["code", "date"])
    df = D.with_bars(df, HOLD, ("open", "close", "dead"), "signal").where(F.size("bars") > HOLD)
    entry = F.col("bars")[0]["open"]
    rules = {
        "atr2": lambda b, top: b["close"] <= entry - 2 * F.col("atr14"), "atr3": lambda b, top: b["close"] <= entry - 3 * F.col("atr14"),
        "fixed15": lambda b, top: b["close"] <= entry * 0.85, "trail12": lambda b, top: b["close"] <= top * 0.88, "macd": lambda b, top: b["dead"],
    }
    each = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), D.exit_return(HOLD, rule).alias("r"), D.left_early(HOLD, rule).alias("early")) for k, rule in rules.items()))).alias("g")).select("g.*")
    return each.groupBy("rule").agg(F.count("*").alias("n"), F.count(F.when(F.col("early"), 1)).alias("early"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("win")).select("rule", "n", "early", *r6("mean", "win"))


_AHEAD = (1, 5, 10, 20, 40, 60)
_EVENTS = {
    "1_golden_cross": "gold", "2_rising3": "rising >= 3", "3_rising5": "rising >= 5", "4_golden_below": "gold AND dif <= 0", "5_golden_above": "gold AND dif > 0",
    "6_slow_improvement": "hist < 0 AND d1 > 0 AND d3 > 0 AND z1 < 1", "7_fast_flip": "hist > 0 AND h1 <= 0 AND z1 > 1", "8_decay": "hist > 0 AND d1 < 0 AND hist > 0.5 * top", "9_death_cross": "dead",
}


@query("event_catalogue", S.with_(ROUNDED, f""", b1 AS (SELECT q.*, open, {S.lag('hist')} AS h1, hist - {S.lag('hist')} AS d1, hist - {S.lag('hist', 3)} AS d3, coalesce(dif > dea AND {S.lag('dif')} <= {S.lag('dea')}, false) AS gold, coalesce(dea > dif AND {S.lag('dea')} <= {S.lag('dif')}, false) AS dead FROM q JOIN (SELECT code, date, open FROM panel) USING (code, date)),
    b2 AS (SELECT *, d1 / nullif({S.rolling('stddev_samp(d1)', 'd1', 60)}, 0) AS z1, {S.rolling('sum(CASE WHEN d1 > 0 THEN 1 WHEN d1 <= 0 THEN 0 END)', 'd1', 5)} AS rising, {S.rolling('max(hist)', 'hist', 20)} AS top, {', '.join(f"{S.lead('open', h + 1)} / {S.lead('open')} - 1 AS fwd{h}" for h in _AHEAD)} FROM b1),
    ev AS ({' UNION ALL '.join(f"SELECT '{k}' AS event, {h} AS horizon, round(fwd{h}, 9) AS v FROM b2 WHERE coalesce({c}, false)" for k, c in _EVENTS.items() for h in _AHEAD)})
    SELECT event, horizon, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, {', '.join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM ev WHERE v IS NOT NULL GROUP BY event, horizon"""))
def event_catalogue(spark, sf):
    """Nine events of the momentum indicator, and what followed over six horizons, bought at the next open."""
    df = I.macd_scores(I.macd_events(rounded_macd(spark, sf)))
    df = I.returns(df, back=(), ahead=_AHEAD)
    events = {"1_golden_cross": F.col("golden_cross"), "2_rising3": F.col("hist_up3"), "3_rising5": F.col("hist_up5"), "4_golden_below": F.col("gc_below"), "5_golden_above": F.col("gc_above"), "6_slow_improvement": F.col("st_slowimp"), "7_fast_flip": F.col("st_fastflip"), "8_decay": F.col("st_decay"), "9_death_cross": F.col("death_cross")}
    hits = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in events.items())))).alias("event")
    after = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.round(f"fwd{h}", 9).alias("v")) for h in _AHEAD))).alias("g")
    hits = staged(df.select(hits, *(f"fwd{h}" for h in _AHEAD)), "event-hits")
    each = hits.select("event", after).select("event", "g.*").where("v IS NOT NULL")
    v = F.col("v")
    out = each.groupBy("event", "horizon").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.avg((v > 0).cast("double")).alias("win"))
    out = with_quantiles(out, each, ["event", "horizon"], "v", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    return out.select("event", "horizon", "n", *r6("mean", "std", "win", "p10", "p25", "p50", "p75", "p90"))


@query("ledger_totals", S.with_(S.PANEL, """, n AS (SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM panel), q AS (SELECT code, max(close) FILTER (k = 1) AS price, max(close) FILTER (k = 2) AS before FROM n WHERE k <= 2 GROUP BY code),
    l AS (SELECT c_custkey % 150 AS code, 80 + c_custkey % 40 AS cost, 100 * (1 + c_custkey % 5) AS shares FROM customer), j AS (SELECT l.*, price, before FROM l LEFT JOIN q USING (code))
    SELECT count(*) AS lots, count(*) FILTER (price IS NULL) AS unpriced, round(sum(cost * shares) FILTER (price IS NOT NULL), 6) AS cost, round(sum(price * shares), 4) AS value, round(sum((price - cost) * shares), 4) AS pnl, round(sum((price - cost) * shares) / sum(cost * shares) FILTER (price IS NOT NULL), 6) AS pnl_pct,
    round(sum((price - before) * shares), 4) AS last_pnl, round(sum((price - before) * shares) / sum(before * shares) FILTER (price IS NOT NULL), 6) AS last_pct FROM j"""))
def ledger_totals(spark, sf):
    """Totals over the lots that have a price, and the change since the price before on the value then."""
    quotes = I.last_two(panel(spark, sf)).select("code", "price", F.col("prev_price").alias("before"))
    lots = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 150).alias("code"), (80 + F.col("c_custkey") % 40).alias("cost"), (100 * (1 + F.col("c_custkey") % 5)).alias("shares"))
    priced, n = F.col("price").isNotNull(), F.col("shares")
    out = lots.join(quotes, "code", "left").agg(
        F.count("*").alias("lots"), F.count(F.when(~priced, 1)).alias("unpriced"), F.sum(F.when(priced, F.col("cost") * n)).cast("double").alias("cost"), F.sum(F.col("price") * n).alias("value"),
        F.sum((F.col("price") - F.col("cost")) * n).alias("pnl"), F.sum((F.col("price") - F.col("before")) * n).alias("last_pnl"), F.sum(F.col("before") * n).alias("_base"),
    )
    return out.select("lots", "unpriced", *r6("cost", pnl_pct=F.try_divide("pnl", "cost"), last_pct=F.try_divide("last_pnl", "_base")), *(F.round(c, 4).alias(c) for c in ("value", "pnl", "last_pnl")))


@query("positions_marked", S.with_(ROWS, f""", z AS (SELECT code, max(row) AS last_row, max(date) AS last_date, max_by(close, date) AS price FROM rws GROUP BY code)
    SELECT code, sg.date, round(buy_px, 6) AS buy_px, round(price, 6) AS price, round(price / buy_px - 1, 6) AS pnl, (last_row - sg.row - 1)::INTEGER AS held, CAST(last_date + INTERVAL 7 DAY * (sg.row + 1 + {HOLD} - last_row) AS DATE) AS exit_about FROM sg JOIN z USING (code) WHERE r IS NULL AND has_entry AND buy_px IS NOT NULL AND NOT has_exit"""))
def positions_marked(spark, sf):
    """What is still held, at the latest price, with the date at which its time should end; the earliest ends first."""
    df = prepared(spark, sf)
    last = df.groupBy("code").agg(F.max("row").alias("last_row"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("price"))
    held = df.where("signal").where(D.open_state() == "holding").join(last, "code")
    left = (F.col("row") + 1 + HOLD - F.col("last_row")).cast("int")
    out = held.select("code", "date", *r6("buy_px", "price", pnl=F.col("price") / F.col("buy_px") - 1), (F.col("last_row") - F.col("row") - 1).cast("int").alias("held"), F.date_add("last_date", left * 7).alias("exit_about"))
    return out.orderBy("exit_about", F.desc("pnl"), "code")
