"""Queries on the scan's market, single entities, open trades, swapped filters and the evidence tables, each with its SQL written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bins, lag, lead, rank_pct, ratio
from ..operators import capacity as K
from ..operators import cross as X
from ..operators import indicators as I
from ..operators import simulate as D
from ..sources.files import staged
from ..sources.panel import panel
from ..sources.versions import spread
from . import query as Q
from . import sql as S
from .catalog_capacity import DRAWS, EARNED, PLANNED, TEN
from .catalog_cross import r6, states
from .catalog_signals import with_momentum
from .catalog_strategy import CHAINED, HOLD, ROWS, _days, _excess, prepared
from .catalog_studies import _chosen, strength
from .catalog_windows import ROUNDED, P, sources

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


def _groups(tests: dict[str, Column], **more: Column) -> list[tuple[Column, dict[str, Column]]]:
    return [(t, {"variant": F.lit(k), **more}) for k, t in tests.items()]


def _won(v: Column) -> Column:
    return F.avg((v > 0).cast("double"))


# ---- scan, detail, open trades, ledger -------------------------------------------------------------------------------------


@query("scan_market", S.with_(ROWS, """, big AS (SELECT day FROM rws GROUP BY day HAVING count(*) > (SELECT count(DISTINCT code) FROM rws) / 2), ends AS (SELECT max(day) AS latest FROM big),
    found AS (SELECT latest, (SELECT max(day) FROM sg WHERE day IN (SELECT day FROM big) AND day >= latest - 180) AS seen FROM ends), s60 AS (SELECT * FROM states WHERE index = 'all' AND ma_len = 60)
    SELECT a.date AS date, b.date AS latest_date, (latest - seen)::INTEGER AS fallback_days, (SELECT count(*) FROM sg WHERE day = latest) AS latest_n, (SELECT count(*) FROM sg WHERE day = seen) AS n, a.bull AS mkt_bull, b.bull AS mkt_bull_now,
    round(a.dist, 6) AS mkt_dist, round(a.breadth, 6) AS breadth, round(a.hv20, 6) AS hv20, round(a.hv_med, 6) AS hv_med FROM found JOIN s60 a ON a.day = seen JOIN s60 b ON b.day = latest"""))
def scan_market(spark, sf):
    """The market beside the scan: its state on the latest day with signals and on the latest day, how far these lie apart, and how many signals either has."""
    df = prepared(spark, sf)
    per_day = df.groupBy("day").agg(F.count("*").alias("n"), F.count_if("signal").alias("hits"))
    big = per_day.crossJoin(F.broadcast(df.select(F.countDistinct("code").alias("codes")))).where(F.col("n") > F.col("codes") / 2)  # one row beside one per period
    ends = big.agg(F.max("day").alias("latest"), F.max(F.when(F.col("hits") > 0, F.col("day"))).alias("asof")).where("asof >= latest - 180")
    market = states(spark, sf).where("index = 'all' AND ma_len = 60").join(per_day, "day").select("day", "date", "bull", "dist", "breadth", "hv20", "hv_med", F.col("hits"))
    now = market.select(F.col("day").alias("latest"), F.col("date").alias("latest_date"), F.col("bull").alias("mkt_bull_now"), F.col("hits").alias("latest_n"))
    out = F.broadcast(ends).join(market, F.col("asof") == F.col("day")).join(now, "latest")  # one row
    return out.select("date", "latest_date", (F.col("latest") - F.col("asof")).cast("int").alias("fallback_days"), "latest_n", F.col("hits").alias("n"), F.col("bull").alias("mkt_bull"), "mkt_bull_now", *r6("breadth", "hv20", "hv_med", mkt_dist=F.col("dist")))


@query("stock_signals", S.with_(ROWS, f""", f AS (SELECT code, date, close, signal, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, {', '.join(f"{S.lead('open', h + 1)} / {S.lead('open')} - 1 AS fwd{h}" for h in (5, 20, 60))} FROM rws)
    SELECT code, date, round(close, 6) AS close, round(fwd5, 6) AS fwd5, round(fwd20, 6) AS fwd20, round(fwd60, 6) AS fwd60, back <= 250 AS shown FROM f WHERE signal"""))
def stock_signals(spark, sf):
    """Every signal that entities ever gave, what came of it over three horizons, and whether it lies in the last 250 rows."""
    df = prepared(spark, sf).select("code", "date", "open", "close", "signal")
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    df = df.withColumns({f"fwd{h}": lead("open", h + 1) / lead("open") - 1 for h in (5, 20, 60)} | {"shown": back <= 250})
    return df.where("signal").select("code", "date", *r6("close", "fwd5", "fwd20", "fwd60"), "shown")


@query("trades_with_open", S.with_(CHAINED, f""", z AS (SELECT code, max(row) AS end_row FROM rws GROUP BY code), op AS (SELECT sg.*, end_row FROM sg JOIN z USING (code) WHERE r IS NULL)
    (SELECT 'closed' AS kind, code, date, round(net, 6) AS net, {HOLD} AS hold_days, 0 AS left_days FROM ex WHERE net > 0 ORDER BY round(net, 9) DESC, code, date LIMIT 50)
    UNION ALL SELECT CASE WHEN has_entry AND buy_px IS NULL THEN 'nobuy' WHEN NOT has_entry THEN 'pending' WHEN has_exit THEN 'stuck' ELSE 'holding' END, code, date, NULL, CASE WHEN has_entry AND buy_px IS NOT NULL AND NOT has_exit THEN end_row - row - 1 END::INTEGER, CASE WHEN has_entry AND buy_px IS NOT NULL AND NOT has_exit THEN row + {HOLD + 1} - end_row END::INTEGER FROM op"""))
def trades_with_open(spark, sf):
    """A page of winning trades, and beside it every signal without a result: why, and of what is held, for how long already and still."""
    df = prepared(spark, sf)
    page = D.trade_page(_excess(spark, sf).where("net > 0").select("code", "date", F.round("net", 9).alias("net")), "net")
    closed = page.select(F.lit("closed").alias("kind"), "code", "date", *r6("net"), F.lit(HOLD).alias("hold_days"), F.lit(0).alias("left_days"))
    ends = df.groupBy("code").agg(F.max("row").alias("end_row"))
    rest = df.where("signal AND r IS NULL").join(ends, "code").withColumn("kind", D.open_state())
    held = lambda c: F.when(F.col("kind") == "holding", c.cast("int"))
    rest = rest.select("kind", "code", "date", F.lit(None).cast("double").alias("net"), held(F.col("end_row") - F.col("row") - 1).alias("hold_days"), held(F.col("row") + HOLD + 1 - F.col("end_row")).alias("left_days"))
    return closed.unionByName(rest)


@query("ledger_lots", S.with_(S.PANEL, """, n AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM panel), q AS (SELECT code, max(date) FILTER (k = 1) AS date, max(close) FILTER (k = 1) AS price, max(close) FILTER (k = 2) AS before FROM n WHERE k <= 2 GROUP BY code),
    l AS (SELECT c_custkey AS lot, c_custkey % 150 AS code, 80 + c_custkey % 40 AS cost, 100 * (1 + c_custkey % 5) AS shares, CASE WHEN c_custkey % 11 <> 0 THEN DATE '1998-01-01' + (c_custkey % 1900)::INTEGER END AS bought FROM customer)
    SELECT lot, l.code, price IS NULL AS noquote, CASE WHEN price IS NOT NULL THEN round((price - cost) * shares, 4) END AS pnl, round((price - before) * shares, 4) AS day_pnl, round(price / before - 1, 6) AS day_pct, CASE WHEN q.date >= bought THEN (q.date - bought)::INTEGER END AS hold_days FROM l LEFT JOIN q ON q.code = l.code"""))
def ledger_lots(spark, sf):
    """A row a lot: result, change of the last day, and natural days held up to its quote (none for lots without a date or bought later)."""
    quotes = I.last_two(panel(spark, sf)).select("code", F.col("date").alias("quoted"), "price", F.col("prev_price").alias("before"))
    key = F.col("c_custkey")
    lots = spark.read.parquet(f"{sf}/customer.parquet").select(key.alias("lot"), (key % 150).alias("code"), (80 + key % 40).alias("cost"), (100 * (1 + key % 5)).alias("shares"), F.when(key % 11 != 0, F.date_add(F.lit("1998-01-01").cast("date"), (key % 1900).cast("int"))).alias("bought"))
    out = lots.join(quotes, "code", "left")
    money = lambda c: F.round(c * F.col("shares"), 4)
    held = F.when(F.col("quoted") >= F.col("bought"), F.datediff("quoted", "bought"))
    return out.select("lot", "code", F.col("price").isNull().alias("noquote"), money(F.col("price") - F.col("cost")).alias("pnl"), money(F.col("price") - F.col("before")).alias("day_pnl"), *r6(day_pct=F.col("price") / F.col("before") - 1), held.alias("hold_days"))


# ---- filters, controls, strategies ------------------------------------------------------------------------------------------


@query("filter_reference", S.with_(ROWS, """, po AS (SELECT unnest(['small', 'big']) AS pool), ba AS (SELECT pool, day, date, r FROM rws JOIN po ON (pool = 'small' AND size_grp <= 2) OR (pool = 'big' AND size_grp BETWEEN 5 AND 9) WHERE d_px_ma60_pct BETWEEN 1 AND 3 AND r IS NOT NULL),
    un AS (SELECT pool, 'none' AS index, date, r FROM ba UNION ALL SELECT pool, s.index, ba.date, r FROM ba JOIN states s ON s.day = ba.day AND s.ma_len = 60 AND NOT s.bull)
    SELECT pool, index, index <> 'none' AND NOT coalesce(index = 'all' OR (pool = 'small' AND index IN ('small50', 'small30')) OR (pool = 'big' AND index = 'big50'), false) AS mismatch, count(*) AS n, round(avg(r - 0.003), 6) AS mean, round(avg(CASE WHEN r - 0.003 > 0 THEN 1.0 ELSE 0.0 END), 6) AS win,
    round(avg(r - 0.003) FILTER (year(date) <= 1998), 6) AS in_sample, round(avg(r - 0.003) FILTER (year(date) > 1998), 6) AS out_of_sample FROM un GROUP BY pool, index"""))
def filter_reference(spark, sf):
    """Small and big rows under no market filter and under that of each index, and whether the index covers the rows at all."""
    pools = {"small": (0, 2), "big": (5, 9)}
    rows = prepared(spark, sf).drop("bull").where("d_px_ma60_pct BETWEEN 1 AND 3 AND r IS NOT NULL")
    rows = rows.select("day", "date", "r", _chosen([(F.col("size_grp").between(*b), {"pool": F.lit(k)}) for k, b in pools.items()])).select("day", "date", "r", "g.pool")
    falling = states(spark, sf).where("ma_len = 60 AND NOT bull").select("day", "index")  # six rows a period at most
    each = rows.withColumn("index", F.lit("none")).unionByName(rows.join(F.broadcast(falling), "day"))
    covers = F.lit(False)
    for name, low, high in X.INDICES:
        for pool, (a, b) in pools.items():
            if low is None or (low <= a and b <= high):
                covers = covers | ((F.col("index") == name) & (F.col("pool") == pool))
    net, year = F.col("r") - X.COST, F.year("date")
    out = each.groupBy("pool", "index").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), _won(net).alias("win"), F.avg(F.when(year <= 1998, net)).alias("in_sample"), F.avg(F.when(year > 1998, net)).alias("out_of_sample"))
    return out.select("pool", "index", ((F.col("index") != "none") & ~covers).alias("mismatch"), "n", *r6("mean", "win", "in_sample", "out_of_sample"))


_RULES = ("deep", "small", "big", "amount")


def _contested(spark, sf, rows: DataFrame) -> DataFrame:
    """Of each day in a rising market the first candidates of every order, as many as can matter to ``plan``.

    Days are dealt to a number of partitions that follows the input, as adaptive execution would merge these few bytes
    before every row is multiplied by the orders; the orders of a day are ranked where its rows are.
    """
    chosen = rows.where("bull AND d_px_ma60_pct BETWEEN 1 AND 3").repartition(spread(spark, sources(sf)), "day")
    drawn = lambda seed: F.conv(F.substring(F.md5(F.concat_ws("|", "code", "day", seed)), 1, 12), 16, 10).cast("double")
    named = F.array(*(F.struct(F.lit(r).alias("scenario"), Q.PICKS[r]().cast("double").alias("key")) for r in _RULES))
    seeds = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda s: F.struct(F.concat(F.lit("rand"), s).alias("scenario"), F.lit(None).cast("double").alias("key")))
    each = chosen.select("code", "day", "row", F.inline(F.concat(named, seeds)))
    each = each.withColumn("key", F.when(F.col("scenario").startswith("rand"), drawn(F.substring("scenario", 5, 9))).otherwise(F.col("key")))
    first = F.row_number().over(Window.partitionBy("scenario", "day").orderBy(F.asc_nulls_last("key"), "code"))
    return each.withColumn("_k", first).where(F.col("_k") <= TEN.considered(HOLD)).drop("_k")


@query("rule_verdicts", S.with_(ROWS, f""", bl AS MATERIALIZED (SELECT * FROM rws WHERE bull AND d_px_ma60_pct BETWEEN 1 AND 3),
    cd AS MATERIALIZED (SELECT 'deep' AS scenario, code, day, px_ma60_pct AS key FROM bl UNION ALL SELECT 'small', code, day, size_grp FROM bl UNION ALL SELECT 'big', code, day, -size_grp FROM bl UNION ALL SELECT 'amount', code, day, -turnover FROM bl UNION ALL SELECT 'rand' || seed, code, day, ('0x' || substr(md5(code || '|' || day || '|' || seed), 1, 12))::BIGINT::DOUBLE FROM bl CROSS JOIN range(0, {DRAWS}) t(seed)),
    rl(scenario, places, new, steps) AS (SELECT DISTINCT scenario, 10, 2, NULL::INTEGER[] FROM cd)""" + PLANNED + EARNED + """, al AS (SELECT scenario, round(cagr, 12) AS cagr FROM an WHERE basis = 'capital'), rn AS (SELECT avg(cagr) AS m, stddev_samp(cagr) AS sd, list(cagr) AS l FROM al WHERE scenario LIKE 'rand%'),
    zs AS (SELECT scenario AS rule, cagr, m, sd, (cagr - m) / nullif(sd, 0) AS z, len(list_filter(l, lambda x: x < cagr)) / len(l) AS beaten FROM al CROSS JOIN rn WHERE scenario NOT LIKE 'rand%')
    SELECT rule, round(cagr, 6) AS cagr, round(m, 6) AS rand_mean, round(sd, 6) AS rand_sd, round(z, 4) AS z, round(beaten, 6) AS beaten, CASE WHEN z > 2 THEN 'better' WHEN z < -2 THEN 'worse' ELSE 'no difference' END AS verdict FROM zs"""))
def rule_verdicts(spark, sf):
    """Four orders of buying in a rising market, each against the same 200 random orders: better or worse beyond two deviations."""
    rows = prepared(spark, sf).select("code", "day", "row", "oret_sig", "bull", "d_px_ma60_pct", "px_ma60_pct", "size_grp", "turnover", "ret60")
    daily = K.daily_returns(K.plan(_contested(spark, sf, rows), HOLD, TEN), rows, _days(spark, sf), HOLD)
    stats = staged(D.annual_stats(K.with_value(daily.withColumn("ret", F.col("capital")), "ret"), ["scenario"]).select("scenario", F.round("cagr", 12).alias("cagr")), "verdicts")  # no deviation from the last bit where all orders buy the same
    others = stats.where("scenario LIKE 'rand%'").select(F.col("cagr").alias("x"))
    out = stats.where("scenario NOT LIKE 'rand%'").crossJoin(F.broadcast(others)).groupBy("scenario", "cagr").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.avg((F.col("x") < F.col("cagr")).cast("double")).alias("beaten"))  # DRAWS rows
    z = ratio(F.col("cagr") - F.col("m"), "sd")
    return out.select(F.col("scenario").alias("rule"), *r6("cagr", "beaten", rand_mean=F.col("m"), rand_sd=F.col("sd")), F.round(z, 4).alias("z"), F.when(z > 2, "better").when(z < -2, "worse").otherwise("no difference").alias("verdict"))


@query("random_benchmark", S.with_(ROWS, """, k AS (SELECT day, count(*) AS want FROM tr GROUP BY day), c AS (SELECT seed, day, r, row_number() OVER (PARTITION BY seed, day ORDER BY md5(code || '|' || day || '|' || seed)) AS place FROM rws CROSS JOIN range(0, 10) t(seed) WHERE r IS NOT NULL),
    d AS (SELECT seed, r - 0.003 AS net FROM c JOIN k USING (day) WHERE place <= want) SELECT seed::INTEGER AS seed, count(*) AS n, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(net) - (SELECT avg(net) FROM tr), 6) AS less FROM d GROUP BY seed"""))
def random_benchmark(spark, sf):
    """Ten random selections with as many trades a day as the flagship has: their means, and how far they lie from its own."""
    rows = prepared(spark, sf).where("r IS NOT NULL").select("code", "day", "r", "signal").repartition("day")
    want = F.count_if("signal").over(Window.partitionBy("day"))
    each = rows.withColumn("want", want).where("want > 0").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    place = F.row_number().over(Window.partitionBy("day", "seed").orderBy(F.md5(F.concat_ws("|", "code", "day", "seed"))))
    net = F.col("r") - X.COST
    out = each.withColumn("place", place).where("place <= want").groupBy("seed").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), _won(net).alias("win"))
    own = rows.where("signal").agg(F.avg(net).alias("own"))
    return out.crossJoin(F.broadcast(own)).select("seed", "n", *r6("mean", "win", less=F.col("mean") - F.col("own")))  # one row


def _eight() -> dict[str, Column]:
    deep, small, bear, turned = F.col("d_px_ma60_pct") == 1, F.col("size_grp") <= 2, ~F.col("bull"), F.col("close") > F.col("ma5")
    dry = F.col("vt_5_20") < 1
    return {"1 deep": deep, "2 turned": deep & turned, "3 dry": deep & dry, "4 small": deep & small, "5 bear": deep & bear, "6 small bear": deep & small & bear, "7 small turned": deep & small & turned, "8 all": deep & small & bear & turned}


_E8 = {"1 deep": "true", "2 turned": "close > ma5", "3 dry": "vt_5_20 < 1", "4 small": "size_grp <= 2", "5 bear": "bull = false", "6 small bear": "size_grp <= 2 AND bull = false", "7 small turned": "size_grp <= 2 AND close > ma5", "8 all": "size_grp <= 2 AND bull = false AND close > ma5"}


@query("eight_strategies", S.with_(ROWS, ", hd AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{k}' AS scenario, code, day, row, r, 1.0 AS weight FROM rws WHERE d_px_ma60_pct = 1 AND {c}" for k, c in _E8.items()) + ")" + EARNED + """,
    tn AS (SELECT scenario, count(*) AS n, count(r) AS n_trade, avg(r - 0.003) AS mean, avg(CASE WHEN r - 0.003 > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win, sum(r - 0.003) FILTER (r - 0.003 > 0) / nullif(-sum(r - 0.003) FILTER (r - 0.003 < 0), 0) AS pf FROM hd GROUP BY scenario), hl AS (SELECT scenario, avg(n) FILTER (n > 0) AS held FROM pd GROUP BY scenario)
    SELECT scenario, n, n_trade, round(mean, 6) AS mean, round(win, 6) AS win, round(pf, 6) AS pf, round(cagr, 6) AS cagr, round(mdd, 6) AS mdd, round(sharpe, 6) AS sharpe, round(held, 6) AS held FROM tn JOIN an USING (scenario) JOIN hl USING (scenario) WHERE basis = 'invested'"""))
def eight_strategies(spark, sf):
    """Eight selections that build on the deepest decile: their trades, and the portfolio that holds all of each."""
    rows = prepared(spark, sf)
    each = rows.select("code", "day", "row", "r", _chosen([(t, {"scenario": F.lit(k)}) for k, t in _eight().items()])).select("code", "day", "row", "r", "g.scenario", F.lit(1.0).alias("weight"))
    daily = staged(K.daily_returns(each, rows, _days(spark, sf), HOLD), "eight-daily")
    stats = D.annual_stats(K.with_value(daily.withColumn("ret", F.col("invested")), "ret"), ["scenario"])
    held = daily.groupBy("scenario").agg(F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("held"))
    net = F.col("r") - X.COST
    trades = each.groupBy("scenario").agg(F.count("*").alias("n"), F.count("r").alias("n_trade"), F.avg(net).alias("mean"), _won(net).alias("win"), ratio(F.sum(F.when(net > 0, net)), -F.sum(F.when(net < 0, net))).alias("pf"))
    return trades.join(stats, "scenario").join(held, "scenario").select("scenario", "n", "n_trade", *r6("mean", "win", "pf", "cagr", "mdd", "sharpe", "held"))


_TIMES = (0.0, 0.25, 0.5, 1.0, 1.5, 2.0)


@query("cost_reconciliation", S.with_(ROWS, ", cd AS MATERIALIZED (SELECT 'deep' AS scenario, code, day, px_ma60_pct AS key FROM sg), rl(scenario, places, new, steps) AS (VALUES ('deep', 10, 2, NULL::INTEGER[]))" + PLANNED + EARNED + f""", ct AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS times),
    g AS (SELECT scenario, day, sum(weight * ret) AS gross, sum(weight) AS used FROM ce GROUP BY scenario, day), nt AS (SELECT times, cal.day, coalesce(gross - times * 0.003 / {HOLD} * used, 0) AS ret, coalesce(times * 0.003 / {HOLD} * used, 0) AS fee FROM cal CROSS JOIN ct LEFT JOIN g USING (day)),
    vl AS (SELECT *, product(1 + ret) OVER (PARTITION BY times ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM nt), fl AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY times ORDER BY day ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM vl)
    SELECT times, round(max_by(nav, day) ** (252.0 / count(*)) - 1, 6) AS cagr, round(max_by(nav, day) - 1, 6) AS total, round(min(fall), 6) AS mdd, (SELECT count(*) FROM hd) AS n_trades, round(sum(100000 * nav / (1 + ret) * fee), 2) AS fees, round(100000 * max_by(nav, day), 2) AS final FROM fl GROUP BY times"""))
def cost_reconciliation(spark, sf):
    """The account of ten places under multiples of the costs: what it ends with, and what it paid on the way."""
    rows = prepared(spark, sf).select("code", "day", "row", "oret_sig", "signal", "px_ma60_pct")
    holds = staged(K.plan(rows.where("signal").select(F.lit("deep").alias("scenario"), "code", "day", "row", F.col("px_ma60_pct").alias("key")), HOLD, TEN), "cost-holds")
    gross = K.daily_returns(holds, rows, _days(spark, sf), HOLD, cost=0.0)
    fee = F.col("times") * (X.COST / HOLD) * F.col("n") * TEN.weight
    each = gross.withColumn("times", F.explode(F.array(*map(F.lit, _TIMES)))).withColumn("fee", fee).withColumn("ret", F.col("capital") - F.col("fee"))
    each = staged(K.with_value(each, "ret", ["times"]), "cost-daily")
    paid = each.groupBy("times").agg(F.sum(100000 * F.col("nav") / (1 + F.col("ret")) * F.col("fee")).alias("fees"), F.max_by("nav", "day").alias("end"))
    out = D.annual_stats(each, ["times"]).join(paid, "times").crossJoin(F.broadcast(holds.agg(F.count("*").alias("n_trades"))))  # one row
    return out.select("times", "n_trades", *r6("cagr", "mdd", total=F.col("end") - 1), F.round("fees", 2).alias("fees"), F.round(100000 * F.col("end"), 2).alias("final"))


# ---- depth, confirmations, strength, layers -----------------------------------------------------------------------------------

_TAILS = (0.01, 0.02, 0.05, 0.1, 0.2)
_POOLED = """, z AS MATERIALIZED (SELECT *, (rank() OVER (ORDER BY px_ma60_pct) + (count(*) OVER (PARTITION BY px_ma60_pct) - 1) / 2.0) / count(*) OVER () AS p FROM rws WHERE px_ma60_pct IS NOT NULL)"""


def _pooled(spark, sf) -> DataFrame:
    df = prepared(spark, sf)
    return df.join(X.pooled_rank(df, "px_ma60_pct"), "px_ma60_pct")


@query("depth_tails", S.with_(ROWS, _POOLED + """ SELECT tail, count(r) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS med, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS win, round(max(px_ma60_pct), 6) AS edge FROM z JOIN (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS tail) t ON p <= tail GROUP BY tail"""))
def depth_tails(spark, sf):
    """Trades of the deepest rows of the whole sample, by how deep."""
    each = _pooled(spark, sf).select("r", "px_ma60_pct", _chosen([(F.col("p") <= t, {"tail": F.lit(t)}) for t in _TAILS])).select("r", "px_ma60_pct", "g.tail")
    out = each.groupBy("tail").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), _won(F.col("r")).alias("win"), F.max("px_ma60_pct").alias("edge"))
    return X.with_quantiles(out, each, ["tail"], "r", {"med": 0.5}).select("tail", "n", *r6("mean", "med", "win", "edge"))


@query("depth_years", S.with_(ROWS, _POOLED + " SELECT year(date)::INTEGER AS year, count(r) FILTER (p <= 0.2) AS n, round(avg(r) FILTER (p <= 0.2), 6) AS tail, round(avg(r) FILTER (p > 0.2), 6) AS rest, round(avg(r) FILTER (p <= 0.2) - avg(r) FILTER (p > 0.2), 6) AS diff FROM z GROUP BY 1"))
def depth_years(spark, sf):
    """The deepest fifth of the whole sample against the rest, by year."""
    tail, rest = F.avg(F.when(F.col("p") <= 0.2, F.col("r"))), F.avg(F.when(F.col("p") > 0.2, F.col("r")))
    out = _pooled(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count(F.when(F.col("p") <= 0.2, F.col("r"))).alias("n"), tail.alias("tail"), rest.alias("rest"))
    return out.select("year", "n", *r6("tail", "rest", diff=F.col("tail") - F.col("rest")))


_CURVE = (1, 5, 10, 20, 40, 60)


@query("depth_holding_curve", S.with_(ROWS, _POOLED + ", u AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, p, f{h} AS v FROM (SELECT p, {S.lead('open', h + 1)} / {S.lead('open')} - 1 AS f{h} FROM z)" for h in _CURVE) + ") SELECT horizon, count(v) FILTER (p <= 0.2) AS n, round(avg(v) FILTER (p <= 0.2), 6) AS tail, round(avg(v) FILTER (p > 0.2), 6) AS rest, round(avg(v) FILTER (p <= 0.2) - avg(v) FILTER (p > 0.2), 6) AS diff FROM u GROUP BY horizon"))
def depth_holding_curve(spark, sf):
    """The deepest fifth against the rest by holding time."""
    df = _pooled(spark, sf).select("code", "date", "open", "p")
    df = df.withColumns({f"f{h}": lead("open", h + 1) / lead("open") - 1 for h in _CURVE})
    each = df.select("p", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("v")) for h in _CURVE))).alias("g")).select("p", "g.*")
    tail, rest = F.when(F.col("p") <= 0.2, F.col("v")), F.when(F.col("p") > 0.2, F.col("v"))
    out = each.groupBy("horizon").agg(F.count(tail).alias("n"), F.avg(tail).alias("tail"), F.avg(rest).alias("rest"))
    return out.select("horizon", "n", *r6("tail", "rest", diff=F.col("tail") - F.col("rest")))


_NINE = {"baseline": "true", "ma5": "close > ma5", "ma5 up": "ma5 > before", "two up": "round(close, 9) > c1 AND c1 > c2", "hist up 3": "rising >= 3", "hist > 0": "hist > 0", "dif > dea": "dif > dea", "ma10": "close > ma10", "ma20": "close > ma20"}


@query("confirm_nine", S.with_(ROWS + ROUNDED.removeprefix(P), f""", h AS (SELECT *, hist - {S.lag('hist')} AS step FROM q), h2 AS (SELECT code, date, dif, dea, hist, {S.rolling("sum(CASE WHEN step > 0 THEN 1 WHEN step <= 0 THEN 0 END)", 'step', 5)} AS rising FROM h),
    r2 AS (SELECT *, {S.lag('ma5')} AS before, round({S.lag('close')}, 9) AS c1, round({S.lag('close', 2)}, 9) AS c2 FROM rws), j AS (SELECT r2.*, dif, dea, hist, rising FROM r2 JOIN h2 USING (code, date) WHERE r IS NOT NULL),
    b AS (SELECT 'ret20 2..6' AS base, * FROM j WHERE d_ret20 BETWEEN 2 AND 6 UNION ALL SELECT 'deep union', * FROM j WHERE d_ret40 = 1 OR d_ret60 = 1 OR d_px_ma60_pct = 1), u AS (""" + " UNION ALL ".join(f"SELECT base, '{k}' AS confirm, r - 0.003 AS net FROM b WHERE {c}" for k, c in _NINE.items()) + ") SELECT base, confirm, count(*) AS n, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0), 6) AS pf FROM u GROUP BY base, confirm"))
def confirm_nine(spark, sf):
    """Nine confirmations of two selections; two rising days are two that lie behind."""
    df = with_momentum(spark, sf).withColumns({"c1": F.round(lag("close"), 9), "c2": F.round(lag("close", 2), 9)}).where("r IS NOT NULL")
    c = F.col
    bases = {"ret20 2..6": c("d_ret20").between(2, 6), "deep union": (c("d_ret40") == 1) | (c("d_ret60") == 1) | (c("d_px_ma60_pct") == 1)}
    tests = {"baseline": F.lit(True), "ma5": c("close") > c("ma5"), "ma5 up": c("ma5") > c("ma5_prev"), "two up": (F.round("close", 9) > c("c1")) & (c("c1") > c("c2")), "hist up 3": c("hist_upstreak") >= 3, "hist > 0": c("hist") > 0, "dif > dea": c("dif") > c("dea"), "ma10": c("close") > c("ma10"), "ma20": c("close") > c("ma20")}
    net = c("net")
    each = df.select((c("r") - X.COST).alias("net"), _chosen([(b & t, {"base": F.lit(k), "confirm": F.lit(n)}) for k, b in bases.items() for n, t in tests.items()])).select("net", "g.*")
    out = each.groupBy("base", "confirm").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), _won(net).alias("win"), ratio(F.sum(F.when(net > 0, net)), -F.sum(F.when(net < 0, net))).alias("pf"))
    return out.select("base", "confirm", "n", *r6("mean", "win", "pf"))


_SPLITS = {"all": "true", "weakest": "d_rs = 1", "weak": "d_rs BETWEEN 1 AND 3", "middle": "d_rs BETWEEN 4 AND 7", "strong": "d_rs BETWEEN 8 AND 10", "smallest 10 %": "size_grp = 0", "10 to 30 %": "size_grp BETWEEN 1 AND 2", "30 to 70 %": "size_grp BETWEEN 3 AND 6", "70 to 100 %": "size_grp BETWEEN 7 AND 9", "rising": "bull = true", "falling": "bull = false"}


@query("strength_splits", S.with_(ROWS, f""", mk AS (SELECT day, date, avg(ret) AS m FROM rws GROUP BY ALL), mn AS (SELECT *, product(1 + coalesce(m, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM mk), mr AS (SELECT date, nav / lag(nav, 20) OVER (ORDER BY day) - 1 AS m20 FROM mn),
    rk AS (SELECT rws.*, round(ret20 - m20, 9) AS rs FROM rws LEFT JOIN mr USING (date)), rd AS (SELECT *, {S.decile(S.rank_pct('rs'))} AS d_rs FROM rk), b AS (SELECT *, r - 0.003 AS net FROM rd WHERE d_ret20 BETWEEN 2 AND 6 AND r IS NOT NULL), u AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS variant, net FROM b WHERE {c}" for k, c in _SPLITS.items()) + ") SELECT variant, count(*) AS n, round(avg(net), 6) AS mean, round(median(net), 6) AS med, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM u GROUP BY variant"))
def strength_splits(spark, sf):
    """One selection split by strength against the market, by size and by market."""
    rs = strength(spark, sf).select("code", "date", F.col("rs_mkt20").alias("rs"))
    df = prepared(spark, sf).join(rs, ["code", "date"], "left").withColumn("d_rs", bins(rank_pct("rs", ["date"]))).where("d_ret20 BETWEEN 2 AND 6 AND r IS NOT NULL")
    d, s = F.col("d_rs"), F.col("size_grp")
    tests = {"all": F.lit(True), "weakest": d == 1, "weak": d <= 3, "middle": d.between(4, 7), "strong": d >= 8, "smallest 10 %": s == 0, "10 to 30 %": s.between(1, 2), "30 to 70 %": s.between(3, 6), "70 to 100 %": s >= 7, "rising": F.col("bull"), "falling": ~F.col("bull")}
    each = df.select((F.col("r") - X.COST).alias("net"), _chosen(_groups(tests))).select("net", "g.variant")
    each = staged(each, "strength-splits")
    out = each.groupBy("variant").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), _won(F.col("net")).alias("win"))
    return X.with_quantiles(out, each, ["variant"], "net", {"med": 0.5}).select("variant", "n", *r6("mean", "med", "win"))


_LH = (1, 5, 10, 20, 60)
_LAYERS = {"1 crossed": "crossed", "2 on volume": "crossed AND rvol20 > 1.1", "3 above ma60": "crossed AND rvol20 > 1.1 AND px_ma60_pct > 0", "4 rising market": "crossed AND rvol20 > 1.1 AND px_ma60_pct > 0 AND bull = true"}


@query("layered_entries", S.with_(ROWS, f", f AS (SELECT *, coalesce(round(close, 9) > ma20 AND round({S.lag('close')}, 9) <= {S.lag('ma20')}, false) AS crossed, {', '.join(f'round({S.lead("open", h + 1)} / {S.lead("open")} - 1, 9) AS f{h}' for h in _LH)} FROM rws), u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS layer, {h} AS horizon, f{h} AS v FROM f WHERE {c}" for k, c in _LAYERS.items() for h in _LH) + ") SELECT layer, horizon, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS med, round(stddev_samp(v), 6) AS sd, round(avg(CASE WHEN v > 0 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 6) AS win, round(avg(v) * sqrt(count(v)) / stddev_samp(v), 6) AS t FROM u WHERE v IS NOT NULL GROUP BY layer, horizon"))
def layered_entries(spark, sf):
    """A cross above the mean of 20, with further conditions laid on one by one, over five horizons."""
    df = prepared(spark, sf).select("code", "date", "open", "close", "ma20", "rvol20", "px_ma60_pct", "bull")
    crossed = F.coalesce((F.round("close", 9) > F.col("ma20")) & (F.round(lag("close"), 9) <= lag("ma20")), F.lit(False))
    df = df.withColumns({"crossed": crossed} | {f"f{h}": F.round(lead("open", h + 1) / lead("open") - 1, 9) for h in _LH}).where("crossed")
    one = F.col("rvol20") > 1.1
    two = one & (F.col("px_ma60_pct") > 0)
    layers = {"1 crossed": F.lit(True), "2 on volume": one, "3 above ma60": two, "4 rising market": two & F.col("bull")}
    each = df.select(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("v")) for h in _LH)).alias("h"), _chosen([(t, {"layer": F.lit(k)}) for k, t in layers.items()])).select("g.layer", F.inline("h")).where("v IS NOT NULL")
    out = each.groupBy("layer", "horizon").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), _won(F.col("v")).alias("win"))
    out = X.with_quantiles(out, each, ["layer", "horizon"], "v", {"med": 0.5})
    return out.select("layer", "horizon", "n", *r6("mean", "med", "sd", "win", t=ratio(F.col("mean") * F.sqrt(F.col("n").cast("double")), "sd")))


_ALT = {"z of ret20 < -1.5": "z < -1.5", "decile of ret20": "d_ret20 = 1", "tenth below ma60": "px_ma60_pct < -0.1"}


@query("alternative_definitions", S.with_(ROWS, f", f AS (SELECT *, (ret20 - avg(ret20) OVER (PARTITION BY day)) / nullif(stddev_samp(ret20) OVER (PARTITION BY day), 0) AS z, {', '.join(f'{S.lead("open", h + 1)} / {S.lead("open")} - 1 AS f{h}' for h in (5, 10, 20))} FROM rws), x AS (SELECT *, {', '.join(f'f{h} - avg(f{h}) OVER (PARTITION BY day) AS e{h}' for h in (5, 10, 20))} FROM f), u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS definition, {h} AS horizon, day, f{h} AS v, e{h} AS e FROM x WHERE {c} AND f{h} IS NOT NULL" for k, c in _ALT.items() for h in (5, 10, 20)) + "), d AS (SELECT definition, horizon, day, count(*) AS k, sum(v) AS s, avg(e) AS m FROM u GROUP BY ALL) SELECT definition, horizon, sum(k)::BIGINT AS n, round(sum(s) / sum(k), 6) AS gross, round(avg(m), 6) AS excess, round(avg(m) * sqrt(count(*)) / nullif(stddev_samp(m), 0), 6) AS t FROM d GROUP BY definition, horizon"))
def alternative_definitions(spark, sf):
    """Three definitions of oversold over three horizons: gross return, and excess over the day's mean with days counting alike."""
    df = prepared(spark, sf).select("code", "date", "day", "open", "ret20", "d_ret20", "px_ma60_pct").withColumns({f"f{h}": lead("open", h + 1) / lead("open") - 1 for h in (5, 10, 20)})
    day = Window.partitionBy("day")
    df = df.withColumns({"z": ratio(F.col("ret20") - F.avg("ret20").over(day), F.stddev_samp("ret20").over(day))} | {f"e{h}": F.col(f"f{h}") - F.avg(f"f{h}").over(day) for h in (5, 10, 20)})
    tests = {"z of ret20 < -1.5": F.col("z") < -1.5, "decile of ret20": F.col("d_ret20") == 1, "tenth below ma60": F.col("px_ma60_pct") < -0.1}
    both = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("v"), F.col(f"e{h}").alias("e")) for h in (5, 10, 20)))
    each = df.select("day", both.alias("h"), _chosen([(t, {"definition": F.lit(k)}) for k, t in tests.items()])).select("day", "g.definition", F.inline("h")).where("v IS NOT NULL")
    days = each.groupBy("definition", "horizon", "day").agg(F.count("*").alias("k"), F.sum("v").alias("s"), F.avg("e").alias("m"))
    out = days.groupBy("definition", "horizon").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.avg("m").alias("excess"), F.stddev_samp("m").alias("sd"), F.count("*").alias("days"))
    return out.select("definition", "horizon", "n", *r6("excess", gross=F.col("s") / F.col("n"), t=ratio(F.col("excess") * F.sqrt(F.col("days").cast("double")), "sd")))
