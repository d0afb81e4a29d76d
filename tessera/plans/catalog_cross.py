"""Queries over the cross-section of a period, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bins, lead, rank_pct, ratio
from ..operators import cross as X
from ..operators import simulate as D
from ..sources.files import staged
from ..sources.panel import calendar
from ..sources.versions import reused
from . import sql as S
from .catalog_windows import base, sources

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOLD = 20


def query(name: str, oracle: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = S.nudged(oracle)
        return f

    return add


def r6(*names: str, **more) -> list:  # noqa: ANN003
    return [F.round(F.col(c) + S.NUDGE, 6).alias(c) for c in names] + [F.round(c + S.NUDGE, 6).alias(k) for k, c in more.items()]


_M = lambda n, c="close": S.mean(c, n)
FEATURES = S.CLEAN + f""", feat AS MATERIALIZED (SELECT code, date, day, row, open, high, low, close, volume, turnover, ind_code, ind_name, board, can_buy, can_sell, ret,
    {', '.join(f"round(close / {S.lag('close', k)} - 1, 9) AS ret{k}" for k in (5, 10, 20, 40, 60))}, {', '.join(f"round(close / ({_M(n)}) - 1, 9) AS px_ma{n}_pct" for n in (20, 60, 120))},
    {', '.join(f"round({_M(n)}, 9) AS ma{n}" for n in (5, 10, 20))}, round(volume / ({S.rolling('median(volume)', 'volume', 20, past=True)}), 9) AS rvol20, round(({_M(5, 'volume')}) / ({_M(20, 'volume')}), 9) AS vt_5_20,
    round(({S.rolling('stddev_samp(ret)', 'ret', 20)}) * sqrt(252), 9) AS hv20, round({S.mean('turnover', 20, past=True)}, 4) AS amt20_lag FROM base),
dec AS MATERIALIZED (SELECT *, {', '.join(f"{S.decile(S.rank_pct(c))} AS d_{c}" for c in X.DECILED)}, {S.decile(S.rank_pct('amt20_lag'))} - 1 AS size_grp FROM feat)"""


def _along(spark, sf):
    df = X.features(base(spark, sf)).withColumns({"oret": F.round(lead("open") / F.col("open") - 1, 10), "oret_sig": lead("open", 2) / lead("open") - 1})
    return D.with_fills(df, HOLD)


def along(spark, sf) -> DataFrame:
    """Clean rows with all that runs along time, factors and fills, in one shuffle; written once and read again like the clean rows."""
    return reused(spark, sources(sf), "along", lambda: _along(spark, sf))


def features(spark, sf):
    return along(spark, sf).drop("oret", "oret_sig", "buy_px", "sell_px", "entry_day", "due_day", "has_entry", "has_exit", "r")


def periods(spark, sf) -> DataFrame:
    """What a row needs to know of its period, written once: bounds of the bins, and the market of all rows. A row a period."""

    def made() -> DataFrame:
        market = X.market_states(base(spark, sf), indices=X.INDICES[:1]).where("ma_len = 60")
        market = market.select("date", "bull", F.col("hv20").alias("mkt_hv20"), "hv_med", "breadth")
        return X.bin_cuts(along(spark, sf), (*X.DECILED, "amt20_lag")).join(market, "date", "left").repartition(1)

    return reused(spark, sources(sf), "periods", made)


def deciled(spark, sf, *columns):
    return X.with_deciles(features(spark, sf), columns or X.DECILED, periods(spark, sf))


@query("rank_pct_avg", S.with_(FEATURES, f"SELECT code, date, round({S.rank_pct('ret20')}, 6) AS p FROM feat"))
def rank_pct_avg(spark, sf):
    return features(spark, sf).select("code", "date", *r6(p=rank_pct("ret20", ["date"])))


@query("decile_bins", S.with_(FEATURES, f"SELECT code, date, {', '.join(f'd_{c}' for c in X.DECILED)} FROM dec"))
def decile_bins(spark, sf):
    return deciled(spark, sf).select("code", "date", *(f"d_{c}" for c in X.DECILED))


@query("size_group", S.with_(FEATURES, "SELECT code, date, size_grp FROM dec"))
def size_group(spark, sf):
    return deciled(spark, sf, "ret5").select("code", "date", "size_grp")


MKT = ", mkt AS MATERIALIZED (SELECT day, date, avg(ret) AS mkt_ret, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS breadth, count(ret) AS n FROM base GROUP BY ALL)"


@query("market_return", S.with_(S.CLEAN + MKT, "SELECT day, date, round(mkt_ret, 6) AS mkt_ret, round(breadth, 6) AS breadth, n FROM mkt"))
def market_return(spark, sf):
    return X.market_returns(base(spark, sf)).select("day", "date", *r6("mkt_ret", "breadth"), "n")


GRP = """, g1 AS (SELECT date, ind_code, avg(ret) AS r FROM base GROUP BY ALL), g2 AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY ind_code ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM g1),
grp AS (SELECT date, ind_code, r AS ind_ret1, """ + ", ".join(f"nav / lag(nav, {k}) OVER (PARTITION BY ind_code ORDER BY date) - 1 AS ind_ret{k}" for k in (5, 10, 20, 60)) + " FROM g2)"
_IR = [f"ind_ret{k}" for k in (1, 5, 10, 20, 60)]


@query("group_return", S.with_(S.CLEAN + GRP, f"SELECT date, ind_code, {S.rounded(_IR)} FROM grp"))
def group_return(spark, sf):
    return X.group_returns(base(spark, sf), ["ind_code"], name="ind").select("date", "ind_code", *r6(*_IR))


@query("relative_strength", S.with_(FEATURES + GRP, f"SELECT f.code, f.date, {', '.join(f'round(f.ret{k} - grp.ind_ret{k}, 6) AS rs_ind{k}' for k in (5, 10, 20, 60))} FROM feat f JOIN grp USING (date, ind_code)"))
def relative_strength(spark, sf):
    f = features(spark, sf)
    groups = X.group_returns(base(spark, sf), ["ind_code"], name="ind")
    return f.join(groups, ["date", "ind_code"], "left").select("code", "date", *r6(**{f"rs_ind{k}": F.col(f"ret{k}") - F.col(f"ind_ret{k}") for k in (5, 10, 20, 60)}))


_IDX = " UNION ALL ".join(f"SELECT '{k}' AS index, day, date, ret FROM dec" + ("" if lo is None else f" WHERE size_grp BETWEEN {lo} AND {hi}") for k, lo, hi in X.INDICES)
STATES = FEATURES + f""", each AS ({_IDX}), daily AS (SELECT index, day, date, avg(ret) AS r, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS breadth FROM each GROUP BY ALL),
navs AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY index ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav, CASE WHEN count(*) OVER (PARTITION BY index ORDER BY day ROWS 19 PRECEDING) >= 20 THEN stddev_samp(coalesce(r, 0)) OVER (PARTITION BY index ORDER BY day ROWS 19 PRECEDING) * sqrt(252) END AS hv20 FROM daily),
meds AS (SELECT *, median(hv20) OVER (PARTITION BY index) AS hv_med FROM navs), lens AS (SELECT unnest([20, 60, 120])::INTEGER AS ma_len),
avgs AS (""" + " UNION ALL ".join(f"SELECT *, {m} AS ma_len, CASE WHEN count(nav) OVER (PARTITION BY index ORDER BY day ROWS {m - 1} PRECEDING) >= {m} THEN avg(nav) OVER (PARTITION BY index ORDER BY day ROWS {m - 1} PRECEDING) END AS ma FROM meds" for m in X.MARKET_MA) + """),
states AS MATERIALIZED (SELECT index, day, date, nav, breadth, hv20, hv_med, ma_len, ma, nav / ma - 1 AS dist, coalesce(nav > ma, false) AS bull FROM avgs)"""
_S = ["nav", "breadth", "hv20", "hv_med", "ma", "dist"]


def states(spark, sf):
    return X.market_states(deciled(spark, sf, "ret5"))


@query("market_states", S.with_(STATES, f"SELECT index, day, date, ma_len, bull, {S.rounded(_S)} FROM states"))
def market_states(spark, sf):
    return states(spark, sf).select("index", "day", "date", "ma_len", "bull", *r6(*_S))


CHAIN = ", cs AS (SELECT *, sum(ln(1 + coalesce(mkt_ret, 0))) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS s FROM mkt), chain AS MATERIALIZED (SELECT day, date, mkt_ret, " + ", ".join(f"exp(lead(s, {h + 1}) OVER (ORDER BY day) - lead(s) OVER (ORDER BY day)) - 1 AS chain{h}" for h in (1, 5, 10, 20, 40, 60)) + " FROM cs)"


@query("chain_forward", S.with_(S.CLEAN + MKT + CHAIN, f"SELECT day, date, {S.rounded([f'chain{h}' for h in (1, 5, 10, 20, 40, 60)])} FROM chain"))
def chain_forward(spark, sf):
    return X.forward_chain(X.market_returns(base(spark, sf))).select("day", "date", *r6(*(f"chain{h}" for h in (1, 5, 10, 20, 40, 60))))


#: Fixed-horizon results of rows: tradable forward returns and excess over the market's chain.
FWD = FEATURES + MKT + CHAIN + ", fw AS MATERIALIZED (SELECT dec.*, " + ", ".join(f"{S.lead('open', h + 1)} / {S.lead('open')} - 1 AS fwd{h}, {S.lead('open', h + 1)} / {S.lead('open')} - 1 - chain{h} AS ex{h}" for h in (1, 5, 10, 20, 60)) + " FROM dec JOIN chain USING (day, date))"


def forward(spark, sf):
    df = deciled(spark, sf)
    chain = X.forward_chain(X.market_returns(base(spark, sf))).drop("mkt_ret", "breadth", "n")
    fw = {f"fwd{h}": ratio(lead("open", h + 1), lead("open")) - 1 for h in (1, 5, 10, 20, 60)}
    out = df.join(F.broadcast(chain), ["day", "date"]).withColumns(fw)  # a row per period
    return out.withColumns({f"ex{h}": F.col(f"fwd{h}") - F.col(f"chain{h}") for h in (1, 5, 10, 20, 60)})


def _ext(source: str, value: str, by: str) -> str:
    return f"""SELECT {by}, sum(rows)::BIGINT AS n, count(*) AS days, round(avg(m), 6) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 6) AS t, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS lo, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS hi
    FROM (SELECT {by}, day, avg({value}) AS m, count(*) AS rows FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY {by} HAVING sum(rows) >= 40 AND count(*) >= 5"""


@query("decile_excess_t", S.with_(FWD, _ext("(SELECT * FROM fw WHERE d_ret20 IS NOT NULL)", "ex20", "d_ret20")))
def decile_excess_t(spark, sf):
    df = forward(spark, sf).where("d_ret20 IS NOT NULL")
    return X.excess_t(df, "ex20", ["d_ret20"]).select("d_ret20", "n", "days", *r6("mean", "t", "lo", "hi"))


_F = ["ret20", "px_ma60_pct", "hv20", "rvol20"]
_ICQ = " UNION ALL ".join(f"SELECT '{f}' AS factor, day, date, {f}::DOUBLE AS x, fwd20 AS y FROM fw WHERE {f} IS NOT NULL AND fwd20 IS NOT NULL" for f in _F)
ICS = FWD + f""", st AS ({_ICQ.replace('fwd20 AS y', 'round(fwd20, 9) AS y')}), rk AS (SELECT factor, day, date, {S.rank_pct('x', 'factor, date')} AS rx, {S.rank_pct('y', 'factor, date')} AS ry FROM st), ics AS (SELECT factor, day, corr(rx, ry) AS ic, count(*) AS n FROM rk GROUP BY ALL HAVING count(*) >= 30)"""


def ics(spark, sf):
    return X.daily_ic(forward(spark, sf).withColumn("fwd20", F.round("fwd20", 9)), _F, "fwd20")


@query("daily_ic", S.with_(ICS, "SELECT factor, day, round(ic, 6) AS ic, n FROM ics"))
def daily_ic(spark, sf):
    return ics(spark, sf).select("factor", "day", *r6("ic"), "n")


@query("ic_summary", S.with_(ICS, "SELECT factor, count(*) AS days, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS pos_rate, round(avg(abs(ic)), 6) AS mean_abs, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY factor"))
def ic_summary(spark, sf):
    return X.ic_summary(ics(spark, sf)).select("factor", "days", *r6("mean_ic", "sd_ic", "pos_rate", "mean_abs", "ir", "t"))


RUNS = STATES + ", rn AS (SELECT *, CASE WHEN bull <> coalesce(lag(bull) OVER (PARTITION BY index, ma_len ORDER BY day), NOT bull) THEN 1 ELSE 0 END AS new FROM states), rr AS (SELECT *, sum(new) OVER (PARTITION BY index, ma_len ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM rn), runs AS (SELECT *, count(*) OVER (PARTITION BY index, ma_len, run) AS run_len FROM rr)"


@query("bull_runs", S.with_(RUNS, "SELECT index, ma_len, day, bull, run, run_len, bull AND run_len >= 20 AS bull_run FROM runs"))
def bull_runs(spark, sf):
    return X.bull_runs(states(spark, sf)).select("index", "ma_len", "day", "bull", "run", "run_len", "bull_run")


@query("regime_group_means", S.with_(STATES, "SELECT size_grp, board, bull, round(avg(ret), 6) AS mean, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, count(*) AS n FROM dec JOIN states USING (day) WHERE index = 'all' AND ma_len = 60 GROUP BY ALL"))
def regime_group_means(spark, sf):
    market = states(spark, sf).where("index = 'all' AND ma_len = 60").select("day", "bull")
    out = deciled(spark, sf, "ret5").join(F.broadcast(market), "day").groupBy("size_grp", "board", "bull").agg(F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("win"), F.count("*").alias("n"))
    return out.select("size_grp", "board", "bull", *r6("mean", "win"), "n")


@query("quantile_returns", S.with_(FWD, """, s AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY ret20, code) AS rk FROM fw WHERE ret20 IS NOT NULL AND fwd20 IS NOT NULL)
    SELECT q, round(avg(fwd20), 6) AS mean, round(avg(CASE WHEN fwd20 > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, count(*) AS n FROM (SELECT *, least(floor((rk - 1) / (n / 5.0)), 4)::INTEGER AS q FROM s WHERE n >= 25) GROUP BY q"""))
def quantile_returns(spark, sf):
    return X.quantile_groups(forward(spark, sf), "ret20", "fwd20").select("q", *r6("mean", "win"), "n")


@query("welch_regime", S.with_(STATES + MKT + CHAIN, """, d AS (SELECT chain20 AS v, bull FROM chain JOIN states USING (day) WHERE index = 'all' AND ma_len = 60 AND chain20 IS NOT NULL),
    a AS (SELECT avg(v) FILTER (NOT bull) AS bear, avg(v) FILTER (bull) AS bull, var_samp(v) FILTER (NOT bull) AS v0, var_samp(v) FILTER (bull) AS v1, count(*) FILTER (NOT bull) AS n0, count(*) FILTER (bull) AS n1 FROM d)
    SELECT round(bear, 6) AS bear, round(bull, 6) AS bull, round(bear - bull, 6) AS diff, round((bear - bull) / sqrt(v0 / n0 + v1 / n1), 6) AS t, round((bear - bull) / sqrt(v0 / n0 + v1 / n1) / sqrt(20), 6) AS t_deflated, n0, n1 FROM a WHERE n0 >= 30 AND n1 >= 30"""))
def welch_regime(spark, sf):
    market = states(spark, sf).where("index = 'all' AND ma_len = 60").select("day", "bull")
    days = X.forward_chain(X.market_returns(base(spark, sf))).join(market, "day").where("chain20 IS NOT NULL")
    return X.welch(days, "chain20", "bull", 20).select(*r6("bear", "bull", "diff", "t", "t_deflated"), "n0", "n1")


@query("interaction_cells", S.with_(FWD, f", c AS (SELECT *, {S.decile(S.rank_pct('ret20'), 5)} AS qa, {S.decile(S.rank_pct('hv20'), 5)} AS qb FROM fw) SELECT qa, qb, round(avg(ex20), 6) AS mean, count(ex20) AS n FROM c WHERE qa IS NOT NULL AND qb IS NOT NULL GROUP BY qa, qb"))
def interaction_cells(spark, sf):
    df = forward(spark, sf).withColumns({"qa": bins(rank_pct("ret20", ["date"]), 5), "qb": bins(rank_pct("hv20", ["date"]), 5)})
    return df.where("qa IS NOT NULL AND qb IS NOT NULL").groupBy("qa", "qb").agg(F.avg("ex20").alias("mean"), F.count("ex20").alias("n")).select("qa", "qb", *r6("mean"), "n")


@query("industry_neutral", S.with_(FWD, ", i AS (SELECT *, fwd20 - avg(fwd20) OVER (PARTITION BY date, ind_code) AS ne FROM fw WHERE fwd20 IS NOT NULL) " + _ext("(SELECT * FROM i WHERE d_px_ma60_pct IS NOT NULL)", "ne", "d_px_ma60_pct")))
def industry_neutral(spark, sf):
    from pyspark.sql import Window

    df = forward(spark, sf).where("fwd20 IS NOT NULL").withColumn("ne", F.col("fwd20") - F.avg("fwd20").over(Window.partitionBy("date", "ind_code")))
    return X.excess_t(df.where("d_px_ma60_pct IS NOT NULL"), "ne", ["d_px_ma60_pct"]).select("d_px_ma60_pct", "n", "days", *r6("mean", "t", "lo", "hi"))


@query("missing_rate", S.with_(FEATURES, "SELECT " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in ("ret20", "px_ma120_pct", "hv20", "amt20_lag")) + " FROM feat"))
def missing_rate(spark, sf):
    cols = ["ret20", "px_ma120_pct", "hv20", "amt20_lag"]
    return X.missing_rates(features(spark, sf), cols).select(*r6(*cols))


@query("pooled_depth_bins", S.with_(FWD, """, z AS (SELECT *, (rank() OVER (ORDER BY px_ma60_pct) + (count(*) OVER (PARTITION BY px_ma60_pct) - 1) / 2.0) / count(*) OVER () AS p FROM fw WHERE px_ma60_pct IS NOT NULL),
    b AS (SELECT *, least(floor(p * 10), 9)::INTEGER + 1 AS bin FROM z) SELECT bin, round(avg(fwd20), 6) AS mean, round(median(fwd20), 6) AS med, round(avg(ex20), 6) AS mean_ex, count(*) AS n FROM b GROUP BY bin"""))
def pooled_depth_bins(spark, sf):
    """Ranks over the pooled sample: counts by value first, running counts over these, then a join by value."""
    df = forward(spark, sf).where("px_ma60_pct IS NOT NULL")
    from pyspark.sql import Window

    values = df.groupBy("px_ma60_pct").agg(F.count("*").alias("k"))
    # running counts in two levels, so no task sees all values: by slice of the value range, then within it
    values = values.withColumn("slice", F.floor(F.col("px_ma60_pct") * 200))
    slices = values.groupBy("slice").agg(F.sum("k").alias("m")).withColumns({"before": F.sum("m").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("m").over(Window.partitionBy())})
    w = Window.partitionBy("slice").orderBy("px_ma60_pct").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(F.broadcast(slices.select("slice", "before", "all")), "slice").withColumn("below", F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("k").over(w), F.lit(0)))
    p = (F.col("below") + 1 + (F.col("k") - 1) / 2) / F.col("all")
    each = staged(df.join(placed.select("px_ma60_pct", bins(p).alias("bin")), "px_ma60_pct").select("bin", "fwd20", "ex20"), "pooled-bins")
    out = each.groupBy("bin").agg(F.avg("fwd20").alias("mean"), F.avg("ex20").alias("mean_ex"), F.count("*").alias("n"))
    return X.with_quantiles(out, each, ["bin"], "fwd20", {"med": 0.5}).select("bin", *r6("mean", "med", "mean_ex"), "n")


def _eliminated(k: int) -> str:
    """The normal equations of each day, solved by elimination: tables e0..ek of columns a<row>_<column>, column k the right side."""
    cell = lambda i, j, p: f"a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p}"
    first = ", ".join(f"{f'corr({_F[i]}, {_F[j]})' if j < k else f'corr({_F[i]}, fwd20) * stddev_samp(fwd20)'} AS a{i}_{j}" for i in range(k) for j in range(k + 1))
    out = f"""e0 AS (SELECT day, {first} FROM fw WHERE {' AND '.join(f'{f} IS NOT NULL' for f in [*_F, 'fwd20'])} GROUP BY day HAVING count(*) >= 30 AND {' AND '.join(f'stddev_samp({f}) > 0' for f in _F)})"""
    for p in range(k):
        out += f", e{p + 1} AS (SELECT day, " + ", ".join(f"{cell(i, j, p)} AS a{i}_{j}" for i in range(k) for j in range(k + 1)) + f" FROM e{p})"
    return out


@query("fama_macbeth", S.with_(FWD, f", {_eliminated(len(_F))}, bt AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, a{i}_{len(_F)} / a{i}_{i} AS beta FROM e{len(_F)}" for i, f in enumerate(_F)) + ") SELECT factor, count(*) AS days, round(avg(beta), 6) AS mean_beta, round(avg(beta) * sqrt(count(*)) / nullif(stddev_samp(beta), 0), 5) AS t FROM bt GROUP BY factor"))
def fama_macbeth(spark, sf):
    return X.fama_macbeth(forward(spark, sf), _F, "fwd20").select("factor", "days", *r6("mean_beta"), F.round("t", 5).alias("t"))


@query("calendar_days", S.with_(S.CLEAN, "SELECT date, day FROM cal"))
def calendar_days(spark, sf):
    return calendar(base(spark, sf).drop("day"))
