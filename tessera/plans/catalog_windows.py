"""Queries along the time axis, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lag, lead, median, rolling
from ..operators import indicators as I
from ..sources.panel import calendar, clean, panel, panel_start, with_row
from ..sources.versions import reused
from . import sql as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def sources(sf_dir: str) -> list[str]:
    """The files behind the panel."""
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reused(spark, sources(sf_dir), "base", lambda: with_row(clean(panel(spark, sf_dir), start=panel_start(spark, sf_dir))))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of the clean rows, from the written ones: a row a period."""
    return reused(spark, sources(sf_dir), "days", lambda: calendar(_clean(spark, sf_dir)))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows with their positions, written once and read again by later queries until one of the files behind them changes."""
    return _clean(spark, sf_dir).join(F.broadcast(days(spark, sf_dir)), "date")


def out(df: DataFrame, *exact: str, digits: int = 6, **rounded: Column | str) -> DataFrame:
    """Key, exact columns, and rounded ones."""
    return df.select("code", "date", *exact, *(F.round((F.col(c) if isinstance(c, str) else c) + (S.NUDGE if digits == 6 else 0), digits).alias(k) for k, c in rounded.items()))


def same(names: list[str]) -> dict[str, str]:
    return {n: n for n in names}


def query(name: str, oracle: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = S.nudged(oracle)
        return f

    return add


P, B = S.PANEL, S.CLEAN
PX = ["open", "high", "low", "close"]


@query("panel_adapter", S.with_(P, f"SELECT code, date, {S.rounded(PX)}, volume, turnover, ind_code, board, is_st, can_buy, can_sell FROM panel"))
def panel_adapter(spark, sf):
    return out(panel(spark, sf), "volume", "turnover", "ind_code", "board", "is_st", "can_buy", "can_sell", **same(PX))


@query("clean_scan", S.with_(B, "SELECT code, date, day, row, days_since_list::INTEGER AS days_since_list, round(ret, 6) AS ret FROM base"))
def clean_scan(spark, sf):
    return out(base(spark, sf), "day", "row", "days_since_list", ret="ret")


MA_COLS = [f"ma{n}" for n in I.MA] + [f"vol{n}" for n in I.VOLUME_MA] + [f"vol_ratio{n}" for n in I.VOLUME_MA]
MA_SQL = ", ".join([f"{S.mean('close', n, max(2, n // 2))} AS ma{n}" for n in I.MA] + [f"{S.mean('volume', n, max(2, n // 2))} AS vol{n}" for n in I.VOLUME_MA])


@query("roll_mean_minp", S.with_(P, f", m AS (SELECT *, {MA_SQL} FROM panel), r AS (SELECT *, {', '.join(f'{S.ratio("volume", f"vol{n}")} AS vol_ratio{n}' for n in I.VOLUME_MA)} FROM m) SELECT code, date, {S.rounded(MA_COLS)} FROM r"))
def roll_mean_minp(spark, sf):
    return out(I.moving_averages(panel(spark, sf)), **same(MA_COLS))


FULL = {"mean": "avg(close)", "median": "median(close)", "std": "stddev_samp(close)", "max": "max(close)", "min": "min(close)", "sum": "sum(close)"}


@query("roll_full_window", S.with_(P, ", f AS (SELECT code, date, " + ", ".join(f"round({S.rolling(a, 'close', 20)}, 6) AS {k}20" for k, a in FULL.items()) + f" FROM panel) SELECT *, mean20 > {S.lag('mean20', 5)} AS ma20_up FROM f"))
def roll_full_window(spark, sf):
    aggs = {"mean": F.avg, "median": median, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
    full = out(panel(spark, sf), **{f"{k}20": rolling(a, "close", 20) for k, a in aggs.items()})
    return full.withColumn("ma20_up", F.col("mean20") > lag("mean20", 5))


@query("roll_prev_window", S.with_(P, f"SELECT code, date, round({S.rolling('max(high)', 'high', 20, past=True)}, 6) AS high20_prev, round({S.mean('turnover', 20, past=True)}, 6) AS amt20_lag, round({S.mean('turnover', 60, past=True)}, 6) AS amt60_lag, round(CASE WHEN volume > 0 THEN turnover / volume END, 6) AS vwap FROM panel"))
def roll_prev_window(spark, sf):
    df = panel(spark, sf)
    return out(df, high20_prev=rolling(F.max, "high", 20, past=True), amt20_lag=rolling(F.avg, "turnover", 20, past=True), amt60_lag=rolling(F.avg, "turnover", 60, past=True), vwap=F.when(F.col("volume") > 0, F.col("turnover") / F.col("volume")))


RV = [f"{k}{n}" for k in ("rvol", "vr") for n in (10, 20, 60)]


@query("rvol_median", S.with_(P, "SELECT code, date, " + ", ".join([f"round({S.ratio('volume', S.rolling('median(volume)', 'volume', n, past=True))}, 6) AS rvol{n}" for n in (10, 20, 60)] + [f"round({S.ratio('volume', S.mean('volume', n, past=True))}, 6) AS vr{n}" for n in (10, 20, 60)]) + " FROM panel"))
def rvol_median(spark, sf):
    return out(I.relative_volume(panel(spark, sf)), **same(RV))


#: dif, dea, hist by row.
MACD = P + f""", e1 AS ({S.ewm('panel', 'close', 12, 'f')}), e2 AS ({S.ewm('panel', 'close', 26, 's')}),
d AS (SELECT panel.*, f - s AS dif FROM panel JOIN e1 USING (code, date) JOIN e2 USING (code, date)), e3 AS ({S.ewm('d', 'dif', 9, 'dea')}),
m AS MATERIALIZED (SELECT d.*, dea, 2 * (dif - dea) AS hist FROM d JOIN e3 USING (code, date))"""


def with_macd(spark, sf):
    return I.macd(panel(spark, sf))


@query("macd_ewm", S.with_(MACD, f"SELECT code, date, {S.rounded(['dif', 'dea', 'hist'])} FROM m"))
def macd_ewm(spark, sf):
    return out(with_macd(spark, sf), **same(["dif", "dea", "hist"]))


#: Comparisons of computed values are made on rounded ones, so both engines see the same ties.
ROUNDED = MACD + ", q AS (SELECT code, date, close, high, low, volume, round(dif, 9) AS dif, round(dea, 9) AS dea, round(hist, 9) AS hist FROM m)"


def rounded_macd(spark, sf):
    return with_macd(spark, sf).withColumns({c: F.round(c, 9) for c in ("dif", "dea", "hist")})


@query("macd_events", S.with_(ROUNDED, f""", h AS (SELECT *, {S.lag('hist')} AS hist_prev, hist - {S.lag('hist')} AS hist_slope,
    coalesce(dif > dea AND {S.lag('dif')} <= {S.lag('dea')}, false) AS golden_cross, coalesce(dea > dif AND {S.lag('dea')} <= {S.lag('dif')}, false) AS death_cross, row_number() OVER ({S.E_}) AS i FROM q),
    k AS (SELECT *, max(CASE WHEN NOT coalesce(hist_slope > 0, false) THEN i END) OVER ({S.E_} ROWS UNBOUNDED PRECEDING) AS broke FROM h)
    SELECT code, date, golden_cross, death_cross, coalesce(hist > 0 AND hist_prev <= 0, false) AS hist_cross_up, coalesce(hist < 0 AND hist_prev >= 0, false) AS hist_cross_dn,
    golden_cross AND dif > 0 AS gc_above, golden_cross AND dif <= 0 AS gc_below, (i - coalesce(broke, 0))::INTEGER AS hist_up_streak, round(hist_slope, 6) AS hist_slope, round({S.lag('hist_slope')}, 6) AS hist_slope_prev,
    round((dif - dea) / nullif(close, 0), 6) AS dif_dea_dist_pct FROM k"""))
def macd_events(spark, sf):
    return out(I.macd_events(rounded_macd(spark, sf)), "golden_cross", "death_cross", "hist_cross_up", "hist_cross_dn", "gc_above", "gc_below", "hist_up_streak", **same(["hist_slope", "hist_slope_prev", "dif_dea_dist_pct"]))


LOC = [f"px_ma{n}_pct" for n in (20, 60, 120)] + ["ma20_ma60", "ma60_ma120"] + [f"dist_{k}{n}" for k in ("high", "low") for n in (20, 60)] + [f"px_h{n}" for n in (20, 60, 120)]
LOC_SQL = ", ".join([f"{S.rolling('max(high)', 'high', n, n // 2)} AS high{n}, {S.rolling('min(low)', 'low', n, n // 2)} AS low{n}" for n in (20, 60)] + [f"{S.rolling('max(high)', 'high', n, past=True)} AS high{n}_prev, {S.mean('close', n)} AS m{n}" for n in (20, 60, 120)])


@query("price_location", S.with_(P, f", l AS (SELECT *, {LOC_SQL} FROM panel) SELECT code, date, " + ", ".join([f"round(close / m{n} - 1, 6) AS px_ma{n}_pct, round(close / high{n}_prev - 1, 6) AS px_h{n}" for n in (20, 60, 120)] + ["round(m20 / m60 - 1, 6) AS ma20_ma60, round(m60 / m120 - 1, 6) AS ma60_ma120"] + [f"round(close / high{n} - 1, 6) AS dist_high{n}, round(close / low{n} - 1, 6) AS dist_low{n}" for n in (20, 60)]) + " FROM l"))
def price_location(spark, sf):
    return out(I.price_location(panel(spark, sf)), **same(LOC))


RET = [f"ret{k}" for k in (3, 5, 10, 20, 40, 60)] + [f"fwd_ret{h}" for h in (1, 5, 10, 20, 60)] + [f"fwd{h}" for h in (1, 5, 10, 20, 40, 60)] + ["oret", "oret_sig", "cret", "next_ret_oc"]
RET_SQL = ", ".join([f"close / {S.lag('close', k)} - 1 AS ret{k}" for k in (3, 5, 10, 20, 40, 60)] + [f"{S.lead('close', h)} / close - 1 AS fwd_ret{h}" for h in (1, 5, 10, 20, 60)] + [f"{S.lead('open', h + 1)} / {S.lead('open')} - 1 AS fwd{h}" for h in (1, 5, 10, 20, 40, 60)] + [f"{S.lead('open')} / open - 1 AS oret, {S.lead('open', 2)} / {S.lead('open')} - 1 AS oret_sig, close / {S.lag('close')} - 1 AS cret, {S.lead('close')} / {S.lead('open')} - 1 AS next_ret_oc"])


@query("returns_all", S.with_(P, f", r AS (SELECT code, date, {RET_SQL} FROM panel) SELECT code, date, {S.rounded(RET)} FROM r"))
def returns_all(spark, sf):
    return out(I.returns(panel(spark, sf)), **same(RET))


@query("divergence", S.with_(ROUNDED, f""", x AS (SELECT *, row_number() OVER ({S.E_}) AS i, {S.rolling('min(low)', 'low', 60)} AS lo, {S.rolling('max(high)', 'high', 60)} AS hi FROM q),
    u AS (SELECT code, date, i - {S.lag('i')} <= 90 AND low < {S.lag('low')} * 0.999 AND dif > {S.lag('dif')} AS f FROM x WHERE low <= lo * 1.0001),
    v AS (SELECT code, date, i - {S.lag('i')} <= 90 AND high > {S.lag('high')} * 1.001 AND dif < {S.lag('dif')} AS f FROM x WHERE high >= hi * 0.9999),
    y AS (SELECT q.code, q.date, coalesce(u.f, false) AS dv_bull, coalesce(v.f, false) AS dv_bear FROM q LEFT JOIN u ON u.code = q.code AND u.date = q.date LEFT JOIN v ON v.code = q.code AND v.date = q.date)
    SELECT *, max(dv_bull) OVER {S.frame(10)} AS dv_bull_recent FROM y"""))
def divergence(spark, sf):
    made = I.divergence(rounded_macd(spark, sf))
    return made.select("code", "date", "dv_bull", "dv_bear", I.recent("dv_bull").alias("dv_bull_recent"))


VT = ["vchg1", "vchg3", "vchg5", "vt_5_20", "vt_10_20", "vt_20_60", "dvt5", "dvt10", "volz20"]
VT_SQL = ", ".join([f"{S.mean('volume', n)} AS v{n}" for n in (5, 10, 20, 60)] + [f"{S.ratio('volume', S.lag('volume', k))} - 1 AS vchg{k}" for k in (1, 3, 5)] + [f"(volume - {S.mean('volume', 20, past=True)}) / nullif({S.rolling('stddev_samp(volume)', 'volume', 20, past=True)}, 0) AS volz20"])


@query("volume_trend", S.with_(P, f", a AS (SELECT *, {VT_SQL} FROM panel), b AS (SELECT *, v5 / v20 AS vt_5_20, v10 / v20 AS vt_10_20, v20 / v60 AS vt_20_60, v5 / {S.lag('v5', 5)} - 1 AS dvt5, v10 / {S.lag('v10', 10)} - 1 AS dvt10 FROM a) SELECT code, date, {S.rounded(VT)}, CASE WHEN volz20 < -1 THEN 0 WHEN volz20 < 0 THEN 1 WHEN volz20 < 1 THEN 2 WHEN volz20 < 2 THEN 3 WHEN volz20 IS NOT NULL THEN 4 END AS volz_bin FROM b"))
def volume_trend(spark, sf):
    return out(I.volume_trend(panel(spark, sf)), "volz_bin", **same(VT))


UD = [f"{k}{n}" for n in (5, 10, 20) for k in ("upvol_r", "dnvol_r", "ud_vol")]


def ud_sql(n: int) -> str:
    f, full = S.frame(n), f"count(ret) OVER {S.frame(n)} = {n}"
    up, dn = (f"sum(CASE WHEN ret {o} 0 THEN volume ELSE 0 END) OVER {f}" for o in "><")
    nu, nd = (f"sum(CASE WHEN ret {o} 0 THEN 1 ELSE 0 END) OVER {f}" for o in "><")
    return f"CASE WHEN {full} THEN {S.ratio(up, f'sum(volume) OVER {f}')} END AS upvol_r{n}, CASE WHEN {full} THEN {S.ratio(dn, f'sum(volume) OVER {f}')} END AS dnvol_r{n}, CASE WHEN {full} THEN ({S.ratio(up, nu)}) / nullif({S.ratio(dn, nd)}, 0) END AS ud_vol{n}"


@query("updown_volume", S.with_(B, f", u AS (SELECT code, date, {', '.join(map(ud_sql, (5, 10, 20)))} FROM base) SELECT code, date, {S.rounded(UD)} FROM u"))
def updown_volume(spark, sf):
    return out(I.up_down_volume(base(spark, sf)), **same(UD))


ST = [f"st{s}{n}" for s in "ABCD" for n in (1, 5, 10, 20)]


@query("volume_structure", S.with_(B, f""", a AS (SELECT *, volume > {S.mean('volume', 20, past=True)} AS more FROM base),
    b AS (SELECT *, CASE WHEN ret = 0 OR ret IS NULL OR more IS NULL THEN NULL WHEN ret > 0 AND NOT more THEN 'A' WHEN ret > 0 THEN 'B' WHEN NOT more THEN 'C' ELSE 'D' END AS vol_state FROM a)
    SELECT code, date, vol_state, """ + ", ".join(f"CASE WHEN count(vol_state) OVER {S.frame(n)} = {n} THEN count(CASE WHEN vol_state = '{s}' THEN 1 END) OVER {S.frame(n)} END AS st{s}{n}" for s in "ABCD" for n in (1, 5, 10, 20)) + " FROM b"))
def volume_structure(spark, sf):
    return I.volume_structure(base(spark, sf)).select("code", "date", "vol_state", *ST)


MS = ["dhist1", "dhist3", "dhist5", "hist_acc", "hist_z", "dhist1_z", "dhist3_z"]


@query("macd_scores", S.with_(ROUNDED, f""", a AS (SELECT *, {', '.join(f"hist - {S.lag('hist', k)} AS dhist{k}" for k in (1, 3, 5))} FROM q),
    b AS (SELECT *, dhist1 - {S.lag('dhist1')} AS hist_acc, {', '.join(f"{c} / nullif({S.rolling(f'stddev_samp({c})', c, 60)}, 0) AS {c}_z" for c in ('hist', 'dhist1', 'dhist3'))},
    {S.rolling("sum(CASE WHEN dhist1 > 0 THEN 1 WHEN dhist1 <= 0 THEN 0 END)", 'dhist1', 5)} AS hist_upstreak, {S.rolling('max(hist)', 'hist', 20)} AS top, {S.lag('hist')} AS before FROM a)
    SELECT code, date, {S.rounded(MS)}, hist_upstreak::BIGINT AS hist_upstreak, hist_upstreak >= 3 AS hist_up3, hist_upstreak >= 5 AS hist_up5, coalesce(hist < 0 AND dhist1 > 0 AND dhist3 > 0 AND dhist1_z < 1, false) AS st_slowimp,
    coalesce(hist > 0 AND before <= 0 AND dhist1_z > 1, false) AS st_fastflip, coalesce(hist > 0 AND dhist1 < 0 AND hist > 0.5 * top, false) AS st_decay FROM b"""))
def macd_scores(spark, sf):
    return out(I.macd_scores(rounded_macd(spark, sf)), "hist_upstreak", "hist_up3", "hist_up5", "st_slowimp", "st_fastflip", "st_decay", **same(MS))


@query("true_range_atr", S.with_(B, f""", a AS (SELECT *, CASE WHEN {S.lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')})) END AS tr FROM base),
    b AS (SELECT *, {S.mean('tr', 14)} AS atr14, {S.mean('tr', 20)} AS atr20, ({S.rolling('stddev_samp(ret)', 'ret', 20)}) * sqrt(252) AS hv20, ({S.rolling('stddev_samp(ret)', 'ret', 60)}) * sqrt(252) AS hv60 FROM a)
    SELECT code, date, {S.rounded(['tr', 'atr14', 'atr20', 'hv20', 'hv60'])}, round(atr14 / close, 6) AS atr_pct FROM b"""))
def true_range_atr(spark, sf):
    return out(I.ranges(base(spark, sf)), **same(["tr", "atr14", "atr20", "hv20", "hv60", "atr_pct"]))


def _limit_sql() -> str:
    r2 = lambda x: f"round_even(({x}) * 100, 0) / 100"
    hit = lambda x: f"CASE WHEN pb IS NOT NULL THEN CASE WHEN abs(high - {r2(f'pb * {1 + x!r}')}) <= 0.005 + 1e-5 * abs({r2(f'pb * {1 + x!r}')}) OR abs(low - {r2(f'pb * {1 - x!r}')}) <= 0.005 + 1e-5 * abs({r2(f'pb * {1 - x!r}')}) THEN 1 ELSE 0 END END"
    return S.with_(P, f""", a AS (SELECT *, {S.lag('close')} AS pb FROM panel), h AS (SELECT *, {', '.join(f"{hit(x)} AS h{i}" for i, x in enumerate(I.LIMITS))} FROM a),
    s AS (SELECT *, {', '.join(f"{S.rolling(f'sum(h{i})', f'h{i}', 120, 60)} AS s{i}" for i in range(4))} FROM h),
    l AS (SELECT *, CASE WHEN s0 IS NULL AND s1 IS NULL AND s2 IS NULL AND s3 IS NULL THEN CASE WHEN board = 'ASIA' THEN 0.2 ELSE 0.1 END ELSE CASE greatest(coalesce(s0, -1), coalesce(s1, -1), coalesce(s2, -1), coalesce(s3, -1)) WHEN s0 THEN 0.05 WHEN s1 THEN 0.1 WHEN s2 THEN 0.2 ELSE 0.3 END END::DOUBLE AS limit_pct FROM s)
    SELECT code, date, limit_pct, {r2('pb * (1 + limit_pct)')} AS limit_up_px, {r2('pb * (1 - limit_pct)')} AS limit_dn_px, coalesce(open < {r2('pb * (1 + limit_pct)')} - 1e-6, false) AS can_buy_open,
    coalesce(open > {r2('pb * (1 - limit_pct)')} + 1e-6, false) AS can_sell_open, {S.lead('close')} IS NOT NULL AS has_next_bar FROM l""")


@query("limit_regime", _limit_sql())
def limit_regime(spark, sf):
    made = I.limit_regime(panel(spark, sf), F.when(F.col("board") == "ASIA", 0.2).otherwise(0.1))
    return made.select("code", "date", "limit_pct", "limit_up_px", "limit_dn_px", "can_buy_open", "can_sell_open", "has_next_bar")


@query("first_sellable_open", S.with_(P, f"SELECT code, date, can_sell, round(first_value(CASE WHEN can_sell THEN open END IGNORE NULLS) OVER ({S.E_} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS sell_open FROM panel"))
def first_sellable_open(spark, sf):
    df = panel(spark, sf)
    return out(df, "can_sell", sell_open=I.first_sellable_open(df))


@query("last_valid_price", S.with_(P, "SELECT code, max(date) AS date, round(max_by(close, date), 6) AS price, round(max_by(close, date) FILTER (n = 2), 6) AS prev_price, round(max_by(close, date) / max_by(close, date) FILTER (n = 2) - 1, 6) AS change FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM panel) WHERE n <= 2 GROUP BY code"))
def last_valid_price(spark, sf):
    return I.last_two(panel(spark, sf)).select("code", "date", *(F.round(F.col(c) + S.NUDGE, 6).alias(c) for c in ("price", "prev_price", "change")))


@query("shift_rows", S.with_(B, f"SELECT code, date, round({S.lag('close', 3)}, 6) AS back3, round({S.lead('close', 2)}, 6) AS ahead2, round({S.lag('ret')}, 6) AS ret_before FROM base"))
def shift_rows(spark, sf):
    return out(base(spark, sf), back3=lag("close", 3), ahead2=lead("close", 2), ret_before=lag("ret"))
