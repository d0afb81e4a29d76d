"""Signals with conditions on momentum and on published reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entity, lag
from ..operators import asof as A
from ..operators import indicators as I
from . import query as Q
from . import sql as S
from .catalog_data import FIN, published
from .catalog_strategy import ROWS, prepared
from .catalog_windows import ROUNDED, P, rounded_macd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


def with_momentum(spark, sf) -> DataFrame:
    """The prepared rows with the mean of the row before and the indicator columns of the confirmations."""
    macd = I.macd_scores(rounded_macd(spark, sf)).select("code", "date", "dif", "dea", "hist", "hist_upstreak")
    return prepared(spark, sf).withColumn("ma5_prev", lag("ma5")).join(macd, ["code", "date"])


def with_reports(spark, sf) -> DataFrame:
    """The prepared rows with the latest report published by then, and how many of the last 20 closes lie below par (95 here)."""
    reports = A.with_annual(A.with_growth(published(spark, sf))).select("code", "publish_date", "report_end", "q", "rev", "np", "rev_yoy", "np_yoy", "ann_rev", "ann_np", "np_y1", "np_y2")
    w = entity().rowsBetween(-19, 0)
    below = F.when(F.count("close").over(w) >= 20, F.sum(F.when(F.col("close") < 95, 1).otherwise(0)).over(w)).otherwise(0)
    rows = prepared(spark, sf).select("code", "date", "board", "size_grp", "d_px_ma60_pct", "bull", below.alias("below_par"))
    return A.asof_join(rows, reports, "code", "date", "publish_date")


MOMENTUM = Q.Params(ranges={"ret20": (1, 8)}, size=(0, 9), market="any", confirm=("ma5up", "histpos", "difdea", "histup3"))


@query("signal_momentum", S.with_(ROWS + ROUNDED.removeprefix(P), f""", h AS (SELECT *, hist - {S.lag('hist')} AS step FROM q), h2 AS (SELECT code, date, dif, dea, hist, {S.rolling("sum(CASE WHEN step > 0 THEN 1 WHEN step <= 0 THEN 0 END)", 'step', 5)} AS rising FROM h),
    r2 AS (SELECT code, date, d_ret20, ma5, {S.lag('ma5')} AS before FROM rws)
    SELECT code, date FROM r2 JOIN h2 USING (code, date) WHERE d_ret20 BETWEEN 1 AND 8 AND ma5 > before AND hist > 0 AND dif > dea AND rising >= 3"""))
def signal_momentum(spark, sf):
    return with_momentum(spark, sf).where(Q.predicate(MOMENTUM)[0]).select("code", "date")


REPORTS = ROWS + ", " + FIN + f""", g AS (SELECT *, lag(rev) OVER s AS r0, lag(np) OVER s AS p0, year(report_end) - year(lag(report_end) OVER s) = 1 AS ok, CASE WHEN q = 4 THEN lag(np) OVER s END AS pv FROM pub WINDOW s AS (PARTITION BY code, q ORDER BY report_end)),
rep AS (SELECT code, publish_date, report_end, q, rev, np, CASE WHEN ok AND abs(r0) > 1 THEN (rev - r0) / abs(r0) END AS rev_yoy, CASE WHEN ok AND abs(p0) > 1 THEN (np - p0) / abs(p0) END AS np_yoy, rev * 4 / q AS ann_rev, np * 4 / q AS ann_np,
    last_value(CASE WHEN q = 4 THEN np END IGNORE NULLS) OVER t AS np_y1, last_value(pv IGNORE NULLS) OVER t AS np_y2 FROM g WINDOW t AS (PARTITION BY code ORDER BY report_end ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT code, date, board, size_grp, CASE WHEN count(close) OVER {S.frame(20)} >= 20 THEN sum(CASE WHEN close < 95 THEN 1 ELSE 0 END) OVER {S.frame(20)} ELSE 0 END AS below_par FROM rws),
fr AS (SELECT pr.*, rep.report_end, rep.q, rev, np, rev_yoy, np_yoy, ann_rev, ann_np, np_y1, np_y2 FROM pr ASOF LEFT JOIN rep ON pr.code = rep.code AND pr.date >= rep.publish_date)"""

GROWING = Q.Params(ranges={}, size=(0, 7), market="any", finance={"rev": (300_000, None), "np": (-40_000, 90_000), "rev_yoy": (-0.5, 3), "np_yoy": (None, 5)})


@query("signal_financial", S.with_(REPORTS, "SELECT code, date, report_end FROM fr WHERE size_grp BETWEEN 0 AND 7 AND rev >= 300000 AND np BETWEEN -40000 AND 90000 AND rev_yoy BETWEEN -0.5 AND 3 AND np_yoy <= 5"))
def signal_financial(spark, sf):
    return with_reports(spark, sf).where(Q.predicate(GROWING)[0]).select("code", "date", "report_end")


@query("signal_quarter", S.with_(REPORTS, "SELECT code, date, report_end FROM fr WHERE q = 3 AND size_grp BETWEEN 0 AND 2"))
def signal_quarter(spark, sf):
    return with_reports(spark, sf).where(Q.predicate(Q.Params(ranges={}, market="any", quarter=3))[0]).select("code", "date", "report_end")


#: The floors of this data: revenues are far below those that the default stands for.
SOUND = Q.Params(ranges={}, size=(0, 9), market="any", delist=("financial", "loss2y", "penny"), rev_floor=3e6, board_floors={"ASIA": 6e6}, penny_days=10)


@query("signal_without_risks", S.with_(REPORTS, "SELECT code, date FROM fr WHERE NOT coalesce(ann_np < 0 AND ann_rev < CASE WHEN board = 'ASIA' THEN 6e6 ELSE 3e6 END, false) AND NOT coalesce(np_y1 < 0 AND np_y2 < 0, false) AND NOT below_par >= 10"))
def signal_without_risks(spark, sf):
    return with_reports(spark, sf).where(Q.predicate(SOUND)[0]).select("code", "date")


DEEP_ANY = Q.Params(ranges={}, size=(0, 9), market="any", deep=True)


@query("signal_deep", S.with_(ROWS, "SELECT code, date FROM rws WHERE d_ret40 IS NOT NULL AND d_ret60 IS NOT NULL AND d_px_ma60_pct IS NOT NULL AND (d_ret40 = 1 OR d_ret60 = 1 OR d_px_ma60_pct = 1)"))
def signal_deep(spark, sf):
    return prepared(spark, sf).where(Q.predicate(DEEP_ANY)[0]).select("code", "date")
