"""Queries over sources, sets, disclosures, corporate actions and events, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import asof as A
from ..sources.panel import first_by, panel, session_date, table, union_latest
from ..streaming import incremental as I
from . import query as Q
from . import sql as S
from .catalog_cross import r6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = S.nudged(oracle)
        return f

    return add


@query("union_dedupe_latest", S.with_(S.PANEL, """, u AS (SELECT 0 AS p, code, date, volume, turnover FROM panel UNION ALL SELECT 1, code, date, volume + 1, turnover FROM panel WHERE code % 2 = 0 UNION ALL SELECT 2, code, date, volume + 2, NULL FROM panel WHERE date >= DATE '2000-01-01' AND code % 5 = 0)
    SELECT code, date, volume, turnover FROM u QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY p DESC) = 1"""))
def union_dedupe_latest(spark, sf):
    p = panel(spark, sf).select("code", "date", "volume", "turnover")
    b = p.where("code % 2 = 0").withColumn("volume", F.col("volume") + 1)
    c = p.where("date >= DATE '2000-01-01' AND code % 5 = 0").select("code", "date", (F.col("volume") + 2).alias("volume"))
    return union_latest([p, b, c], ["code", "date"], ["volume"]).select("code", "date", "volume", "turnover")


@query("dedupe_first", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, sf):
    return first_by(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("set_operations", "SELECT 'both' AS kind, n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'unclaimed', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_operations(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    both = n.intersect(s.select("s_nationkey")).intersect(c.select("c_nationkey")).select(F.lit("both").alias("kind"), "k")
    return both.unionByName(n.exceptAll(s.where("s_acctbal > 5000").select("s_nationkey").distinct()).select(F.lit("unclaimed").alias("kind"), "k"))


_CODE = "lpad(((c_custkey * 7919 + 300000) % 700000)::VARCHAR, 6, '0') || CASE c_custkey % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END"


@query("board_rules", f"""WITH c AS (SELECT c_custkey, {_CODE} AS code, CASE WHEN c_custkey % 7 = 0 THEN 'star' WHEN c_custkey % 7 = 1 THEN '主板' WHEN c_custkey % 7 = 2 THEN '' END AS named, CASE WHEN c_custkey % 4 = 0 THEN 'SZ' WHEN c_custkey % 4 = 1 THEN '' END AS exch FROM customer),
    b AS (SELECT *, CASE WHEN code LIKE '%.BJ' THEN 'BJ' WHEN code[1:3] IN ('688', '689') THEN 'STAR' WHEN code[1:3] IN ('300', '301') THEN 'CHINEXT' ELSE 'MAIN' END AS by_code FROM c)
    SELECT c_custkey, code, by_code, CASE WHEN upper(named) = 'STAR' THEN 'STAR' WHEN named = '主板' THEN 'MAIN' ELSE by_code END AS board, coalesce(nullif(exch, ''), CASE WHEN code LIKE '%.SH' THEN 'SH' WHEN code LIKE '%.BJ' THEN 'BJ' ELSE 'SZ' END) AS exchange,
    CASE WHEN by_code = 'BJ' THEN 0.3 WHEN by_code IN ('STAR', 'CHINEXT') THEN 0.2 ELSE 0.1 END::DOUBLE AS limit_pct, regexp_extract(upper(trim(code)), '\\d{{6}}') AS digits FROM b""".replace("{{6}}", "{6}"))
def board_rules(spark, sf):
    k = F.col("c_custkey")
    code = F.concat(F.lpad(((k * 7919 + 300000) % 700000).cast("string"), 6, "0"), F.when(k % 3 == 0, ".SH").when(k % 3 == 1, ".SZ").otherwise(".BJ"))
    named = F.when(k % 7 == 0, "star").when(k % 7 == 1, "主板").when(k % 7 == 2, "")
    exch = F.when(k % 4 == 0, "SZ").when(k % 4 == 1, "")
    c = table(spark, sf, "customer").select("c_custkey", code.alias("code"), named.alias("named"), exch.alias("exch"))
    by_code = Q.board_of(F.col("code"))
    return c.select("c_custkey", "code", by_code.alias("by_code"), Q.board_or_default(F.col("named"), F.col("code")).alias("board"), Q.exchange_of(F.col("exch"), F.col("code")).alias("exchange"), Q.default_limit(by_code).alias("limit_pct"), Q.six_digits(F.col("code")).alias("digits"))


@query("epoch_dates", "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events")
def epoch_dates(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ev.select("event_id", session_date("ms").alias("day"))


@query("digitise_bins", "SELECT event_id, CASE WHEN v < -1 THEN 0 WHEN v < 0 THEN 1 WHEN v < 1 THEN 2 WHEN v < 2 THEN 3 WHEN v IS NOT NULL THEN 4 END AS bin FROM (SELECT event_id, (value - 20) / 10 AS v FROM events)")
def digitise_bins(spark, sf):
    return table(spark, sf, "events").select("event_id", Q.digitise((F.col("value") - 20) / 10).alias("bin"))


@query("json_fields", "SELECT event_type, count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total, max((props::JSON ->> 'k')::BIGINT) AS top FROM events GROUP BY event_type")
def json_fields(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("dataset_meta", S.with_(S.PANEL, "SELECT board, ind_code, count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT date) AS days, min(date) AS first, max(date) AS last FROM panel GROUP BY GROUPING SETS ((board, ind_code), (board), ())"))
def dataset_meta(spark, sf):
    """Counts by member, by group, and over all."""
    return panel(spark, sf).rollup("board", "ind_code").agg(F.count("*").alias("rows"), F.countDistinct("code").alias("codes"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


# ---- disclosures ------------------------------------------------------------------------------------------------------

_Q = "SELECT l_suppkey AS code, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(l_extendedprice * (1 - l_discount)) AS r, sum(l_extendedprice * (0.052 - l_discount)) AS p FROM lineitem GROUP BY ALL"
FIN = f"qs AS ({_Q}), fin AS MATERIALIZED (SELECT code, last_day(make_date(y, q * 3, 1)) AS report_end, q::INTEGER AS q, round(sum(r) OVER w, 2) AS rev, round(sum(p) OVER w, 2) AS np FROM qs WINDOW w AS (PARTITION BY code, y ORDER BY q ROWS UNBOUNDED PRECEDING)), pub AS MATERIALIZED (SELECT *, CAST(report_end + (30 + code % 45)::INTEGER AS DATE) AS publish_date FROM fin)"


def fin(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    qs = li.groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.sum(F.col("l_extendedprice") * (0.052 - F.col("l_discount"))).alias("p"))
    w = Window.partitionBy("code", "y").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return qs.select("code", F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("report_end"), "q", F.round(F.sum("r").over(w), 2).alias("rev"), F.round(F.sum("p").over(w), 2).alias("np"))


def published(spark, sf):
    return fin(spark, sf).withColumn("publish_date", F.date_add("report_end", (30 + F.col("code") % 45).cast("int")))


@query("fin_yoy", S.with_(FIN, ", g AS (SELECT *, lag(rev) OVER w AS r0, lag(np) OVER w AS p0, year(report_end) - year(lag(report_end) OVER w) = 1 AS ok FROM fin WINDOW w AS (PARTITION BY code, q ORDER BY report_end)) SELECT code, report_end, q, rev, np, round(CASE WHEN ok AND abs(r0) > 1 THEN (rev - r0) / abs(r0) END, 6) AS rev_yoy, round(CASE WHEN ok AND abs(p0) > 1 THEN (np - p0) / abs(p0) END, 6) AS np_yoy, round(rev * 4 / q, 6) AS ann_rev FROM g"))
def fin_yoy(spark, sf):
    return A.with_growth(fin(spark, sf)).select("code", "report_end", "q", "rev", "np", *r6("rev_yoy", "np_yoy", "ann_rev"))


@query("publish_fallback", S.with_(FIN, """, a AS (SELECT code, report_end, CASE WHEN code % 11 = 0 THEN CAST(report_end - 5 AS DATE) ELSE CAST(report_end + 20 AS DATE) END AS p FROM fin WHERE code % 3 <> 0)
    SELECT fin.code, fin.report_end, CASE WHEN p >= fin.report_end THEN p ELSE CASE month(fin.report_end) WHEN 3 THEN make_date(year(fin.report_end), 4, 30) WHEN 6 THEN make_date(year(fin.report_end), 8, 31) WHEN 9 THEN make_date(year(fin.report_end), 10, 31) ELSE make_date(year(fin.report_end) + 1, 4, 30) END END AS publish_date, CASE WHEN p >= fin.report_end THEN 'actual' ELSE 'legal' END AS src FROM fin LEFT JOIN a ON a.code = fin.code AND a.report_end = fin.report_end"""))
def publish_fallback(spark, sf):
    rows = fin(spark, sf)
    announced = rows.where("code % 3 <> 0").select("code", "report_end", F.when(F.col("code") % 11 == 0, F.date_sub("report_end", 5)).otherwise(F.date_add("report_end", 20)).alias("publish_date"))
    return A.with_publish(rows, announced).select("code", "report_end", "publish_date", "src")


@query("asof_financials", S.with_(S.PANEL + ", " + FIN, "SELECT panel.code, panel.date, pub.report_end, pub.q, pub.rev, pub.np FROM panel ASOF LEFT JOIN pub ON panel.code = pub.code AND panel.date >= pub.publish_date"))
def asof_financials(spark, sf):
    return A.asof_join(panel(spark, sf).select("code", "date"), published(spark, sf), "code", "date", "publish_date").select("code", "date", "report_end", "q", "rev", "np")


@query("annual_losses", S.with_(FIN, """, b AS (SELECT *, CASE WHEN q = 4 THEN lag(np) OVER (PARTITION BY code, q ORDER BY report_end) END AS pv FROM fin), y AS (SELECT *, last_value(CASE WHEN q = 4 THEN np END IGNORE NULLS) OVER w AS np_y1, last_value(pv IGNORE NULLS) OVER w AS np_y2 FROM b WINDOW w AS (PARTITION BY code ORDER BY report_end ROWS UNBOUNDED PRECEDING))
    SELECT code, report_end, np_y1, np_y2, coalesce(np_y1 < 0 AND np_y2 < 0, false) AS two_losses, coalesce(np * 4 / q < 0 AND rev * 4 / q < 1e7, false) AS at_risk FROM y"""))
def annual_losses(spark, sf):
    out = A.with_annual(A.with_growth(fin(spark, sf)))
    return out.select("code", "report_end", "np_y1", "np_y2", "two_losses", F.coalesce((F.col("ann_np") < 0) & (F.col("ann_rev") < 1e7), F.lit(False)).alias("at_risk"))


ACT = "act AS (SELECT code, CAST(report_end + (10 + code % 20)::INTEGER AS DATE) AS ex_date, (code % 7) * 0.1::DOUBLE AS dividend, CASE WHEN q = 2 THEN 0.1 ELSE 0 END::DOUBLE AS bonus, CASE WHEN q = 3 THEN 0.05 ELSE 0 END::DOUBLE AS allotment, 50.0::DOUBLE AS allotment_px FROM fin)"


@query("adjusted_prices", S.with_(S.PANEL + ", " + FIN + ", " + ACT, """, e AS (SELECT act.*, p.close FROM act ASOF JOIN panel p ON act.code = p.code AND act.ex_date > p.date), f AS (SELECT code, ex_date, (close - dividend + allotment * allotment_px) / (close * (1 + bonus + allotment)) AS ratio FROM e WHERE ex_date <= (SELECT max(date) FROM panel x WHERE x.code = e.code)),
    g AS (SELECT p.code, p.date, any_value(p.close) AS close, any_value(p.volume) AS volume, coalesce(product(ratio), 1) AS adj_factor FROM panel p LEFT JOIN f ON f.code = p.code AND f.ex_date > p.date AND ratio > 0 AND ratio < 5 GROUP BY ALL) SELECT code, date, round(adj_factor, 6) AS adj_factor, round(close * adj_factor, 6) AS close, round(volume / adj_factor, 6) AS volume FROM g"""))
def adjusted_prices(spark, sf):
    bars = panel(spark, sf)
    q = F.col("q")
    actions = fin(spark, sf).select("code", F.date_add("report_end", (10 + F.col("code") % 20).cast("int")).alias("ex_date"), ((F.col("code") % 7) * 0.1).alias("dividend"), F.when(q == 2, 0.1).otherwise(0.0).alias("bonus"), F.when(q == 3, 0.05).otherwise(0.0).alias("allotment"), F.lit(50.0).alias("allotment_px"))
    return A.adjusted(bars, A.action_ratios(actions, bars)).select("code", "date", *r6("adj_factor", "close", "volume"))


# ---- events ------------------------------------------------------------------------------------------------------------


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_TUMBLE = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@query("event_windows_tumbling", _TUMBLE)
def event_windows_tumbling(spark, sf):
    return I.tumbling(events(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", *r6("total"))


@query("event_windows_sliding", "SELECT b - INTERVAL 2 HOUR * k AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') AS b FROM events) CROSS JOIN range(0, 3) t(k) GROUP BY ALL")
def event_windows_sliding(spark, sf):
    return I.sliding(events(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("event_sessions", "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def event_sessions(spark, sf):
    return I.sessions(events(spark, sf)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("events_dedupe", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def events_dedupe(spark, sf):
    return I.first_events(events(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("high_water_marks", S.with_(S.PANEL, ", m AS (SELECT code, max(date) AS mark FROM panel WHERE date < DATE '2000-06-01' AND code % 10 <> 3 GROUP BY code) SELECT panel.code, count(*) AS n, min(date) AS first FROM panel LEFT JOIN m USING (code) WHERE mark IS NULL OR date >= mark GROUP BY panel.code"))
def high_water_marks(spark, sf):
    p = panel(spark, sf)
    marks = I.high_water(p.where("date < DATE '2000-06-01' AND code % 10 <> 3"), "code", "date")
    return I.newer(p, marks, "code", "date").groupBy("code").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("incremental_merge", S.with_(S.PANEL, ", o AS (SELECT code, date, volume FROM panel WHERE date < DATE '2000-06-01'), n AS (SELECT code, date, volume * 2 AS volume FROM panel WHERE date >= DATE '2000-05-01') SELECT code, date, coalesce(n.volume, o.volume) AS volume FROM o FULL JOIN n USING (code, date)"))
def incremental_merge(spark, sf):
    p = panel(spark, sf).select("code", "date", "volume")
    new = p.where("date >= DATE '2000-05-01'").withColumn("volume", F.col("volume") * 2)
    once = I.merge(p.where("date < DATE '2000-06-01'"), new, ["code", "date"], ["volume"])
    return I.merge(once, new, ["code", "date"], ["volume"]).select("code", "date", "volume")


@query("stream_tumbling", _TUMBLE)
def stream_tumbling(spark, sf):
    """The hourly windows from a stream: each micro-batch hands over the windows that it changed, and the latest of each stays."""
    at = tempfile.mkdtemp(prefix="tessera-stream-") if spark.sparkContext.master.startswith("local[") else spark.sparkContext.getConf().get("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir"))
    at = f"{at}/tumbling-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    source = I.late_tolerant(I.read_events(spark, sf, table(spark, sf, "events").schema))
    I.run_once(I.tumbling(source), lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint")
    out = spark.read.parquet(f"{at}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "v.n", *r6(total=F.col("v.total")))
