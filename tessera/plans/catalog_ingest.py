"""Queries on stops as portfolios, recomputing what changed, versions, reused stages, mixed series, group trees and free-text pools, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bins, lag, rank_pct, ratio, rolling
from ..operators import capacity as K
from ..operators import simulate as D
from ..operators import stops as T
from ..sources import files as W
from ..sources import versions as V
from ..sources.panel import panel, table
from ..streaming import incremental as I
from . import query as Q
from . import sql as S
from .catalog_cross import r6
from .catalog_strategy import HOLD, ROWS, _days, prepared

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = S.nudged(oracle)
        return f

    return add


def _folder(spark, label: str) -> str:
    return f"{W.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# ---- stops as portfolios ------------------------------------------------------------------------------------------------

STOPS = [("none", 9.0), *((k, v) for k in ("close", "intraday") for v in (0.02, 0.05, 0.08, 0.1, 0.15))]

STOPPED = ROWS + f""", ks(kind, level) AS (SELECT 'none', 9.0::DOUBLE UNION ALL SELECT * FROM (SELECT unnest(['close', 'intraday'])) a CROSS JOIN (SELECT unnest([0.02, 0.05, 0.08, 0.1, 0.15])::DOUBLE) b),
    e AS MATERIALIZED (SELECT sg.code, sg.row, sg.day, sg.r, x.open AS entry FROM sg JOIN rws x ON x.code = sg.code AND x.row = sg.row + 1 WHERE sg.r IS NOT NULL),
    b AS MATERIALIZED (SELECT e.code, e.row, e.day, entry, j, y.open, y.low, y.close, y.so, o.oret_sig AS ret FROM e JOIN range(0, {HOLD}) t(j) ON true JOIN rws y ON y.code = e.code AND y.row = e.row + 1 + j JOIN rws o ON o.code = e.code AND o.row = e.row + j),
    h AS (SELECT kind, level, code, row, min(j) AS hit FROM b JOIN ks ON (kind = 'close' AND close <= entry * (1 - level) * (1 + 1e-9)) OR (kind = 'intraday' AND least(open, low) <= entry * (1 - level) * (1 + 1e-9)) GROUP BY ALL),
    m AS MATERIALIZED (SELECT kind, level, e.*, hit, CASE WHEN kind = 'close' THEN coalesce(hit + 1, {HOLD}) ELSE coalesce(hit, {HOLD}) END AS m FROM e CROSS JOIN ks LEFT JOIN h USING (kind, level, code, row)),
    x AS MATERIALIZED (SELECT m.*, z.so, CASE WHEN z.open <= z.entry * (1 - level) * (1 + 1e-9) THEN z.open ELSE z.entry * (1 - level) END AS fill, z.open AS zopen FROM m LEFT JOIN b z ON z.code = m.code AND z.row = m.row AND z.j = m.m)"""
_FILLED = f"CASE WHEN m = {HOLD} THEN r WHEN kind = 'close' THEN so / entry - 1 ELSE fill / entry - 1 END"


@query("stop_trades", S.with_(STOPPED, f", n AS (SELECT kind, level, hit, {_FILLED} - 0.003 AS net FROM x) SELECT kind, level, count(*) AS n_trade, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS stopped, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0.0 END), 6) AS win, round(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0), 6) AS pf FROM n GROUP BY kind, level"))
def stop_trades(spark, sf):
    """Settled positions under each stop: how many it ended, and what they earned."""
    cells = T.stop_cells(prepared(spark, sf), HOLD, STOPS)
    return T.stop_trades(cells, STOPS).select("kind", "level", "n_trade", *r6("stopped", "mean", "win", "pf"))


@query("stop_portfolio", S.with_(STOPPED, f""", sl AS (SELECT kind, level, b.day + b.j AS day, ret FROM m JOIN b USING (code, row) WHERE b.j < m AND ret IS NOT NULL UNION ALL SELECT kind, level, day + hit, fill / zopen - 1 FROM x WHERE kind = 'intraday' AND hit IS NOT NULL),
    d AS (SELECT kind, level, day, sum(ret - 0.003 / {HOLD}) AS s, count(*) AS n FROM sl GROUP BY ALL), a AS (SELECT day + j AS day, count(ret) AS every FROM b GROUP BY 1),
    p AS (SELECT kind, level, cal.day, coalesce(n, 0) AS n, coalesce(s / n, 0) AS ret, coalesce(s / every, 0) AS fixed FROM cal CROSS JOIN ks LEFT JOIN d USING (kind, level, day) LEFT JOIN a ON a.day = cal.day),
    v AS (SELECT *, product(1 + ret) OVER w AS nav, product(1 + fixed) OVER w AS nav2 FROM p WINDOW w AS (PARTITION BY kind, level ORDER BY day ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, nav / greatest(max(nav) OVER w, 1) - 1 AS fall, nav2 / greatest(max(nav2) OVER w, 1) - 1 AS fall2 FROM v WINDOW w AS (PARTITION BY kind, level ORDER BY day ROWS UNBOUNDED PRECEDING))
    SELECT kind, level, round(max_by(nav, day) ** (252.0 / count(*)) - 1, 6) AS cagr, round(min(fall), 6) AS mdd, round(avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0), 6) AS sharpe, round(max_by(nav2, day) ** (252.0 / count(*)) - 1, 6) AS cagr_fixed, round(min(fall2), 6) AS mdd_fixed, round(avg(fixed) * sqrt(252) / nullif(stddev_samp(fixed), 0), 6) AS sharpe_fixed, round(coalesce(avg(n) FILTER (n > 0), 0), 6) AS avg_pos FROM f GROUP BY kind, level"""))
def stop_portfolio(spark, sf):
    """The daily portfolio of positions with ragged ends: over those still open, and over all that a full holding time would keep."""
    cells = T.stop_cells(prepared(spark, sf), HOLD, STOPS)
    daily = W.staged(T.stop_daily(cells, _days(spark, sf), HOLD, STOPS), "stop-daily")
    by = ["kind", "level"]
    stats = lambda c: D.annual_stats(K.with_value(daily.withColumn("ret", F.col(c)), "ret", by), by)
    fixed = stats("fixed").select(*by, F.col("cagr").alias("cagr_fixed"), F.col("mdd").alias("mdd_fixed"), F.col("sharpe").alias("sharpe_fixed"))
    held = daily.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(0.0)).alias("avg_pos"))
    return stats("ret").join(fixed, by).join(held, by).select(*by, *r6("cagr", "mdd", "sharpe", "cagr_fixed", "mdd_fixed", "sharpe_fixed", "avg_pos"))


# ---- recomputing what changed -----------------------------------------------------------------------------------------------

DEPTH = 60


def along(df: DataFrame) -> DataFrame:
    return df.withColumns({"ret20": F.round(ratio("close", lag("close", 20)) - 1, 9), "px_ma60_pct": F.round(ratio("close", rolling(F.avg, "close", DEPTH)) - 1, 9)})


def across(df: DataFrame) -> DataFrame:
    return df.withColumn("decile", bins(rank_pct("px_ma60_pct", ["date"])))


def _update(spark, sf) -> tuple[str, DataFrame, DataFrame]:
    """A table of features up to a day, the bars as they are later, and what changed: new bars, and a month of some entities once more."""
    bars = panel(spark, sf).select("code", "date", F.round("close", 9).alias("close"))
    old = bars.where("date < DATE '2000-06-01'")
    late = bars.where("code % 10 = 3 AND date >= DATE '1998-03-01' AND date < DATE '1998-04-01'").withColumn("close", F.round(F.col("close") * 1.01, 9))
    changed = W.staged(bars.where("date >= DATE '2000-06-01'").unionByName(late), "changed-bars")
    root = _folder(spark, "features")
    I.write_periods(across(along(old)), root)
    return root, W.staged(I.merge(old, changed, ["code", "date"], ["close"]), "merged-bars"), changed


_UPDATED = S.PANEL + """, bars AS (SELECT code, date, round(close * CASE WHEN code % 10 = 3 AND date >= DATE '1998-03-01' AND date < DATE '1998-04-01' THEN 1.01 ELSE 1 END, 9) AS close FROM (SELECT code, date, round(close, 9) AS close FROM panel))"""


@query("recompute_changed", S.with_(_UPDATED, f""", f AS (SELECT code, date, close, round(close / {S.lag('close', 20)} - 1, 9) AS ret20, round(close / {S.mean('close', 60)} - 1, 9) AS px_ma60_pct FROM bars)
    SELECT code, date, round(close, 6) AS close, round(ret20, 6) + 0.0::DOUBLE AS ret20, round(px_ma60_pct, 6) + 0.0::DOUBLE AS px_ma60_pct, {S.decile(S.rank_pct('px_ma60_pct'))} AS decile FROM f"""))
def recompute_changed(spark, sf):
    """Features after an update, of which only what the changed bars reach was worked out again and written; the same as all of it anew."""
    root, bars, changed = _update(spark, sf)
    I.recompute(root, bars, changed.select("code", "date"), DEPTH, along, across)
    return I.read_periods(spark, root).select("code", "date", *r6("close", "ret20", "px_ma60_pct"), "decile")


@query("recompute_touched", S.with_(_UPDATED, """, nr AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS row FROM bars), ch AS (SELECT code, date FROM bars WHERE date >= DATE '2000-06-01' OR (code % 10 = 3 AND date >= DATE '1998-03-01' AND date < DATE '1998-04-01')),
    rg AS (SELECT nr.code, min(row) AS lo, max(row) AS hi FROM nr JOIN ch USING (code, date) GROUP BY nr.code), up AS (SELECT nr.code, nr.date FROM nr JOIN rg ON rg.code = nr.code AND row BETWEEN lo AND hi + 60), mo AS (SELECT DISTINCT date_trunc('month', date) AS m FROM up)
    SELECT (SELECT count(*) FROM bars) AS n_rows, (SELECT count(*) FROM nr JOIN rg ON rg.code = nr.code AND row BETWEEN lo - 60 AND hi + 60) AS n_read, (SELECT count(*) FROM up) AS n_along, (SELECT count(*) FROM bars WHERE date IN (SELECT date FROM up)) AS n_across, (SELECT count(*) FROM mo) AS n_months, (SELECT count(DISTINCT date_trunc('month', date)) FROM bars) AS of_months"""))
def recompute_touched(spark, sf):
    """How many rows the update read, worked out along time and across periods, and how many months it wrote, of how many."""
    root, bars, changed = _update(spark, sf)
    return I.recompute(root, bars, changed.select("code", "date"), DEPTH, along, across)


# ---- versions and stages ----------------------------------------------------------------------------------------------------


@query("published_versions", S.with_(S.PANEL, "SELECT code, count(*) AS n, round(sum(volume), 6) AS volume FROM panel WHERE date < DATE '2000-06-01' GROUP BY code"))
def published_versions(spark, sf):
    """What a reader finds after two versions, a torn write between them and another behind: the second version, whole."""
    df = panel(spark, sf).select("code", "date", "volume")
    root = _folder(spark, "published")
    V.publish(df.where("date < DATE '1998-01-01'"), root)
    torn = lambda: df.where("code % 2 = 0").write.parquet(f"{root}/version={uuid.uuid4().hex}")  # noqa: E731  (files without a line in the manifest)
    torn()
    V.publish(df.where("date < DATE '2000-06-01'"), root, keep=1)
    torn()
    return V.current(spark, root).groupBy("code").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).select("code", "n", *r6("volume"))


@query("reused_stage", "WITH s AS (SELECT s_nationkey AS nation, s_acctbal AS x, s_suppkey % 2 = 0 AS first FROM supplier), a AS (SELECT nation, count(*) AS n, sum(x) AS total FROM s WHERE first GROUP BY nation), b AS (SELECT nation, count(*) AS n, sum(x) AS total FROM s GROUP BY nation) SELECT 1 AS call, 1 AS built, nation, n, round(total, 6) AS total FROM a UNION ALL SELECT 2, 1, nation, n, round(total, 6) FROM a UNION ALL SELECT 3, 2, nation, n, round(total, 6) FROM b")
def reused_stage(spark, sf):
    """A stage that is read again while its source stays the same, and built anew when a file is added: what three calls give, and how often it had been built."""
    source, label = _folder(spark, "source"), f"reused-{uuid.uuid4().hex}"
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x"), "s_suppkey")
    built, out = 0, None

    def build() -> DataFrame:
        nonlocal built
        built += 1
        return spark.read.parquet(source).groupBy("nation").agg(F.count("*").alias("n"), F.sum("x").alias("total"))

    for call in (1, 2, 3):
        if call != 2:
            rows.where(F.col("s_suppkey") % 2 == call // 2).write.mode("append").parquet(source)
        got = V.reused(spark, [source], label, build)
        got = got.select(F.lit(call).alias("call"), F.lit(built).alias("built"), "nation", "n", *r6("total"))
        out = got if out is None else out.unionByName(got)
    return out


# ---- series, trees, pools -----------------------------------------------------------------------------------------------------

_SERIES = S.PANEL + ", ix AS (SELECT ind_code, date, round(avg(close), 4) AS close, row_number() OVER (PARTITION BY ind_code ORDER BY date) AS k FROM panel GROUP BY ind_code, date)"


@query("mixed_series", S.with_(_SERIES, "SELECT ind_code AS series, date, round(CASE WHEN k = 1 THEN close + 1 ELSE close END, 6) AS close FROM ix"))
def mixed_series(spark, sf):
    """Index series from files of mixed shape (objects or positions, milliseconds or dates, a day twice), read as VARIANT; of repeated days the last stays."""
    each = panel(spark, sf).groupBy("ind_code", "date").agg(F.round(F.avg("close"), 4).alias("close"))
    first = each.groupBy("ind_code").agg(F.min("date").alias("date"), (F.min_by("close", "date") + 1).alias("close"))
    seq = each.withColumn("again", F.lit(0)).unionByName(first.withColumn("again", F.lit(1)))
    ms, close = F.unix_millis(F.col("date").cast("timestamp")), F.col("close")
    bar = F.when(F.col("ind_code") % 4 == 0, F.to_json(F.struct(ms.alias("date_ms"), close.alias("close_price")))).when(F.col("ind_code") % 4 == 1, F.to_json(F.struct(F.col("date").cast("string").alias("date"), close.alias("close"))))
    bar = bar.when(F.col("ind_code") % 4 == 2, F.format_string("[%d, 0, 0, 0, %s]", ms, close.cast("string"))).otherwise(F.format_string('["%s", 0, 0, 0, %s]', F.col("date").cast("string"), close.cast("string")))
    bars = F.transform(F.array_sort(F.collect_list(F.struct("again", "date", bar.alias("bar")))), lambda x: x["bar"])
    lists = seq.groupBy("ind_code").agg(F.concat(F.lit('{"series": '), F.col("ind_code").cast("string"), F.lit(', "klines": ['), F.array_join(bars, ","), F.lit("]}")).alias("value"))
    path = _folder(spark, "series")
    lists.select("value").write.text(path)
    return W.read_mixed_series(spark, path).select("series", "date", *r6("close"))


_TREE = S.PANEL + """, cl AS (SELECT ind_name, code, date FROM panel), have AS (SELECT ind_name, count(DISTINCT code) FILTER (date = (SELECT max(date) FROM panel)) AS n FROM cl GROUP BY ind_name),
    gs AS (SELECT r_regionkey AS code, r_name AS name, n_name AS sub FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 2 AND r_regionkey < 4)"""


@query("industry_tree", S.with_(_TREE, """SELECT 'group' AS kind, code, name, count(*) AS n_sub, sum(n)::BIGINT AS n_stock, string_agg(sub, ',' ORDER BY sub) AS subs FROM gs JOIN have ON ind_name = sub GROUP BY code, name
    UNION ALL SELECT 'unlisted', NULL, ind_name, 1, n, ind_name FROM have WHERE ind_name NOT IN (SELECT sub FROM gs) UNION ALL SELECT 'absent', r_regionkey, r_name, 0, 0, NULL FROM region WHERE r_regionkey = 4"""))
def industry_tree(spark, sf):
    """The panel's industries under the groups of a nested file: members that the panel has, industries that no group claims, groups without any, and counts of the last day."""
    nations = table(spark, sf, "nation").where("n_nationkey % 5 <> 2").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("subs"))
    regions = table(spark, sf, "region").withColumn("last", F.col("r_regionkey") == 4)
    groups = regions.where("NOT last").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.struct(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.concat("subs", F.array(F.lit("not in the panel"))).alias("subs")).alias("x"))
    empty = F.struct(F.lit(99).cast("int").alias("code"), F.lit("nothing here").alias("name"), F.array(F.lit("not there")).alias("subs"))
    tree = groups.agg(F.collect_list("x").alias("groups")).crossJoin(regions.where("last").agg(F.collect_list(F.struct(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("no members").alias("why"))).alias("absent")))  # one row each
    path = _folder(spark, "tree")
    tree.select(F.to_json(F.struct(F.concat("groups", F.array(empty)).alias("groups"), "absent")).alias("value")).write.text(path)
    return W.grouped_members(W.read_tree(spark, path), panel(spark, sf), "ind_name").select("kind", "code", "name", "n_sub", "n_stock", "subs")


_POOL = S.PANEL + """, px AS (SELECT *, lpad(code::VARCHAR, 6, '0') || CASE WHEN code % 2 = 0 THEN '.SZ' ELSE '.SH' END AS thscode FROM panel),
    tx AS (SELECT s_suppkey, unnest(regexp_split_to_array(upper(lpad(s_suppkey::VARCHAR, 6, '0') || ' ,' || lpad((s_suppkey + 1)::VARCHAR, 6, '0') || '.sz，none'), '[\\s,，;；]+')) AS w FROM supplier WHERE s_suppkey % 7 = 0),
    cs AS (SELECT DISTINCT unnest(CASE WHEN regexp_full_match(w, '\\d{6}') THEN [w, w || '.SH', w || '.SZ'] ELSE [w] END) AS c FROM tx WHERE w <> '')"""


@query("pool_free_text", S.with_(_POOL, "SELECT thscode, count(*) AS n, round(avg(close), 6) AS mean FROM px WHERE thscode IN (SELECT c FROM cs) GROUP BY thscode"))
def pool_free_text(spark, sf):
    """Rows of a pool that is written as free text: words cut and bare digits expanded as a table, then a semi join."""
    suffix = F.when(F.col("code") % 2 == 0, ".SZ").otherwise(".SH")
    df = panel(spark, sf).withColumn("thscode", F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), suffix))
    digits = lambda c: F.lpad(c.cast("string"), 6, "0")
    texts = table(spark, sf, "supplier").where("s_suppkey % 7 = 0").select(F.concat(digits(F.col("s_suppkey")), F.lit(" ,"), digits(F.col("s_suppkey") + 1), F.lit(".sz，none")).alias("text"))
    return Q.in_text_pool(df, texts, "thscode").groupBy("thscode").agg(F.count("*").alias("n"), F.avg("close").alias("mean")).select("thscode", "n", *r6("mean"))


# ---- dimension files and sinks --------------------------------------------------------------------------------------------------


@query("dimension_files", S.with_(S.PANEL, """, t AS (SELECT s_suppkey AS code, lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.SZ' ELSE '.SH' END AS thscode, s_name AS name, s_suppkey % 2 = 0 AS wrapped, s_suppkey % 5 = 0 AS missing, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT thscode, name, CASE WHEN wrapped THEN 'SZ' ELSE 'SH' END AS exchange, CASE WHEN NOT missing THEN n_name END AS ind_name, count(panel.code) AS n FROM t LEFT JOIN panel ON panel.code = t.code GROUP BY ALL"""))
def dimension_files(spark, sf):
    """Tickers from a plain and from a wrapped JSON list, and their industries from a JSON map in which some are missing, beside the panel's rows."""
    key = F.col("s_suppkey")
    thscode = F.concat(F.lpad(key.cast("string"), 6, "0"), F.when(key % 2 == 0, ".SZ").otherwise(".SH"))
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("thscode", thscode)
    item = F.collect_list(F.struct("thscode", F.col("s_name").alias("name"), F.lit(None).cast("string").alias("list_date"), F.substring("thscode", 8, 2).alias("exchange")))
    at = _folder(spark, "dimension")
    # one file each, as the readers take them: a dimension, not the data
    rows.where(key % 2 == 1).agg(F.to_json(item).alias("value")).write.text(f"{at}/list")
    rows.where(key % 2 == 0).agg(F.to_json(F.struct(F.struct(item.alias("item")).alias("data"))).alias("value")).write.text(f"{at}/wrapped")
    pairs = F.map_from_entries(F.collect_list(F.struct("thscode", F.struct(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")))))
    rows.where(key % 5 != 0).agg(F.to_json(pairs).alias("value")).write.text(f"{at}/map")
    tickers = W.read_tickers(spark, f"{at}/list").unionByName(W.read_tickers(spark, f"{at}/wrapped"))
    counts = panel(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    out = tickers.join(W.read_code_map(spark, f"{at}/map"), "thscode", "left").withColumn("code", F.substring("thscode", 1, 6).cast("long")).join(counts, "code", "left")
    return out.select("thscode", "name", "exchange", "ind_name", F.coalesce("n", F.lit(0)).alias("n"))


_SUNK = "SELECT '{0}' AS sink, count(*) AS n, count(ret) AS known, round(sum(close), 4) AS total, count(DISTINCT code) AS codes FROM w"


@query("sinks", S.with_(S.CLEAN, ", w AS (SELECT code, date, round(close, 6) AS close, CASE WHEN code % 3 <> 0 THEN round(ret, 9) END AS ret FROM base) " + " UNION ALL ".join(_SUNK.format(k) for k in ("csv", "json", "parquet"))))
def sinks(spark, sf):
    """The same rows written as parquet by partitions, as CSV with a byte-order mark and as compressed JSON with nulls, and what is read back from each."""
    from .catalog_windows import base

    rows = W.staged(base(spark, sf).select("code", "date", F.round("close", 6).alias("close"), F.when(F.col("code") % 3 != 0, F.round("ret", 9)).alias("ret"), F.year("date").alias("year")), "sink-rows")
    at = _folder(spark, "sinks")
    W.write_parquet(rows, f"{at}/parquet", ["year"])
    W.write_csv(rows, f"{at}/csv", ["code", "date", "close", "ret"])
    W.write_json(rows.drop("year"), f"{at}/json")
    names = "code long, date date, close double, ret double"
    back = {"parquet": spark.read.parquet(f"{at}/parquet"), "csv": spark.read.schema(names).option("header", True).option("enforceSchema", True).csv(f"{at}/csv"), "json": spark.read.schema(names).json(f"{at}/json")}
    out = None
    for name, df in back.items():
        one = df.agg(F.count("*").alias("n"), F.count("ret").alias("known"), F.round(F.sum("close"), 4).alias("total"), F.countDistinct("code").alias("codes")).select(F.lit(name).alias("sink"), "*")
        out = one if out is None else out.unionByName(one)
    return out
