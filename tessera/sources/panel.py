"""The panel that queries run on, scans with early filters, and unions with latest-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import entity, null_if_not_finite
from .versions import spread

MIN_LISTED_DAYS = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation and region."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation and region have a fixed number of rows; Spark broadcasts supplier as long as it is small
    where = suppliers.join(F.broadcast(nations), suppliers["s_nationkey"] == nations["n_nationkey"]).join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    return where.select("code", F.col("s_nationkey").alias("ind_code"), F.col("n_name").alias("ind_name"), F.col("r_name").alias("board"))


def panel_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's first date, from two columns of the items instead of the whole panel."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), "l_shipdate").join(_places(spark, sf_dir), "code", "left_semi")
    return items.agg(F.to_date(F.date_trunc("week", F.min("l_shipdate"))).alias("panel_start"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by week: a bounded price path from discounts and taxes, volume, turnover and dimensions."""
    spread(spark, [f"{sf_dir}/lineitem.parquet"])
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    cells = items.groupBy(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
        F.sum(F.round(F.col("l_discount") * 100)).alias("d"),
        F.sum(F.round(F.col("l_tax") * 100)).alias("t"),
        F.count("*").alias("n"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
    )
    cells = cells.join(_places(spark, sf_dir), "code")
    cells = cells.withColumn("close", 100 * F.product(1 + (F.col("d") / F.col("n") - 5) / 100).over(entity())).withColumn("g", (F.col("t") / F.col("n") - 4) / 400)
    cells = cells.withColumn("open", F.coalesce(F.lag("close").over(entity()), F.lit(100.0)) * (1 + F.col("g")))
    high, low = F.greatest("open", "close") * (1 + F.abs("g")), F.least("open", "close") * (1 - F.abs("g"))
    return cells.select(
        "code", "date", "open", high.alias("high"), low.alias("low"), "close", "volume", "turnover", "ind_code", "ind_name", "board",
        (F.col("code") % 37 == 0).alias("is_st"), (F.col("returned") * 4 <= F.col("n") * 3).alias("can_buy"), (F.col("t") * 2 <= F.col("n") * 13).alias("can_sell"),
    )


def with_listing(df: DataFrame, sentinel: int = 1_000_000, start: DataFrame | None = None) -> DataFrame:
    """Days since the first bar; entities that are there from the panel's first day (``start``, a row, where it is known) count as listed long ago."""
    first = F.min("date").over(Window.partitionBy("code"))
    start = df.agg(F.min("date").alias("panel_start")) if start is None else start
    out = df.withColumn("list_date", first).join(F.broadcast(start))  # one row
    days = F.when(F.col("list_date") == F.col("panel_start"), F.lit(sentinel)).otherwise(F.datediff("date", "list_date"))
    return out.withColumn("days_since_list", days).drop("panel_start")


def clean(df: DataFrame, min_days: int = MIN_LISTED_DAYS, start: DataFrame | None = None) -> DataFrame:
    """Rows that studies use: not special treatment, listed long enough, with a return. Later row shifts count these rows."""
    out = with_listing(df, start=start).withColumn("ret", F.round(F.col("close") / F.lag("close").over(entity()) - 1, 10))  # no sign from the last bit
    return out.where(~F.coalesce("is_st", F.lit(True)) & (F.coalesce("days_since_list", F.lit(0)) >= min_days) & F.col("ret").isNotNull())


def calendar(df: DataFrame) -> DataFrame:
    """Dense positions of the periods that occur: one row per period, so a single task numbers them."""
    return df.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("day"))


def with_row(df: DataFrame) -> DataFrame:
    """Rows that have a date, with their position within the entity."""
    return df.where("date IS NOT NULL").withColumn("row", F.row_number().over(entity()))


def union_latest(parts: list[DataFrame], keys: list[str], seq: list[str]) -> DataFrame:
    """All parts by column name, the row of the latest part (and there the last by ``seq``) for each key."""
    out = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("_part", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_part"), *(F.desc(c) for c in seq))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_part")


def first_by(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*seq))).where("_n = 1").drop("_n")


def normalised(df: DataFrame, required: list[str], optional: dict[str, str]) -> DataFrame:
    """Doubles without NaN, missing optional columns as null; a missing required column is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*(null_if_not_finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    return out.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns})


def session_date(ms: str, zone: str = "Asia/Shanghai"):
    """The local date of epoch milliseconds (session time zone UTC)."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(F.col(ms)), zone))
