"""Reading and writing files: parquet, CSV, JSON dimensions and series."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """A ticker dimension, as a JSON list or wrapped as ``{"data": {"item": [...]}}``."""
    item = "struct<thscode:string,name:string,list_date:string,exchange:string>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{item}>")
    wrapped = F.from_json("value", f"struct<data:struct<item:array<{item}>>>")["data"]["item"]
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped)).alias("t")).select("t.*")


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of code to (code, name), one row per key."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<code:string,name:string>>").alias("m"))
    return raw.select(F.explode("m").alias("thscode", "v")).select("thscode", F.col("v.code").alias("ind_code"), F.col("v.name").alias("ind_name"))


def read_group_tree(spark: SparkSession, path: str) -> DataFrame:
    """A two-level tree of groups, one row per group and member."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("groups").alias("g")).select(F.col("g.code").alias("group_code"), F.col("g.name").alias("group_name"), F.explode("g.subs").alias("member"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """An index series as JSON objects; of repeated dates the last stays."""
    schema = T.StructType([T.StructField("date_ms", T.LongType()), T.StructField("date", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open_price", "high_price", "low_price", "close_price", "volume", "turnover"))])
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("seq", F.monotonically_increasing_id())
    day = F.coalesce(F.to_date("date"), F.to_date(F.from_utc_timestamp(F.timestamp_millis("date_ms"), "Asia/Shanghai")))
    rows = rows.select(day.alias("date"), *(c for c in schema.names if c not in ("date", "date_ms")), "seq")
    return rows.groupBy("date").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("date", "seq"))), "seq").alias("r")).select("date", "r.*")


def read_mixed_series(spark: SparkSession, path: str) -> DataFrame:
    """series, date, close from a JSON document a line: bars as objects or as positions, a time in milliseconds or as a date; of repeated dates the last stays."""
    doc = spark.read.text(path).select(F.parse_json("value").alias("v"))
    bars = doc.select(F.variant_get("v", "$.series", "long").alias("series"), F.posexplode(F.variant_get("v", "$.klines", "array<variant>")).alias("at", "bar"))
    got = lambda kind, *paths: F.coalesce(*(F.try_variant_get("bar", p, kind) for p in paths))
    when = ("$.date_ms", "$.date", "$.day", "$.ts", "$[0]")
    day = F.coalesce(F.to_date(F.timestamp_millis(got("long", *when))), F.to_date(F.substring(got("string", *when), 1, 10)))
    rows = bars.select("series", "at", day.alias("date"), got("double", "$.close_price", "$.close", "$.c", "$[4]").alias("close"))
    return rows.groupBy("series", "date").agg(F.max_by("close", "at").alias("close"))


TREE = "groups array<struct<code:int,name:string,subs:array<string>,notes:array<string>>>, absent array<struct<code:int,name:string,why:string>>"


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A nested tree of groups: kind (group or absent), code, name, sub; a row per member, and one per absent group."""
    tree = spark.read.schema(TREE).json(path, multiLine=True)
    members = tree.select(F.explode("groups").alias("g")).select(F.lit("group").alias("kind"), "g.code", "g.name", F.explode("g.subs").alias("sub"))
    absent = tree.select(F.explode("absent").alias("g")).select(F.lit("absent").alias("kind"), "g.code", "g.name", F.lit(None).cast("string").alias("sub"))
    return members.unionByName(absent)


def grouped_members(tree: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The names that ``rows`` (code, date, ``name``) really has, under the tree's groups: kind, code, name, n_sub, n_stock (entities of the last date), subs.

    Groups keep only members that occur, and go without any; a name that no group claims is ``unlisted``, never lost.
    """
    end = rows.agg(F.max("date").alias("end"))
    have = rows.crossJoin(F.broadcast(end)).groupBy(F.col(name).alias("sub")).agg(F.countDistinct(F.when(F.col("date") == F.col("end"), F.col("code"))).alias("n"))  # one row is broadcast
    groups = tree.where("kind = 'group'").join(have, "sub")
    listed = groups.groupBy("kind", "code", "name").agg(F.count("*").alias("n_sub"), F.sum("n").alias("n_stock"), F.array_join(F.array_sort(F.collect_list("sub")), ",").alias("subs"))
    unlisted = have.join(groups.select("sub"), "sub", "left_anti").select(F.lit("unlisted").alias("kind"), F.lit(None).cast("int").alias("code"), F.col("sub").alias("name"), F.lit(1).cast("long").alias("n_sub"), F.col("n").alias("n_stock"), F.col("sub").alias("subs"))
    absent = tree.where("kind = 'absent'").select("kind", "code", "name", F.lit(0).cast("long").alias("n_sub"), F.lit(0).cast("long").alias("n_stock"), F.lit(None).cast("string").alias("subs"))
    return listed.unionByName(unlisted).unionByName(absent)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_version(df: DataFrame, root: str) -> str:
    """A new version beside the old ones; readers follow the newest complete one."""
    path = f"{root}/version={uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one in the warehouse, or one of our own with a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not root:
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        root = "file://" + _own_dir[0]
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write rows that are needed twice once, to the shared folder, and read them back."""
    path = write_version(df, f"{shared_dir(df.sparkSession)}/{label}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header and a byte-order mark before the first name, which spreadsheets look for."""
    out = df.select(*(columns or df.columns))
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, with nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(path)
