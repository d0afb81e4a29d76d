"""Incremental ingestion: high-water marks, latest-wins merges, event windows, and the same as streams."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import entity
from ..sources.files import staged
from ..sources.panel import union_latest


def high_water(df: DataFrame, key: str, at: str) -> DataFrame:
    """How far each key has come."""
    return df.groupBy(key).agg(F.max(at).alias("mark"))


def newer(df: DataFrame, marks: DataFrame, key: str, at: str, since: str | None = None) -> DataFrame:
    """Rows from each key's mark on (that one again), or from ``since`` on; keys without a mark count as new."""
    out = df.join(marks, key, "left")
    start = F.lit(since).cast("date") if since else F.col("mark")
    return out.where(F.col("mark").isNull() | (F.col(at) >= start)).drop("mark")


def merge(old: DataFrame, new: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Later arrivals replace rows of the same key; doing it twice changes nothing."""
    return union_latest([old, new], keys, seq)


# ---- recomputing what changed ------------------------------------------------------------------------------------------


def _month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def write_periods(df: DataFrame, root: str) -> None:
    """Rows by month, each month a partition; months that are there already are replaced, others stay as they are."""
    df.withColumn("month", _month()).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(root)


def read_periods(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the months; a month is text, not a date."""
    return spark.read.option("basePath", root).parquet(root).withColumn("month", F.col("month").cast("string"))


def reached(rows: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """Of the entities with a change, the rows that a window of ``depth`` rows back carries it to (``fresh``), and those that such a window needs for them."""
    spans = changed.groupBy("code").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    own = Window.partitionBy("code")
    out = rows.join(spans, "code").withColumn("_n", F.row_number().over(entity()))
    out = out.withColumns({"_from": F.min(F.when(F.col("date") >= F.col("_lo"), F.col("_n"))).over(own), "_to": F.max(F.when(F.col("date") <= F.col("_hi"), F.col("_n"))).over(own)})
    out = out.where(F.col("_n").between(F.col("_from") - depth, F.col("_to") + depth)).withColumn("fresh", F.col("_n") >= F.col("_from"))
    return out.drop("_lo", "_hi", "_n", "_from", "_to")


def recompute(root: str, rows: DataFrame, changed: DataFrame, depth: int, along: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table in ``root`` up to the changed ``rows`` (code, date and values), and say what was touched.

    A change at one row reaches ``depth`` rows further along its entity; these are worked out again by ``along`` from
    the rows that its windows need. Every period with such a row is worked out again by ``across``, from the other
    entities' values as they stand in the table. Only the months of these periods are read and replaced; their rows are
    written elsewhere first, so that a lost executor finds the table as it was. ``changed``: code and date.
    """
    spark = rows.sparkSession
    needed = staged(reached(rows, changed, depth), "recompute-needed")
    fresh = staged(along(needed.drop("fresh").join(needed.where("fresh").select("code", "date", F.lit(True).alias("_f")), ["code", "date"], "left")).where("_f").drop("_f"), "recompute-fresh")
    periods = fresh.select("date").distinct()  # a row a period
    months = [r.month for r in periods.select(_month().alias("month")).distinct().collect()]  # a value a month
    there = read_periods(spark, root)
    kept = there.where(F.col("month").isin(months)).drop("month").join(fresh.select("code", "date"), ["code", "date"], "left_anti")
    both = kept.join(F.broadcast(periods), "date", "left_semi").select(*fresh.columns).unionByName(fresh)
    restated = across(both)
    still = kept.join(F.broadcast(periods), "date", "left_anti").select(*restated.columns)
    done = staged(still.unionByName(restated), "recompute-months")
    of_months = len(set(months) | {r.month for r in there.select("month").distinct().collect()})
    write_periods(done, root)
    counts = needed.agg(F.count("*").alias("n_read"), F.count_if("fresh").alias("n_along")).crossJoin(rows.agg(F.count("*").alias("n_rows"))).crossJoin(restated_count(done, periods))  # one row each
    return counts.select("n_rows", "n_read", "n_along", "n_across", F.lit(len(months)).cast("long").alias("n_months"), F.lit(of_months).cast("long").alias("of_months"))


def restated_count(done: DataFrame, periods: DataFrame) -> DataFrame:
    return done.join(F.broadcast(periods), "date", "left_semi").agg(F.count("*").alias("n_across"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest event of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))).where("_n = 1").drop("_n")


def read_events(spark: SparkSession, folder: str, schema, name: str = "events.parquet") -> DataFrame:  # noqa: ANN001
    """The event table as a stream of files, with event time as a timestamp."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "update") -> None:
    """Process what is there, then stop; with a lasting ``checkpoint`` the next call goes on from there."""
    at = checkpoint or tempfile.mkdtemp(prefix="tessera-stream-")
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def late_tolerant(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Without repeated events as long as they come within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
