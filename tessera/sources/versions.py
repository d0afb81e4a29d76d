"""Versions of a table that readers can follow, and stages that are reused for as long as their source files stay the same.

A version is a folder of its own. Only when all of it is written does a row of the manifest name it, so a reader, who
takes the newest version that the manifest names, never sees half of one; a write that was torn off leaves files that
nobody reads. Old versions are removed when newer ones are complete, never the newest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import shared_dir

#: Input behind a shuffle partition, and shuffled bytes of a merged one: rows of the panel take 12 to 60 bytes in a shuffle,
#: and many times as much in each of the windows behind it.
PARTITION_BYTES, MERGED_BYTES = 2 << 20, 1 << 20
MANIFEST = "version string, seq long, fingerprint string"


def _path(spark: SparkSession, path: str):
    """Hadoop's path and file system, which know every store that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def spread(spark: SparkSession, paths: list[str]) -> int:
    """Let shuffles start from a number of partitions that follows the files' size, so that what a task holds does not grow with it; adaptive execution merges small ones."""
    size = sum(fs.getContentSummary(p).getLength() for fs, p in (_path(spark, path) for path in paths))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(MERGED_BYTES))
    return n


def versions(spark: SparkSession, root: str) -> list:
    """What the manifest names, newest first: a row a version that was ever complete."""
    if not exists(spark, f"{root}/manifest"):
        return []
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("seq"), F.desc("version")).collect()


def publish(df: DataFrame, root: str, fingerprint: str = "", keep: int = 2) -> str:
    """Write a new version, make it the current one, and remove all but the ``keep`` newest (0: none is removed)."""
    spark, known = df.sparkSession, versions(df.sparkSession, root)
    name = uuid.uuid4().hex
    df.write.option("compression", "zstd").parquet(f"{root}/version={name}")
    row = (name, known[0].seq + 1 if known else 1, fingerprint)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    for old in known[keep - 1 :] if keep else []:
        remove(spark, f"{root}/version={old.version}")
    return f"{root}/version={name}"


def current(spark: SparkSession, root: str, fingerprint: str | None = None) -> DataFrame | None:
    """The newest complete version, or that of a fingerprint; None if there is none."""
    for v in versions(spark, root):
        if (fingerprint is None or v.fingerprint == fingerprint) and exists(spark, f"{root}/version={v.version}"):
            return spark.read.parquet(f"{root}/version={v.version}")
    return None


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes with name, size and time of any file behind the paths; no file is opened for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    got = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum")).first()
    return f"{got.n}:{got.size}:{got['sum']}"


def reused(spark: SparkSession, paths: list[str], label: str, build: Callable[[], DataFrame], scope: str | None = None) -> DataFrame:
    """``build``'s rows, written once to the folder that all executors share and read from there until a source file changes.

    The files say nothing of the code that made the stage, so it is shared within a session only; ``scope``, such as the
    name of a release, shares it between sessions that use the same one. No stage is removed while it may be read.
    """
    spread(spark, paths)
    root, mark = f"{shared_dir(spark)}/reused/{scope or spark.sparkContext.applicationId}/{label}", fingerprint(spark, paths)
    found = current(spark, root, mark)
    if found is None:
        publish(build(), root, mark, keep=0)
        found = current(spark, root, mark)
    return found
