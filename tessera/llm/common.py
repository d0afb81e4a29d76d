"""What the operators share: staged tables, word rules and rolling hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but the six ASCII white-space characters; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a step's rows once and read them back: the lineage ends here and a lost executor costs only a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows and 8 MB from now on: texts and packed arrays are long, and a batch is held several times."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def tidy(step: Callable) -> Callable:
    """``step`` for mapInArrow, after which the worker process, which outlives its task, gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- rolling hashes over bytes -------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes modulo 2**64 of any slice of a byte or integer array, from one prefix sum.

    The hash of [s, e) is (H[e] - H[s]) * B**-s, where H sums value * B**position; every byte value counts as a
    random odd 64-bit number, so that low bits are as good as high ones.
    """

    def __init__(self) -> None:
        self.byte = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        self.pow = self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) > n:
            return
        n = max(n + 1, 2 * len(self.pow), 1 << 14)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base & _MASK))
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """H, one longer than ``values`` (uint64)."""
        self._grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inv[start]

    def words(self, text: bytes) -> np.ndarray:
        """A hash for each word of ``text``."""
        raw = np.frombuffer(text, np.uint8)
        start, end = word_bounds(raw)
        if not len(start):
            return np.zeros(0, np.uint64)
        return splitmix(self.slices(self.prefix(self.byte[raw]), start, end))

    def ngrams(self, items: np.ndarray, n: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """A hash for each window of ``n`` items."""
        if len(items) < n:
            return np.zeros(0, np.uint64)
        h = self.prefix(items) if prefix is None else prefix
        at = np.arange(len(items) - n + 1)
        return splitmix((h[n:] - h[:-n])[: len(at)] * self.inv[at])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
