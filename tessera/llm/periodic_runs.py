"""Periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, ``TIMES`` * q) words that no
neighbouring word extends keeping the period. A stretch of three periods or more holds a whole grid cell: for the first
multiple jp of p in it, the words jp, (j+1)p and (j+2)p are equal. So for every period p only the grid points are
compared, n/p of them, which sums to n log n over all periods; the few that survive some more probes are extended to
both sides by comparing arrays in chunks that double. Periods are probed in blocks [b, 2b), where none is a multiple of
another, all grid points of a block at once. A grid point whose two cells lie inside a run found with a smaller period
is skipped: two runs of different smallest periods overlap by less than the sum of these.

Words are told apart by their bytes, not by hashes, and each text is judged by itself in one narrow pass. A null or
empty text has no words, no run and an empty collapsed text. Repeated rows and rows without identifier are judged each
by itself, texts of any length are taken whole, an empty table gives an empty result, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, tidy

LEAST, TIMES = 24, 3
#: Grid points that are compared at once, and the words first and at most compared at once when a run is extended.
PAIRS, CHUNK, MOST_CHUNK = 1 << 19, 16, 1 << 16

SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretch(words: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """First word and end of the longest stretch around ``at`` in which words ``p`` apart are equal."""
    n, i, size = len(words), at, CHUNK
    while i + p < n:
        m = min(size, n - p - i)
        differs = words[i : i + m] != words[i + p : i + p + m]
        k = int(differs.argmax())
        if differs[k]:
            i += k
            break
        i, size = i + m, min(2 * size, MOST_CHUNK)
    end, i, size = i + p, at, CHUNK
    while i > 0:
        m = min(size, i)
        differs = (words[i - m : i] != words[i - m + p : i + p])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            i -= k
            break
        i, size = i - m, min(2 * size, MOST_CHUNK)
    return i, end


def _survivors(words: np.ndarray, lo: int, hi: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods in [lo, hi] that may lie in a run of that period."""
    n = len(words)
    periods = np.arange(lo, hi + 1)
    cells = (n - 1) // periods - 1  # grid points with two more behind them
    p = np.repeat(periods, cells)
    at = (np.arange(len(p)) - np.repeat(np.cumsum(cells) - cells, cells)) * p
    same = np.flatnonzero((words[at] == words[at + p]) & (words[at + p] == words[at + 2 * p]))
    at, p = at[same], p[same]
    for part in (2, 3, 5, 7):  # the whole cell repeats in the next one
        if not len(at):
            break
        k = (p + part - 1) // part
        same = words[at + k] == words[at + p + k]
        at, p = at[same], p[same]
    new = reach[at] < at + 2 * p
    return at[new], p[new]


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of word numbers, by start, then period. ``times`` is 3 or more."""
    n, found, known = len(words), [], set()
    reach = np.zeros(n, np.int64)  # the furthest end of a found run around each word
    lo, longest = 1, n // times
    while lo <= longest:
        block, new = min(2 * lo - 1, longest), []
        while lo <= block:
            hi = min(block, lo + max(PAIRS * lo // n, 1) - 1)
            seen, end = 0, 0
            for at, p in zip(*(x.tolist() for x in _survivors(words, lo, hi, reach)), strict=True):
                if p == seen and at < end - p:
                    continue  # in the stretch just looked at
                start, end = _stretch(words, at, p)
                seen = p
                if end - start >= max(least, times * p) and (start, end) not in known:
                    known.add((start, end))
                    new.append((start, end - start, p))
            lo = hi + 1
        for start, length, _ in new:
            part = reach[start : start + length]
            np.maximum(part, start + length, out=part)
        found += new
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat an earlier period of a run."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, p in runs:
        kept[start + p : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _judged(least: int, times: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, texts = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                numbers: dict[bytes, int] = {}
                runs = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32), least, times) if len(words) >= least else []
                sizes.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(_collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return step


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: its words, its runs (word numbers from 0) and its text without what they repeat."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_judged(least, max(times, 3))), SCHEMA).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers and texts of ``docs``, where every tenth text by the checksum of its identifier goes on periodically from some word.

    With h the crc32 of the decimal identifier, g = floor(h / 10) and n words, a text with h % 10 = 0 keeps its words
    before a = g % n; behind them its next p = 1 + floor((n - a) / (3 + g % 8)) words come again and again, up to n words.
    A row without identifier keeps its text.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), h.alias("__h"), F.when(h % 10 == 0, words).alias("__w"))
    n, g = F.size("__w").cast("long"), F.floor(F.col("__h") / 10)
    rows = rows.withColumn("__n", n).withColumn("__g", g).withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    rows = rows.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    behind = (F.col("__n") - F.col("__a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(behind / F.col("__p")).cast("int"))), F.lit(1), behind)
    periodic = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), again), " ")
    return rows.select(id_col, F.when(F.col("__a").isNotNull(), periodic).otherwise(F.col("__text")).alias(text_col))


def best_run(runs: Column) -> Column:
    """The run with the greatest length a period, compared as fractions; of equals the first, then the one of the smaller period."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``periodic_runs`` found, as counts, the best run and digests."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", best_run(F.col("runs")))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *(F.col("best").getField(c).alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
