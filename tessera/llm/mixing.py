"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of words: its documents in an order shuffled by hash, one after another, cut into blocks of
equal length. Slots of the mix are dealt to sources by mapping van der Corput points through the cumulative
weights, so every stretch of the mix holds each source in proportion. The rank of a slot within its source names the
block that it plays, starting over when the source is used up; slots join blocks, blocks join the documents in them.

Nothing is ranked in one task: the offset of a document is the offset of its hash bucket within its source plus a
running sum inside the bucket, and the rank of a slot at the start of a run of points is found in closed form.
Only a row per source reaches the driver.

Sources are taken by code point, null last, with weights 3, 1, 2, repeating. Targets share 150 % of all words by
weight; one that passes twice its source's size stops there and the excess is shared again by weight. A null or
empty text has size 0 and is taken 0 times. Repeated rows are documents of their own when mixed; an empty table, or one without
words, gives no words. Other columns do not matter. Equal input gives equal output, run after run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, bounded, staged, word_bounds

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096  # words of a block, at most
RUN_BITS = 14  # log2 of the points that one row of the schedule stands for
BUCKET_ROWS = 20_000  # documents of a hash bucket, about


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text: places where a non-space follows a space or the text's start, for a whole batch at once."""
    for b in batches:
        text = b.column(b.num_columns - 1).cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = ~_SPACE[raw]
        again = starts[:-1].copy()
        opens = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(raw))]
        again[opens - 1] = False  # a new text's first word starts whatever came before
        starts[1:] &= ~again
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(starts, out=total[1:])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(total[offsets]))], names=[*b.schema.names[:-1], "size"])


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Words for each source: ``share`` of all by weight, none above ``most`` times its size."""
    out, cap = np.zeros(len(sizes)), most * sizes
    left, open_ = share * float(sizes.sum()), sizes > 0
    while open_.any() and left > 1e-9:
        give = np.where(open_, weights, 0.0) * (left / weights[open_].sum())
        over = open_ & (out + give > cap)
        if not over.any():
            return out + give
        # those that would pass their limit stop there; the others wait for what is left
        left -= float((cap - out)[over].sum())
        out[over] = cap[over]
        open_ = open_ & ~over
    return out


def _radical(i: np.ndarray) -> np.ndarray:
    """Van der Corput points, base 2, as 64-bit fractions."""
    x = i.astype(np.uint64)
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x >> np.uint64(32)) | (x << np.uint64(32))


def counts_before(n: int, bounds: list[int]) -> list[int]:
    """Of the first ``n`` points, how many lie below each bound (fractions of 2**64)."""
    out, start = [0] * len(bounds), 0
    for bit in reversed(range(n.bit_length())):
        if not n >> bit & 1:
            continue
        # an aligned run of 2**bit points: the multiples of 2**-bit, moved on by the point of its start
        step, first = 1 << (64 - bit), int(_radical(np.array([start]))[0])
        for k, bound in enumerate(bounds):
            out[k] += max(0, -(-(bound - first) // step))
        start += 1 << bit
    return out


def _slots(bounds: list[int], quota: list[int], total: int) -> Callable:
    """Slots of runs of points: source and rank, as far as the source's quota goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, most = np.array([min(x, (1 << 64) - 1) for x in bounds[:-1]], np.uint64), np.array(quota)
        for b in batches:
            for k in b.column(0).to_pylist():
                begin, end = k << RUN_BITS, min(total, (k + 1) << RUN_BITS)
                source = np.searchsorted(edges, _radical(np.arange(begin, end)), side="right")
                base = np.diff([0, *counts_before(begin, bounds)])
                order = np.argsort(source, kind="stable")
                n = np.bincount(source, minlength=len(most))
                rank = np.empty(len(source), np.int64)
                rank[order] = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
                rank += base[source]
                keep = rank < most[source]
                yield pa.RecordBatch.from_arrays([pa.array(source[keep].astype(np.int64)), pa.array(rank[keep])], names=["src", "rank"])

    return run


def _taken(sized: DataFrame, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Words taken of each row that the mix takes (row, taken), and the sources (source, source_size, target)."""
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per source
    stats.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes, n_docs = np.array([r["size"] for r in stats], float), sum(r.n for r in stats)
    target = targets(sizes, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))], float))
    whole = [int(round(t)) for t in target]
    rows = []
    for i, r in enumerate(stats):
        size = int(r["size"])
        passes, rest = divmod(whole[i], size) if size else (0, 0)
        rows.append((i, r.source, size, float(target[i]), -(-size // block), passes * -(-size // block) + -(-rest // block), rest % block))
    quota = [x[5] for x in rows]
    total, acc, bounds = sum(quota), 0, []
    for q in quota:
        acc += q
        bounds.append((acc << 64) // total if total else 1 << 64)
    sources = spark.createDataFrame(rows, "src long, source string, source_size long, target double, blocks long, quota long, rest long")

    # where each document lies in its source's stream: bucket sums, then a running sum within the bucket
    buckets = max(64, n_docs // BUCKET_ROWS)
    ids = F.broadcast(sources.select("src", F.col("source").alias("s")))
    hashed = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = sized.where("size > 0").join(ids, F.col("source").eqNullSafe(F.col("s"))).select("row", "id", "src", "size", hashed.alias("h"), F.pmod(hashed, F.lit(buckets)).alias("bucket"))
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select("src", "bucket", (F.sum("sum").over(Window.partitionBy("src").orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(before, ["src", "bucket"])
    placed = placed.withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    pieces = placed.select("row", "src", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))

    # slots by source and rank, then the plays of each block
    runs = spark.range(0, -(-total >> RUN_BITS), numPartitions=max(1, min(1000, total >> RUN_BITS)))
    slots = runs.mapInArrow(_slots(bounds, quota, total), "src long, rank long")
    dealt = np.diff([0, *counts_before(total, bounds)]) if total else []
    short = [(i, int(n), q) for i, (n, q) in enumerate(zip(dealt, quota)) if n < q]
    if short:  # the few ranks that the points left open close the mix
        slots = slots.unionByName(spark.createDataFrame(short, "src long, a long, b long").select("src", F.explode(F.expr("sequence(a, b - 1)")).alias("rank")))
    cut = (F.col("rank") == F.col("quota") - 1) & (F.col("rest") > 0)  # the last slot ends at the target
    plays = (
        slots.join(F.broadcast(sources.select("src", "blocks", "quota", "rest")), "src")
        .groupBy("src", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.when(~cut, 1)).alias("full"), F.max(F.when(cut, F.col("rest"))).alias("rest"))
    )
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    part = F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce(F.col("rest"), F.lit(0))) - low)
    words = F.col("full") * (high - low) + part
    taken = pieces.join(plays, ["src", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    return taken, sources.select(F.col("source").alias("s"), "source_size", "target")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = staged(rows.mapInArrow(_sizes, "id long, source string, size long").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    taken, sources = _taken(sized, seed, block)
    joined = sized.join(taken, "row", "left").join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken"))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut after so many words; -1 leaves them whole."""
    for b in batches:
        texts, most = b.column("text"), b.column("most").to_pylist()
        if any(m >= 0 for m in most):
            raw = texts.cast(pa.binary()).to_pylist()
            texts = pa.array([x if m < 0 else x[: word_bounds(np.frombuffer(x, np.uint8))[1][m - 1]] for x, m in zip(raw, most, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([texts, b.column("rest")], names=["text", "rest"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken.

    At the end of its source's target the last copy is cut there; with ``whole`` it is taken whole if at least half of it
    lies before the end, and else not at all, so that no text is cut and a source misses its target by half a document at most.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")
    rows = bounded(docs).select(F.col(text_col).cast("string").alias("text"), rest)
    keyed = staged(rows.select(F.monotonically_increasing_id().alias("row"), "text", "rest"), "mix-rows")
    sized = keyed.select("row", F.col("rest").getField(id_col).cast("long").alias("id"), F.col("rest").getField(source_col).cast("string").alias("source"), "text")
    sized = staged(sized.mapInArrow(_sizes, "row long, id long, source string, size long"), "mix-sizes")
    taken, _ = _taken(sized, seed, block)
    copies = taken.join(sized.select("row", "size"), "row").where("taken > 0")
    if whole:
        times = copies.select("row", F.expr("cast((2 * taken + size) div (2 * size) as int)").alias("times")).where("times > 0")
        out = keyed.join(times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), "row")
    else:
        copies = copies.select("row", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), k -> if(k * size <= taken, -1L, taken % size))")).alias("most"))
        out = keyed.join(copies, "row").select("text", "rest", "most").mapInArrow(_first_words, keyed.drop("row").schema)
    return out.select(*(F.col("text").alias(text_col) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
