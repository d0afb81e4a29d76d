"""Resampling towards a target distribution by importance, over bucket-partitioned inverted postings.

Features are runs of 1 to ``most`` words, counted by the crc32 of their bytes modulo ``buckets``. A first narrow pass
sums the counts of both corpora by bucket (combined within each task, so at most ``buckets`` rows a task are shuffled).
A second pass turns each batch of documents into an inverted segment, (bucket, document, count) by bucket; it is
shuffled by a range of buckets and a salt of the batch, co-grouped with both corpora's counts of that range, and there
each bucket's gain is computed once and its contributions to the documents are summed. These sums are reduced by batch.

A bucket that every document has is one posting list a batch, dealt over the salts, whose number follows the number of
features; so no task grows with the input. Each cell and each batch is bounded. Ranks come from a range-partitioned
sort: positions within partitions plus the sizes of those before, one number a partition.

Null texts have no features and weight 0. Every row is drawn or not by itself, also rows that repeat an identifier; a
row without identifier is hashed as if its identifier were the empty text and comes last among equal scores. Texts of
any length are taken whole. An empty target or corpus counts as no features; an empty table gives an empty result.
Other columns do not matter. Batches are told apart by partition and position, so ``docs`` must give the same rows in
the same order when a partition is computed again, as a scan of files does; stage it before if it does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, partitions, staged, tidy

BUCKETS, MOST, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Ranges that the buckets are cut into, and features (about) in a cell of one range and one salt.
RANGES, CELL = 16, 1 << 19
#: Documents and features of an inverted segment.
SEGMENT_DOCS, SEGMENT_FEATURES = 2_000, 1 << 20

#: A-Z become a-z, what is neither letter, digit nor beyond ASCII becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SEGMENT = pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("n", pa.int32()), ("bucket", pa.binary()), ("length", pa.binary()), ("doc", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
SEGMENT = "range int, batch long, n int, bucket binary, length binary, doc binary, times binary, ids array<long>, n_features array<long>, n_words array<long>"
_PART = pa.schema([("batch", pa.int64()), ("sums", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
PART = "batch long, sums binary, ids array<long>, n_features array<long>, n_words array<long>"
_WEIGHT = pa.schema([("batch", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
WEIGHT = "batch long, at int, id long, n_words long, n_features long, weight long"


def feature_buckets(text: bytes, buckets: int = BUCKETS, most: int = MOST) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of each feature. The checksum of a run goes on from that of the run without its last word."""
    words = text.translate(_FOLD).split()
    sums = found = list(map(crc32, words))
    for n in range(1, most):
        sums = list(map(crc32, words[n:], map(crc32, repeat(b" "), sums)))
        found = found + sums
    return len(words), (np.array(found, np.uint32) % np.uint32(buckets)).astype(np.int64)


def _counted(buckets: int, most: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(feature_buckets(text or b"", buckets, most)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return step


def bucket_totals(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """bucket, n: all features of a corpus by bucket."""
    counted = bounded(docs).select(F.col(text_col).cast("string")).mapInArrow(tidy(_counted(buckets, most)), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _inverted(buckets: int, most: int, width: int):
    def segment(number: int, ids: list, sizes: list, found: list) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        key, times = np.unique(np.concatenate(found) * SEGMENT_DOCS + doc if len(doc) else np.zeros(0, np.int64), return_counts=True)
        more = (times + 254) // 255  # counts are bytes, so higher ones take several postings
        key, first = np.repeat(key, more), np.repeat(np.cumsum(more) - more, more)
        rest = np.repeat(times, more) - 255 * (np.arange(len(key)) - first)
        times, (bucket, doc) = np.minimum(rest, 255).astype(np.uint8), np.divmod(key, SEGMENT_DOCS)
        doc = doc.astype(np.uint16)
        cuts = np.searchsorted(bucket, np.arange(0, width * RANGES + 1, width))
        out: dict[str, list] = {name: [] for name in _SEGMENT.names}
        for r in range(RANGES):
            lo, hi = cuts[r], cuts[r + 1]
            if r and lo == hi:
                continue
            own, length = np.unique(bucket[lo:hi], return_counts=True)
            head = r == 0
            row = (r, number, len(ids), own.astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), doc[lo:hi].tobytes(), times[lo:hi].tobytes(), ids if head else None, [len(x) for x in found] if head else None, sizes if head else None)
            for name, x in zip(_SEGMENT.names, row, strict=True):
                out[name].append(x)
        return pa.RecordBatch.from_pydict(out, schema=_SEGMENT)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        sizes: list = []
        found: list = []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                n, own = feature_buckets(text or b"", buckets, most)
                ids.append(key)
                sizes.append(n)
                found.append(own)
                held += len(own)
                if len(ids) == SEGMENT_DOCS or held >= SEGMENT_FEATURES:
                    yield segment(number, ids, sizes, found)
                    number, held, ids, sizes, found = number + 1, 0, [], [], []
        if ids:
            yield segment(number, ids, sizes, found)

    return step


def _contributions(buckets: int, width: int, corpus: int, target: int):
    """A cell's postings times the gains of its buckets, summed by document of each batch."""

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        base = key[0].as_py() * width
        s, t = np.zeros(width), np.zeros(width)
        for row in right.to_pylist():
            at = np.array(row["bucket"], np.int64) - base
            s[at], t[at] = row["in_corpus"], row["in_target"]
        gain = np.floor(1000 * np.log((t + 1) * float(corpus + buckets) / ((s + 1) * float(target + buckets)))).astype(np.int64)
        out: dict[str, list] = {name: [] for name in _PART.names}
        for row in left.select(["batch", "n", "bucket", "length", "doc", "times", "ids", "n_features", "n_words"]).to_batches(max_chunksize=16):
            for r in row.to_pylist():
                each = np.repeat(gain[np.frombuffer(r["bucket"], np.int32) - base], np.frombuffer(r["length"], np.int32))
                sums = np.zeros(r["n"], np.int64)
                np.add.at(sums, np.frombuffer(r["doc"], np.uint16), each * np.frombuffer(r["times"], np.uint8))
                for name, x in (("batch", r["batch"]), ("sums", sums.tobytes()), *((c, r[c]) for c in ("ids", "n_features", "n_words"))):
                    out[name].append(x)
        return pa.Table.from_pydict(out, schema=_PART)

    return step


def _reduced(key: tuple, parts: pa.Table) -> pa.Table:
    """The documents of a batch: the sums of all ranges over the number of features."""
    rows = parts.to_pylist()
    total = np.sum([np.frombuffer(r["sums"], np.int64) for r in rows], axis=0)
    (head,) = (r for r in rows if r["ids"] is not None)
    n = np.array(head["n_features"], np.int64)
    weight = np.where(n > 0, total // np.maximum(n, 1), 0)
    return pa.table({"batch": [key[0].as_py()] * len(n), "at": np.arange(len(n), dtype=np.int32), "id": head["ids"], "n_words": head["n_words"], "n_features": n, "weight": weight}, schema=_WEIGHT)


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: batch, at (its place there), id, n_words, n_features and weight, the floored mean gain of its features."""
    width = -(-buckets // RANGES)
    in_corpus, in_target = (bucket_totals(d, c, buckets, most).withColumnRenamed("n", name) for d, c, name in ((docs, text_col, "in_corpus"), (target, target_col, "in_target")))
    totals = staged(in_corpus.join(in_target, "bucket", "full").na.fill(0).repartition(1), "importance-totals")  # a row a bucket at most
    n = totals.agg(F.sum("in_corpus"), F.sum("in_target")).first()
    corpus, wanted = n[0] or 0, n[1] or 0
    salts = max(1, corpus // (RANGES * CELL))
    packed = totals.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list(F.struct("bucket", "in_corpus", "in_target")).alias("all"))
    packed = packed.select("range", *(F.col(f"all.{c}") for c in ("bucket", "in_corpus", "in_target")))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    segments = rows.mapInArrow(tidy(_inverted(buckets, most, width)), SEGMENT).withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    parts = segments.groupBy("range", "salt").cogroup(packed.groupBy("range", "salt")).applyInArrow(_contributions(buckets, width, corpus, wanted), PART)
    return parts.groupBy("batch").applyInArrow(_reduced, WEIGHT)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "part", "place"])
        n += b.num_rows


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most: int = MOST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: n_features, weight, score and rank.

    The score adds Gumbel noise, from a hash of seed and identifier, to the weight, so the ``percent`` of documents with
    ``least_words`` words or more that score highest are a draw without replacement by weight. Ranks count from 1, ties
    go to the smaller identifier; what is not drawn has no rank.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scored = importance_weights(docs, target, id_col, text_col, target_col, buckets, most).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))
    scored = staged(scored.withColumn("counts", F.col("n_words") >= least_words), "importance-scores")
    order = [F.col("counts").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("batch"), F.col("at")]
    ordered = scored.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("id", "n_features", "weight", "score", "counts")
    placed = staged(ordered.mapInArrow(_numbered, "id long, n_features long, weight long, score long, counts boolean, part int, place long"), "importance-order")
    sizes = sorted(placed.groupBy("part").agg(F.count(F.lit(1)), F.count_if("counts")).collect())  # a row a partition
    before, eligible, n = [], 0, 0
    for part, rows, own in sizes:
        before.append((part, n))
        n, eligible = n + rows, eligible + own
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))  # a row a partition
    rank = F.col("before") + F.col("place") + 1
    return placed.join(offsets, "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("counts") & (rank <= percent * eligible // 100), rank).alias("rank"))
