"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes, only those that begin at a minimiser stay: in every window of ``min_words`` words, the run of
``GRAM`` words with the smallest hash (the leftmost of equals). Which position a window selects depends on its own
words alone, so a passage shared by two documents selects the same positions in both, and about one suffix in 16
words is retained. The rest is sorting and comparing neighbours, twice:

1. A retained suffix is sorted by (hash of its GRAM words, hash of its reach: all windows that select it). Suffixes
   without a neighbour of equal words go. Those with a neighbour of equal reach repeat as a whole.
2. What remains of a matched suffix (one per distinct reach) is extended left and right: each window that selects it
   is hashed, and windows are sorted and compared with their neighbours. A window selects one suffix only, so it is
   looked at once, and a match of ``min_words`` words is found wherever it lies around the suffix: no link depends
   on which suffixes happen to be neighbours.

Rows are range-partitioned by hash and identifier, so a passage that a third of all documents share spreads over as
many partitions as its rows ask for. A partition tells its two edge runs; their sums are broadcast (at most four
keys a partition). A scan holds only rows of a run that has shown one document so far.

Words are runs of anything but ASCII white space, compared after lower-casing A-Z; a null text has none. Texts under
``min_words`` words have no passage. A row is told by its identifier and a digest of its text: positions found in one
row never touch another text of the same identifier. A passage must occur in two different documents: rows that share
an identifier are one document, and each text without an identifier is one of its own (equal ones are the same). Of
equal windows, the first in the order of identifier, digest of the text and position is the first occurrence, texts
without an identifier last; repeated rows (same identifier and text) are that occurrence together. Windows are compared
by two 64-bit hashes. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Roller, bounded, partitions, splitmix, staged, word_bounds

MIN_WORDS = 50
GRAM = 20  # words of a suffix that neighbours must share; a window of 50 words then chooses among 31 of them

#: doc and row name a row of the input; known: 1 where another document has the same, though its row is not there
COLUMNS = ["key", "reach", "doc", "row", "lo", "hi", "known"]
ORDER = COLUMNS[:5]
PLACE = ["doc", "row", "lo"]
SORTED = ", ".join(f"{c} long" for c in COLUMNS)
SCANNED = f"{SORTED}, key_multi boolean, multi boolean, later boolean, key_edge boolean, edge boolean"


def _words(text: bytes, roll: Roller) -> np.ndarray:
    return roll.words(text.lower())


def suffixes(words: np.ndarray, roll: Roller, least: int) -> tuple[np.ndarray, ...]:
    """For each retained suffix: hash of its words, hash of its reach, first and last start of the windows that select it."""
    gram = min(GRAM, least)
    if len(words) < least:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    prefix = roll.prefix(words)
    grams = roll.ngrams(words, gram, prefix)
    wide = least - gram + 1
    chosen = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(words) - least + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    return grams[chosen[first]], splitmix(roll.slices(prefix, first, last + least)), first, last


def _retain(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in batches:
            parts = []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                key, reach, first, last = suffixes(_words(text or b"", roll), roll, least)
                n = len(key)
                parts.append((key.view(np.int64), reach.view(np.int64), np.full(n, doc, np.int64), np.full(n, row, np.int64), first, last, np.zeros(n, np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=COLUMNS)

    return run


def _windows(least: int) -> Callable:
    """Every window that selects one of the suffixes named in ``at`` (first window, and 1 where another document is known to have its reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in batches:
            for doc, row, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3), strict=True):
                words = _words(text or b"", roll)
                _, _, first, last = suffixes(words, roll, least)
                wanted, shared = (at.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                kept = np.isin(first, wanted)
                first, last = first[kept], last[kept]
                known = np.isin(first, wanted[shared > 0]).astype(np.int64)
                if not len(first):
                    continue
                span = last - first + 1
                start = np.arange(span.sum()) + np.repeat(first - np.r_[0, np.cumsum(span)[:-1]], span)
                key, more = (splitmix(roll.slices(roll.prefix(w), start, start + least)).view(np.int64) for w in (words, splitmix(words)))
                whose = (np.full(len(start), x, np.int64) for x in (doc, row))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, more, *whose, start, start, np.repeat(known, span))], names=COLUMNS)

    return run


def _run_state(new: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose runs begin at ``new``: whether the run shows two documents, and where it begins."""
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    multi = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)) | (np.maximum.reduceat(known, begin) > 0)
    return multi[run], begin[run]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of a partition sorted by ORDER.

    Rows of a key that shows one document only are left out, unless the key's run may go on in another partition.
    The buffer begins with up to four rows, already told, that stand for the runs that are still open.
    """
    held = np.zeros((0, len(COLUMNS)), np.int64)
    told, opened = 0, False

    def look(rows: np.ndarray, told: int, is_last: bool) -> tuple[pa.RecordBatch, np.ndarray, int]:
        n = len(rows)
        new_key, new = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = rows[1:, 0] != rows[:-1, 0]
        new[1:] = new_key[1:] | (rows[1:, 1] != rows[:-1, 1])
        key_multi, key_at = _run_state(new_key, rows[:, 2], rows[:, 6])
        multi, at = _run_state(new, rows[:, 2], rows[:, 6])
        later = (rows[:, 2:5] != rows[at, 2:5]).any(axis=1)
        key_edge, edge = np.zeros(n, bool), np.zeros(n, bool)
        if not opened:
            key_edge |= key_at == 0
            edge |= at == 0
        if is_last:
            key_edge |= key_at == key_at[-1]
            edge |= at == at[-1]
        hold = np.zeros(n, bool)
        if not is_last:
            hold[-1] = True
            if not multi[-1]:
                hold[at[-1] :] = True
            if not key_multi[-1]:
                hold[key_at[-1] :] = True
        out = ~hold & (key_multi | key_edge)
        out[:told] = False
        batch = pa.RecordBatch.from_arrays([*(pa.array(rows[out, i]) for i in range(len(COLUMNS))), *(pa.array(x[out]) for x in (key_multi, multi, later, key_edge, edge))], names=[*COLUMNS, "key_multi", "multi", "later", "key_edge", "edge"])
        if is_last:
            return batch, rows[:0], 0
        ghosts = []
        for begin, shows in ((key_at[-1], key_multi[-1]), (at[-1], multi[-1])):
            ghosts.append(begin)
            if shows:
                ghosts.append(begin + int(np.argmax((rows[begin:, 2] != rows[begin, 2]) | (rows[begin:, 6] > 0))))
        keep = np.unique(np.array([x for x in ghosts if not hold[x] or x < told], np.int64))
        wait = np.flatnonzero(hold)
        wait = wait[wait >= told]
        return batch, np.concatenate([rows[keep], rows[wait]]), len(keep)

    for b in batches:
        if not b.num_rows:
            continue
        fresh = np.stack([b.column(i).to_numpy() for i in range(len(COLUMNS))], axis=1)
        batch, held, told = look(np.concatenate([held, fresh]), told, False)
        opened = opened or bool(batch.num_rows) or told > 0
        if batch.num_rows:
            yield batch
    if len(held) > told:
        yield look(held, told, True)[0]


def _compare(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with key_multi and multi (two documents share the key, the reach) and later (an earlier row has both), wherever their runs were cut."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    seen = staged(bounded(ordered, 16384).mapInArrow(scan, SCANNED), label)
    told = [F.min("doc").alias("d0"), F.max("doc").alias("d1")]
    keys = seen.where("key_edge").groupBy("key").agg(*told, F.max("key_multi").alias("m")).select("key", (F.col("m") | (F.col("d0") < F.col("d1"))).alias("key_too"))
    runs = seen.where("edge").groupBy("key", "reach").agg(*told, F.max("multi").alias("m"), F.min(F.struct(*PLACE)).alias("head"))
    runs = runs.select("key", "reach", (F.col("m") | (F.col("d0") < F.col("d1"))).alias("too"), "head")
    both = seen.join(F.broadcast(keys), "key", "left").join(F.broadcast(runs), ["key", "reach"], "left")  # two runs a partition at most
    return both.select(
        *COLUMNS,
        (F.col("key_multi") | F.coalesce("key_too", F.lit(False))).alias("key_multi"),
        (F.col("multi") | F.coalesce("too", F.lit(False))).alias("multi"),
        (F.col("later") | F.coalesce(F.col("head") < F.struct(*PLACE), F.lit(False))).alias("later"),
    ).where("key_multi")


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc, row, text and ``more``: where there is no identifier, ``row`` is odd and ``doc`` a digest of the text, at 2**62 or more."""
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    doc = F.coalesce("id", F.xxhash64(F.lit(11), "text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62))
    row = F.xxhash64(F.lit(7), "text").bitwiseAND(-2) + F.col("id").isNull().cast("long")
    return bounded(whole.withColumns({"doc": doc, "row": row}).drop("id"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Ranges of windows that two documents share: doc and row, lo and hi (starts of the first and last, in words), later (all have an earlier copy)."""
    texts = _rows(docs, id_col, text_col).select("doc", "row", "text")
    kept = staged(texts.mapInArrow(_retain(min_words), SORTED), "suffixes")
    matched = staged(_compare(kept, "suffix-scan"), "suffix-matches")
    whole = matched.where("multi and later").select("doc", "row", "lo", "hi", "later")
    # the rest, and the first of each reach as the others' partner; repeated rows say the same
    rest = matched.where("not (multi and later)").groupBy("doc", "row").agg(F.collect_set(F.struct("lo", F.col("multi").cast("long").alias("known"))).alias("at"))
    found = texts.join(rest, ["doc", "row"]).select("doc", "row", "text", "at").mapInArrow(_windows(min_words), SORTED)
    windows = _compare(staged(found, "windows"), "window-scan").where("multi").select("doc", "row", "lo", "hi", "later")
    return whole.unionByName(windows)


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Touching half-open intervals made one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]] if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return lo[first], hi[np.r_[first[1:], len(lo)] - 1] if len(first) else hi


def _ranges(items: pa.Array, least: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    lo, hi, later = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    later = later.astype(bool)
    return _union(lo, hi + least), _union(lo[later], hi[later] + least)


def _spans(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, row, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                (lo, hi), (late_lo, late_hi) = _ranges(items.values, least)
                for s, e in zip(lo.tolist(), hi.tolist(), strict=True):
                    inside = np.minimum(late_hi, e) - np.maximum(late_lo, s)
                    rows.append((None if row & 1 else doc, s, e, e - s, int(inside[inside > 0].sum())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start_word", "end_word", "n_words", "n_later"])

    return run


def _by_row(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    ranges = repeated_windows(docs, id_col, text_col, min_words)
    return ranges.groupBy("doc", "row").agg(F.collect_set(F.struct("lo", "hi", "later")).alias("ranges"))  # two a word of the text at most


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per maximal passage made of windows that another document has too: identifier, start_word and end_word
    (half-open, counted in words), n_words, n_later (words of it that an earlier copy covers)."""
    spans = bounded(_by_row(docs, id_col, text_col, min_words)).mapInArrow(_spans(min_words), "id long, start_word long, end_word long, n_words long, n_later long")
    return spans.withColumnRenamed("id", id_col)


def _cut(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, items in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1), strict=True):
                if text is not None and items.is_valid:
                    begin, _ = word_bounds(np.frombuffer(text, np.uint8))
                    edge = np.r_[begin, len(text)]
                    lo, hi = (np.minimum(x, len(begin)) for x in _ranges(items.values, least)[1])
                    left, right = np.r_[0, edge[hi]], np.r_[edge[lo], len(text)]
                    text = b"".join(text[s:e] for s, e in zip(left, right, strict=True))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), b.column(2)], names=["text", "rest"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of repeated passages; the first occurrence, and every row, stays."""
    ranges = _by_row(docs, id_col, text_col, min_words)
    keyed = _rows(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest"))
    joined = keyed.join(ranges, ["doc", "row"], "left").select("text", "ranges", "rest")
    cut = joined.mapInArrow(_cut(min_words), joined.select("text", "rest").schema)
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
