"""Quality rules on repetition: how many characters lie inside duplicated n-grams and lines.

Each text is judged by itself, so the operator is one narrow pass: words are cut and hashed in numpy, and windows of
several lengths are compared by rolling hashes taken from one prefix sum over the word hashes. A null or empty text
has no words and fails the base rule. Texts of any length are taken whole; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, bounded, splitmix, word_bounds

SYMBOLS = b"#*$%&|<>"
#: Percent of a text's word characters inside n-grams that repeat an earlier one, above which it goes.
REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of a text's word characters taken by its most frequent n-gram; for texts of TOP_WORDS words or more.
TOP = {2: 20, 3: 18, 4: 16}
TOP_WORDS = 100
#: Percent of lines, and of word characters in lines, that repeat an earlier line.
LINES, LINE_CHARS = 30, 20

SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _dup_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the word characters in these."""
    seen: set[bytes] = set()
    lines = repeats = chars = 0
    for line in text.split(b"\n"):
        if not line or line.isspace():
            continue
        lines += 1
        if line in seen:
            repeats += 1
            chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        else:
            seen.add(line)
    return lines, repeats, chars


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    out = np.zeros(words, bool)
    for k in range(n):
        out[at + k] = True
    return out


def measure(text: bytes, roll: Roller, symbol: np.ndarray) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    n = len(start)
    n_symbols = int(symbol[raw].sum())
    if not n:
        return 0, 0, n_symbols, 0, 0, True, False
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]
    word_chars = int(chars.sum())
    lines, n_dup, dup_chars = _dup_lines(text)
    failed = 100 * n_dup > LINES * lines or 100 * dup_chars > LINE_CHARS * word_chars

    words = splitmix(roll.slices(roll.prefix(roll.byte[raw]), start, end))  # mixed, or windows of words would collide as their bytes' sums do
    prefix = roll.prefix(words)
    repeat_words = 0
    for g in REPEATED:
        grams = roll.ngrams(words, g, prefix)
        ordered = np.sort(grams)
        if not (ordered[1:] == ordered[:-1]).any():
            break  # longer windows cannot repeat either
        _, first, inverse, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
        if g == 5:
            repeat_words = int(_covered(np.flatnonzero(counts[inverse] > 1), g, n).sum())
        later = first[inverse] != np.arange(len(grams))
        failed |= 100 * int(chars[_covered(np.flatnonzero(later), g, n)].sum()) > REPEATED[g] * word_chars
    if n >= TOP_WORDS:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(chars, out=total[1:])
        for g, most in TOP.items():
            _, first, counts = np.unique(roll.ngrams(words, g, prefix), return_index=True, return_counts=True)
            twice = counts > 1
            if twice.any():
                failed |= 100 * int((counts[twice] * (total[first[twice] + g] - total[first[twice]])).max()) > most * word_chars
    base = n < 10 or 100 * repeat_words > 20 * n
    return n, word_chars, n_symbols, n_dup, repeat_words, base, not base and not failed


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll, symbol = Roller(), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for b in batches:
        rows = [measure(x or b"", roll, symbol) for x in b.column(1).cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its counts, whether the base rule fails it, and the verdict of all rules."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measured, SCHEMA).withColumnRenamed("id", id_col)
