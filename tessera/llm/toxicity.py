"""Toxicity: a subsequence string kernel and a support vector machine over Nyström landmarks.

Two words are compared by the letters-in-order triples that they share, each occurrence worth DECAY per letter that it
spans, so gapped and padded spellings stay close; a word's start is a letter too, of weight EDGE. The kernel is computed from its explicit triples (spans up to
SPAN). Landmarks are words: those that set the toxic documents of the training sample apart, and frequent others. A
word is described by its kernel values for the landmarks, taken through the inverse root of the landmarks' own kernel
matrix, and a linear support vector machine (squared hinge loss) over these is fitted on labelled sentences: every
word of a clean sentence is clean, and a toxic sentence has a witness, at first the word that sets toxic documents
apart, then the word that the model finds worst. Sentences of toxic documents without a witness stay out of the fit.
Altered spellings of the witnesses (a letter or two put in, one doubled, one left out) are toxic examples too, unless
a clean document holds them.

A word of more than LONGEST letters is as bad as the worst of what lies between its joints and of its overlapping
stretches. Letters of all scripts count; a script without spaces is read in such stretches too.

A sentence is as bad as its worst word. What a sentence tells is the logarithm of how much oftener so bad a sentence
stands in toxic documents than in clean ones, by a rising step function of the margin that is never below 0. A text's
score is a rising function of the sum over its sentences, calibrated to a probability on whole documents, so that no
sentence makes a text less toxic.

Fitting takes a bounded sample of labelled rows (``most``); scoring is one narrow pass over whole texts. A worker
remembers the words it has compared, within a bound. A null or empty text has no sentences and scores as one without
any word near a landmark. Without labels of both classes every score is 0.5. Repeated rows are scored one by one; only
identifier and text are looked at.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .training import fold, labelled_sample, logistic, squared_hinge

DECAY, SPAN, LONGEST = 0.8, 7, 32  # gaps cost little, so that a letter put in leaves a word closer than any chance word
MARKED, PLAIN = 96, 48  # landmarks of either kind
EDGE = 2.0
ACCENTED = "éèêëäâàáöôóòüûúùßçñíîïì"  # letters of their own; others with marks count as their base
POINT = 21  # bits of a code point
SHORT = (8, 16)  # a word over LONGEST letters is also read in stretches as short as these
CLOSE = 0.4  # kernel values below this count as none
POWER = 4  # a power of a kernel is a kernel, and a sharper one
CHANCE = 26.0  # a marker's gain in log likelihood; no chance word of a vocabulary of a million comes near
CLEAN = 200.0  # weight of all clean words together; that of the witnesses is 2
OTHER = 0.03  # weight of altered spellings beside the sentences of toxic documents
ALIKE = 0.9  # a marker this close to one already chosen is no landmark of its own
KNOWN = 400_000  # words of one generation; a worker remembers two
#: Letters that stand for others.
LEET = str.maketrans("013457@$!|", "oieastasil")
SPELLED = re.compile(rb"(?<![^\s])[A-Za-z0-9@$](?:[\s.*_-]+[A-Za-z0-9@$]){2,}(?![^\s])")
JOINT = re.compile(r"[\W_]+")
STOP = (b".", b"!", b"?", b":", b";")


class _Alphabet(dict):
    """What each character counts as: a letter of any script, with the vowel signs that some scripts write as marks."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        whole = c if c in ACCENTED else unicodedata.normalize("NFD", c)
        self[point] = out = "".join(x for x in whole if x.isalpha() or (0x900 <= ord(x) < 0xFE00 and unicodedata.category(x) in ("Mn", "Mc") and not unicodedata.combining(x)))
        return out


ALPHABET = _Alphabet()


def _spelt(w: str) -> str:
    if not (w.isascii() and w.isalpha()):
        if any(c.isalpha() for c in w):
            w = w.translate(LEET)
        w = unicodedata.normalize("NFC", w).translate(ALPHABET)
    return w


def _bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}<>#*$%&|=~^_+-/\\")


def letters(word: bytes) -> str:
    """A word's letters: punctuation around and joints within dropped, look-alikes put back."""
    return _spelt(_bare(word))


def stretches(word: bytes) -> Iterator[str]:
    """What is compared of a word: its letters, or those between its joints and overlapping stretches of LONGEST and fewer letters where it has more."""
    whole = letters(word)
    if len(whole) <= LONGEST:
        yield whole
        return
    for part in JOINT.split(_bare(word)):
        if 2 <= len(one := _spelt(part)) <= LONGEST:
            yield one
    for n in (*SHORT, LONGEST):
        step = n // 4
        for i in range(0, len(whole) - n + step, step):
            yield whole[i : i + n]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, triple code and weight of all distinct triples of the words, each of LONGEST letters at most; a code is three code points."""
    length = np.array([len(w) for w in words], int)
    size = length.max(initial=0) + 1
    points, symbol = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    points = np.concatenate([[0], points.astype(np.int64)])  # the start
    symbols = len(points)  # at most 2000 * LONGEST, so that keys have less than 63 bits
    grid = np.full((len(words), size + SPAN), -1, np.int32)
    grid[:, 0] = 0
    grid[:, 1 : size][np.arange(size - 1) < length[:, None]] = symbol + 1
    who, code, weight = [], [], []
    for j in range(1, SPAN - 1):
        for k in range(j + 1, SPAN):
            a, b, c = grid[:, :size], grid[:, j : size + j], grid[:, k : size + k]
            at = np.nonzero((a >= 0) & (c >= 0))
            who.append(at[0])
            code.append((a[at].astype(np.int64) * symbols + b[at]) * symbols + c[at])
            weight.append(np.where(at[1] == 0, EDGE, 1.0) * DECAY ** (k + 1))
    if not words:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    codes = symbols**3
    key = np.concatenate(who).astype(np.int64) * codes + np.concatenate(code)
    keys, inverse = np.unique(key, return_inverse=True)
    who, code = keys // codes, keys % codes
    code = (points[code // symbols**2] << 2 * POINT) | (points[code // symbols % symbols] << POINT) | points[code % symbols]
    return who, code, np.bincount(inverse, np.concatenate(weight), len(keys))


class Landmarks:
    """Normalised kernel values between words and landmarks."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        who, code, weight = triples(words)
        norm = np.sqrt(np.bincount(who, weight**2, len(words)))
        order = np.lexsort((who, code))
        who, code, weight = who[order], code[order], (weight / np.where(norm > 0, norm, 1)[who])[order]
        self.codes, self.begin, self.count = np.unique(code, return_index=True, return_counts=True)
        self.mark, self.weight = who, weight  # by code, one entry a landmark that holds it

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for begin in range(0, len(words) if len(self.codes) else 0, 2000):
            part = words[begin : begin + 2000]
            who, code, weight = triples(part)
            norm = np.sqrt(np.bincount(who, weight**2, len(part)))
            row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[row] == code  # triples that no landmark has add nothing
            who, row, weight = who[known], row[known], weight[known]
            times = self.count[row]
            entry = np.repeat(self.begin[row] - np.cumsum(times) + times, times) + np.arange(times.sum())
            value = np.repeat(weight / norm[who], times) * self.weight[entry]
            out[begin : begin + len(part)] = np.bincount(np.repeat(who, times) * len(self.words) + self.mark[entry], value, out[begin : begin + len(part)].size).reshape(len(part), -1)
        out[out < CLOSE] = 0
        return out**POWER


class Reader:
    """Margins of words, and of the sentences of texts; words near no landmark have none."""

    def __init__(self, marks: Landmarks, weight: np.ndarray, bias: float) -> None:
        self.marks, self.weight, self.bias = marks, weight, bias
        self.known: dict[bytes, float | None] = {}
        self.older: dict[bytes, float | None] = {}
        self.near: dict[str, float | None] = {}  # by letters

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        if len(self.near) > KNOWN:
            self.near = {}
        known, older, near, new = self.known, self.older, self.near, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                elif len(s := letters(w)) <= LONGEST:
                    new.append((w, s))
                else:
                    known[w] = self.worst(stretches(w))
        open_ = sorted({s for _, s in new if len(s) >= 2 and s not in near})
        if open_:
            near.update(zip(open_, self.margins(open_), strict=True))
        known.update((w, near.get(s)) for w, s in new)

    def margins(self, words: list[str]) -> list[float | None]:
        values = self.marks.kernel(words)
        margin, some = (values @ self.weight + self.bias).tolist(), values.any(axis=1).tolist()
        return [m if x else None for m, x in zip(margin, some, strict=True)]

    def worst(self, words: Iterator[str]) -> float | None:
        """The worst margin of a long word's stretches, a bounded number at a time."""
        out = None
        while part := sorted(set(islice(words, 2000))):
            out = max((m for m in (out, *self.margins(part)) if m is not None), default=None)
        return out

    def sentences(self, texts: list[bytes]) -> Iterator[list[float]]:
        """For each text, the margins of its sentences that hold a word near a landmark."""
        for begin in range(0, len(texts), 128):
            part = texts[begin : begin + 128]
            cut = [t.split() for t in part]
            spelled = [[re.sub(rb"[^A-Za-z0-9@$]", b"", m) for m in SPELLED.findall(t)] for t in part]
            self.learn({w for words in cut for w in words} | {w for words in spelled for w in words})
            known = self.known
            for words, apart in zip(cut, spelled, strict=True):
                found = [m for w in apart if (m := known[w]) is not None]
                near = [(i, m) for i, w in enumerate(words) if (m := known[w]) is not None]
                if near:
                    last, best = near[0]
                    for i, m in near[1:]:
                        if any(w.endswith(STOP) for w in words[last:i]):
                            found.append(best)
                            best = m
                        best, last = max(best, m), i
                    found.append(best)
                yield found


class Evidence:
    """What margins tell: a rising step function, summed over a text's sentences."""

    def __init__(self, cut: np.ndarray, gain: np.ndarray) -> None:
        self.cut, self.gain = cut, gain

    def __call__(self, sentences: list[float]) -> float:
        """0 where no sentence is as bad as the least step."""
        at = np.searchsorted(self.cut, np.array(sentences, float), side="right")
        return float(np.append(0.0, self.gain)[at].sum())

    @classmethod
    def of(cls, sentences: list[list[float]], y: np.ndarray, other: list[float] = ()) -> Evidence:
        """By isotonic regression: the log of a margin's share among toxic documents' sentences over that among clean ones', where it is above 0.

        ``other``: margins of toxic sentences that do not occur in the sample, which together weigh OTHER of those that do.
        """
        margin = np.array([m for s in sentences for m in s] + list(other))
        label = np.array([c for s, c in zip(sentences, y, strict=True) for _ in s] + [1] * len(other), bool)
        seen = len(margin) - len(other)
        n1, n0 = max(1, int(label[:seen].sum())), max(1, int((~label).sum()))
        values, place = np.unique(margin, return_inverse=True)
        mass = np.append(np.ones(seen), np.full(len(other), OTHER * n1 / max(1, len(other))))
        bad, good = np.bincount(place, mass * label, len(values)) / n1, np.bincount(place, mass * ~label, len(values)) / n0
        blocks: list[list[float]] = []
        for least, b, g in zip(values.tolist(), bad.tolist(), good.tolist(), strict=True):
            blocks.append([b, g, least])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b, g, _ = blocks.pop()
                blocks[-1][0] += b
                blocks[-1][1] += g
        gain = np.array([np.log((b + 0.5 / n1) / (g + 0.5 / n0)) for b, g, _ in blocks])
        return cls(np.array([least for *_, least in blocks]), np.maximum(np.maximum.accumulate(gain), 0.0) if blocks else gain)


def _markers(bags: list[set[str]], y: np.ndarray) -> list[str]:
    """Words that set toxic documents apart, the surest first."""
    counts = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        counts[label].update(bag)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    out = []
    for w, c in counts[1].items():
        d = counts[0][w]
        p1, p0, p = c / n1, d / n0, (c + d) / (n0 + n1)
        if p1 > 4 * p0:
            gain = 2 * (c * np.log(p1 / p) + (d * np.log(p0 / p) if d else 0.0))  # of the log likelihood, against one rate for both
            out.append((gain, w))
    return [w for gain, w in sorted(out, key=lambda x: (-x[0], x[1])) if gain > CHANCE]


def _apart(words: list[str], most: int) -> list[str]:
    """The first words none of which is much like another, looked for in the whole list."""
    taken: list[str] = []
    for begin in range(0, len(words), 8 * most):
        part = words[begin : begin + 8 * most]
        if taken:
            part = [w for w, near in zip(part, (Landmarks(taken).kernel(part) > ALIKE**POWER).any(axis=1), strict=True) if not near]
        alike = Landmarks(part).kernel(part) > ALIKE**POWER
        own: list[int] = []
        for i in range(len(part)):
            if len(taken) + len(own) < most and not alike[i, own].any():
                own.append(i)
        taken += [part[i] for i in own]
        if len(taken) == most:
            break
    return taken


def altered(word: str, alphabet: str) -> list[str]:
    """Spellings with a letter doubled, one or two put in, or one left out, at every place of the word; which letters go in follows the place."""
    n, out = len(word), set()
    pick = lambda k: alphabet[k % len(alphabet)]
    for i in range(1, n + 1):
        one, two = pick(7 * i + n), pick(11 * i + 5)
        wide, j = word[:i] + one + word[i:], (i + 2) % n or 1
        out |= {wide, word[:i] + word[i - 1] + word[i:], word[:i] + one + two + word[i:], wide[:j] + two + wide[j:]}
        if n > 4 and i < n:
            out.add(word[:i] + word[i + 1 :])
    return sorted(w for w in out - {word} if len(w) <= LONGEST)


def fit(texts: list[bytes], y: np.ndarray, totals: dict[int, int]) -> tuple[list[str], np.ndarray, float, Evidence, np.ndarray]:
    """Landmarks, weights by landmark, bias, what margins tell, and the calibration of a text's evidence: slope (never below 0) and constant."""
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    none = Evidence(np.zeros(0), np.zeros(0))
    flat = np.array([0.0, np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0])
    if len(set(y)) < 2:
        return [], np.zeros(0), 0.0, none, flat * 0
    spelt: dict[bytes, tuple[str, ...]] = {}
    bags: list[set[str]] = []
    for t in texts:
        words = set(t.split())
        spelt |= {w: tuple(stretches(w)) for w in words if w not in spelt}
        bags.append({s for w in words for s in spelt[w] if len(s) >= 2})
    found = _markers(bags, y)
    if not found:
        return [], np.zeros(0), 0.0, none, flat
    marked = _apart(found, MARKED)
    in_clean = Counter(w for bag, label in zip(bags, y, strict=True) if not label for w in bag)
    vocabulary = sorted(set(in_clean) | set(found) | {w for bag in bags for w in bag})
    surest = set(found)
    nearest = Landmarks(marked).kernel(vocabulary).max(axis=1)
    usual = sorted((-in_clean[w] * float(k) ** 0.5, w) for w, k in zip(vocabulary, nearest, strict=True) if k and in_clean[w] and w not in surest)
    marks = Landmarks(marked + [w for _, w in usual[:PLAIN]])
    values = marks.kernel(vocabulary)
    some = np.flatnonzero(values.any(axis=1))
    at, values = {vocabulary[i]: k for k, i in enumerate(some)}, values[some].astype(float)
    clean = np.array([in_clean[vocabulary[i]] for i in some], float)
    pairs, vectors = np.linalg.eigh(marks.kernel(marks.words).astype(float) + 1e-3 * np.eye(len(marks.words)))
    root = vectors @ np.diag(np.maximum(pairs, 1e-3) ** -0.5) @ vectors.T
    z = np.hstack([values @ root, np.ones((len(values), 1))])
    toxic = [[at[s] for s in {s for w in sentence.split() for s in spelt.get(w) or stretches(w)} if s in at] for t, label in zip(texts, y, strict=True) if label for sentence in re.split(rb"[.!?;:\n]", t)]
    rank = {at[w]: r for r, w in enumerate(found) if w in at}
    first = Counter(min(ks, key=lambda k: rank.get(k, len(found))) for ks in toxic if any(k in rank for k in ks))
    other = [ks for ks in toxic if ks and not any(k in rank for k in ks)]
    witness = first
    alphabet = "".join(sorted(set("".join(found))))
    spelling = {w: [v for v in altered(w, alphabet) if v not in in_clean] for w in found if w in at and first[at[w]]}
    more = [v for vs in spelling.values() for v in vs]
    z_more = np.hstack([marks.kernel(more).astype(float) @ root, np.ones((len(more), 1))])
    mass_more = np.array([first[at[w]] ** 0.5 / len(vs) for w, vs in spelling.items() for _ in vs])
    for _ in range(2):
        bad = np.zeros(len(z))
        for k, n in witness.items():
            bad[k] = n**0.5
        use = np.concatenate([np.flatnonzero(clean), np.flatnonzero(bad)])
        signs = np.concatenate([-np.ones(int((clean > 0).sum())), np.ones(int((bad > 0).sum()) + len(more))])
        mass = np.concatenate([np.sqrt(clean[clean > 0]), bad[bad > 0], mass_more])
        mass *= len(signs) * np.where(signs > 0, 2 / mass[signs > 0].sum(), CLEAN / max(mass[signs < 0].sum(), 1e-9))
        w = squared_hinge(np.vstack([z[use], z_more]), signs, mass)
        margin = z @ w
        witness = first + Counter(k for ks in other if margin[k := max(ks, key=lambda j: margin[j])] > 0)
    weight, bias = root @ w[:-1], float(w[-1])
    reader = Reader(marks, weight, bias)
    sentences = list(reader.sentences(texts))
    evidence = Evidence.of(sentences, y, [m for m in reader.margins(more) if m is not None])
    cut = [[max(s)] if s else s for s, label in zip(sentences, y, strict=True) if label]  # to its worst sentence, a toxic document is toxic still
    x = np.array([[evidence(s)] for s in [*sentences, *cut]])
    importance = np.where(y == 1, totals[1] / (2 * len(cut)), totals[0] / (y == 0).sum())
    importance = np.append(importance, importance[y == 1])
    slope, constant = logistic(x, np.append(y, np.ones(len(cut))), importance / importance.mean())
    return marks.words, weight, bias, evidence, np.array([slope, constant]) if slope > 0 else flat


def _worker_reader(words: list[str], weight: np.ndarray, bias: float) -> Reader:
    """One reader for a worker process, which outlives a task."""
    home = sys.modules.setdefault("_tessera_toxicity", types.ModuleType("_tessera_toxicity"))
    key = (tuple(words), weight.tobytes(), bias)
    if getattr(home, "key", None) != key:
        home.key, home.reader = key, Reader(Landmarks(words), weight, bias)
    return home.reader


def _scores(model) -> Callable:  # noqa: ANN001 (a broadcast)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, bias, evidence, c = model.value
        reader = _worker_reader(words, weight, bias) if words else None
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            x = np.array([evidence(s) for s in reader.sentences(texts)] if reader else [0.0] * len(texts))
            score = 1 / (1 + np.exp(-np.clip(c[0] * x + c[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    sample, totals = labelled_sample(docs, labels, label, fold(F.col(id_col), folds) != held_out, most, id_col, text_col)
    rows = sorted((r.id, r.y, r.text or "") for r in sample.collect())  # ``most`` rows at most
    model = fit([t.encode() for _, _, t in rows], np.array([y for _, y, _ in rows], int), totals)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(shared), "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
