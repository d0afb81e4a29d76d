"""Verdicts on repetition and fits of the classifiers against plain restatements."""

import random
import re
from collections import Counter

import numpy as np

from tessera.llm.repetition import repetition
from tessera.llm.training import dual_coordinate_descent, labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, words int"


def verdict(text):
    """The rules word by word: whether repetition rejects a text, base rule included."""
    words = WORD.findall(text or "")
    n, chars = len(words), sum(map(len, words))
    if n < 10:
        return False
    grams = lambda g: [tuple(words[i : i + g]) for i in range(n - g + 1)]
    five = Counter(grams(5))
    inside = {i + k for i, x in enumerate(grams(5)) if five[x] > 1 for k in range(5)}
    if 100 * len(inside) > 20 * n:
        return False
    lines, seen, again, again_chars = 0, set(), 0, 0
    for line in text.split("\n"):
        found = WORD.findall(line)
        lines += bool(found)
        if found and line in seen:
            again, again_chars = again + 1, again_chars + sum(map(len, found))
        seen.add(line)
    if 100 * again > 30 * lines or 100 * again_chars > 20 * chars:
        return False
    for g, most in ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)):
        met, hit = set(), set()
        for i, x in enumerate(grams(g)):
            if x in met:
                hit |= set(range(i, i + g))
            met.add(x)
        if 100 * sum(len(words[i]) for i in hit) > most * chars:
            return False
    for g, most in ((2, 20), (3, 18), (4, 16)) if n >= 100 else ():
        for x, k in Counter(grams(g)).items():
            if k > 1 and 100 * k * sum(map(len, x)) > most * chars:
                return False
    return True


def repeating_texts(seed):
    rng = random.Random(seed)
    words = [rng.choice("bcdlmnrst") + rng.choice("aeioué") * rng.randint(1, 6) + str(i) for i in range(500)]
    out = [None, "", "one two", " ".join(words[:9]), " ".join(words[:10])]
    for _ in range(160):
        text = [rng.choice(words) for _ in range(rng.choice([12, 40, 99, 100, 130, 400]))]
        kind = rng.randrange(5)
        if kind == 1:  # a passage again
            k = rng.randint(5, 30)
            text += text[:k]
        elif kind == 2:  # a frequent pair, triple or quadruple
            part = [rng.choice(words) for _ in range(rng.randint(2, 4))]
            for _ in range(rng.randint(2, max(3, len(text) // 8))):
                at = rng.randrange(len(text))
                text[at:at] = part
        joined = " ".join(text)
        if kind in (3, 4):  # lines again
            line = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
            parts = joined.split(" ")
            for _ in range(rng.randint(1, 12)):
                parts.insert(rng.randrange(len(parts)), f"\n{line}\n")
            joined = " ".join(parts) if kind == 3 else " ".join(parts).replace(" \n", "\n").replace("\n ", "\n")
        out.append(joined)
    return out


def test_verdict_equals_the_rules_word_by_word(spark):
    texts = repeating_texts(1) + repeating_texts(2)
    got = {r.doc_id: r.kept for r in repetition(spark.createDataFrame(list(zip(range(len(texts)), texts, [1] * len(texts))), SCHEMA)).collect()}
    want = {i: verdict(t) for i, t in enumerate(texts)}
    assert got == want
    assert 60 < sum(want.values()) < len(texts) - 60  # both verdicts are met


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 12)) * (rng.random((40, 12)) < 0.5)
    y = np.where(x @ rng.normal(size=12) + 0.5 * rng.normal(size=40) > 0, 1, -1)
    cost = np.where(y > 0, 0.7, 1.3)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    step, alpha = 1 / np.linalg.eigvalsh(q).max(), np.zeros(40)
    for _ in range(50_000):  # projected gradient on the dual
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    best = (alpha * y) @ x
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    assert abs(primal(best) - (alpha.sum() - 0.5 * best @ best)) < 1e-6  # no gap: this is the optimum
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w = dual_coordinate_descent(rows, y, 12, cost, passes=2000)
    assert abs(primal(w) - primal(best)) < 1e-2 and np.abs(w - best).max() < 0.1
    w = dual_coordinate_descent([*rows, (np.zeros(0, int), np.zeros(0))], np.append(y, 1), 12, np.append(cost, 1.0), passes=2000)
    assert abs(primal(w) - primal(best)) < 1e-2  # a row without features changes nothing


def test_sample_is_the_same_however_rows_lie(spark):
    from pyspark.sql import functions as F

    rows = [(i % 50, f"text {i}", i) for i in range(200)] + [(None, "no identifier", 1), (7, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    one = lambda d: labelled_sample(d, labels, "quality", F.lit(True), 30)
    first, totals = one(docs)
    got = sorted(map(tuple, first.select("id", "text", "y").collect()))
    assert got == sorted(map(tuple, one(docs.repartition(7, "words"))[0].select("id", "text", "y").collect()))
    assert len(got) == 30 == len({i for i, _, _ in got}) and totals == {0: 25, 1: 25}
    assert all(text == min(f"text {k}" for k in range(i, 200, 50)) and y == i % 2 for i, text, y in got)
