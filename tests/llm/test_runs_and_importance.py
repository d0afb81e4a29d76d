"""Periodic runs and importance resampling against versions by hand."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import importance as I
from tessera.llm import periodic_runs as R

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words, least=24, times=3):
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)  # smaller periods come first
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, letters = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 6, 40])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            at, p = rng.randrange(n), rng.randint(1, 20)
            base = words[at : at + p]
            for i in range(rng.randint(1, 80)):
                if at + i < n:
                    words[at + i] = base[i % len(base)]
    return words


def test_runs_equal_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(1500):
        words, least = periodic_words(rng), rng.choice([24, 24, 8, 1])
        want = runs_by_hand(words, least)
        seen += len(want)
        assert R.find_runs(np.array(words, np.int32), least) == want, words
    assert seen > 1000


def test_runs_over_several_blocks(monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 16)
    monkeypatch.setattr(R, "CHUNK", 1)
    rng = random.Random(6)
    for _ in range(300):
        words = periodic_words(rng)
        assert R.find_runs(np.array(words, np.int32)) == runs_by_hand(words)


def planted_by_hand(doc_id, text):
    words = WORD.findall(text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests_by_hand(doc_id, text):
    words = planted_by_hand(doc_id, text)
    runs = runs_by_hand(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_on_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{x}é" for x in periodic_words(rng))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\t\n "), (203, "a b " * 30), (204, "x\x0by\x0cz\r\nx " * 20), (205, "one"), (None, "a b c " * 20), (None, None), rows[3], rows[3], (3, "again " * 40)]
    d = spark.createDataFrame(rows, SCHEMA)
    wide = d.select("*", *(F.lit(1).alias(c) for c in ("id", "runs", "best", "collapsed", "n_words", "__x")))
    got = [tuple(r) for r in R.run_digests(R.periodic_runs(R.planted(wide))).collect()]
    assert sorted(map(str, got)) == sorted(str(digests_by_hand(*r)) for r in rows)
    assert sum(r[1] > 0 for r in got) > 30
    assert R.run_digests(R.periodic_runs(R.planted(d.limit(0)))).count() == 0


def test_runs_of_a_long_text(spark):
    base = [f"u{i}" for i in range(70_000)]
    text = " ".join(base + [f"v{i % 50_000}" for i in range(200_000)] + ["z"] * 100_000)
    (got,) = R.periodic_runs(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert [tuple(r) for r in got.runs] == [(70_000, 200_000, 50_000), (270_000, 100_000, 1)] and got.n_words == 370_000
    assert got.collapsed.split() == base + [f"v{i}" for i in range(50_000)] + ["z"]


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def drawn_by_hand(docs, target, buckets, most, percent=25, least=20, seed=7):
    count = lambda texts: Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, most)[1])
    s, t = count([x for _, x in docs]), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        n, own = features(text, most)
        weight = sum(gain(crc32(f.encode()) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def some_documents():
    rng = random.Random(9)
    words = [rng.choice(["Ta", "lo", "mi-", "rén", "7"]) + str(rng.randrange(40)) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, range(1, 301), k=rng.choice([3, 19, 20, 25, 90, 300])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?? !!"), (203, "the " * 4000), (None, docs[4][1]), (None, None), docs[5], docs[5], (5, docs[6][1])]
    return docs, [" ".join(rng.choices(words, range(300, 0, -1), k=60)) for _ in range(20)] + [None, ""]


def test_importance_equals_brute_force(spark, monkeypatch):
    docs, target = some_documents()
    d, t = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(x,) for x in target], "text string")
    wide = d.repartition(3).select("*", *(F.lit("x").alias(c) for c in ("id", "bucket", "n", "range", "salt", "batch", "weight", "score", "part", "rank")))
    for buckets, most, cell in ((10_000, 2, I.CELL), (97, 3, 200), (5, 1, 50)):
        monkeypatch.setattr(I, "CELL", cell)
        got = [tuple(r) for r in I.importance_resample(wide, t, buckets=buckets, most=most).collect()]
        assert sorted(map(str, got)) == sorted(map(str, drawn_by_hand(docs, target, buckets, most))), buckets


def test_importance_without_rows(spark):
    docs, _ = some_documents()
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "text string")
    assert sorted(str(tuple(r)) for r in I.importance_resample(d, none).collect()) == sorted(map(str, drawn_by_hand(docs, [], 10_000, 2)))
    assert I.importance_resample(d.limit(0), none).count() == 0
