"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tessera.llm import jaccard_join
from tessera.llm.components import components
from tessera.llm.exact_dedup import exact_dedup, exact_groups
from tessera.llm.jaccard_join import Forest, jaccard_components, near_dedup, search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return (t or "").encode().lower()


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", None, 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def some_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = [None, "", "  \n ", "ÀB", "àB", "Ab cd", "aB cd", "ab  cd"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            b = list(base)
            for _ in range(rng.randint(0, 3)):
                b[rng.randrange(len(b))] = rng.choice(words)
            out.append(" ".join(b) if rng.random() < 0.8 else " \t".join(b).upper())
    out += ["hot text " * 40] * 300 + [" ".join(words * 400)] * 2
    return out


@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups_equal_brute_force(spark, keep):
    texts = some_texts()
    got = {r.doc_id: r for r in exact_groups(docs(spark, texts).repartition(7), keep=keep).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    pick = min if keep == "min" else max
    for i, t in enumerate(texts):
        g, r = groups[lower(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (pick(g), len(g), pick(g) == i, hashlib.sha256(lower(t)).hexdigest())


def test_exact_dedup_keeps_rows_whole(spark):
    texts = some_texts()
    kept = exact_dedup(docs(spark, texts).repartition(5), keep="max")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {lower(t): i for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in want.values()}


def test_exact_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "x", 1, 2), (None, "X", 1, 2), (3, "x", 1, 2), (3, "x", 1, 2), (None, "y", 1, 2)], "doc_id long, text string, sha int, keep_id int")
    rows = exact_groups(odd).collect()
    assert sorted(r.group_size for r in rows) == [1, 4, 4, 4, 4] and sum(r.kept for r in rows) == 2
    assert exact_dedup(odd).count() == 2


def shingle_set(t, k=5):
    w = lower(t).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_components_equal_brute_force(spark):
    texts = some_texts(2)[:-300] + some_texts(3)[:60]
    group, size = brute(texts)
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts).repartition(3)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == group
    assert [got[i].n_shingles for i in range(len(texts))] == size
    kept = {r.doc_id for r in near_dedup(docs(spark, texts)).collect()}
    assert kept == set(group)


def test_large_block_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(150):  # each a few words away from the base, so not all link with each other
        b = list(base)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = f"x{i}{rng.random()}"
        texts.append(" ".join(b))
    group, _ = brute(texts)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == group


def test_large_block_without_links_is_sent_by_strips(spark, monkeypatch):
    """Texts that share all they are made of, and hardly any link: a leaf travels once a strip, not once a leaf."""
    rng = random.Random(5)
    parts = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(40)]
    texts = [" ".join(rng.sample(parts, 4)) for _ in range(480)]
    texts += [f"{t} end{i}" for i, t in enumerate(texts[::60])]
    group, _ = brute(texts)
    rows = {}

    def counted(df, label, staged=jaccard_join.staged):
        out = staged(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    for tokens, strips in ((500_000, 2), (15_000, 5)):
        monkeypatch.setattr(jaccard_join, "STRIP_TOKENS", tokens, raising=False)
        got = {r.doc_id: r.component_id for r in jaccard_components(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == group
        assert 8 < rows["jaccard-leaves"] and rows["jaccard-rest"] <= (rows["jaccard-leaves"] + strips) * strips


def test_jaccard_edge_cases(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = jaccard_components(docs(spark, ["a b", "A  B", None, "a", None], [5, 4, None, 2, 9])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(5, 1, 4), (4, 1, 4), (None, 0, None), (2, 1, 2), (9, 0, 9)}


def test_tree_search_finds_all_components():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = rng.choice(pool, rng.integers(1, 300), replace=False)
        sets.append(np.unique(s))
        for _ in range(rng.integers(0, 4)):
            keep = s[rng.random(len(s)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, max(1, len(s) // 20))])))
    forest = Forest(len(sets))
    search(sets, forest)
    up = Forest(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
            up.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [up.root(i) for i in range(len(sets))]


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 1)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[3] == got[20] == 1 and got[9] == 6 and {got[i] for i in range(100, 140)} == {100} and {got[i] for i in range(200, 241)} == {200}
