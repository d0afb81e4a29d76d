"""Repeated passages against brute force over all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.suffix_repeats import COLUMNS, drop_repeats, repeated_spans, scan

SCHEMA = "doc_id long, text string, key string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def brute(rows, least):
    """{(doc, start, end, n_words, n_later)} and the texts' words without later copies."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    where = {}
    for d, w in words:
        for s in range(len(w) - least + 1):
            where.setdefault(tuple(w[s : s + least]), []).append((d, s))
    spans, left = set(), {}
    for d, w in words:
        hit, late = [False] * len(w), [False] * len(w)
        for s in range(len(w) - least + 1):
            places = where[tuple(w[s : s + least])]
            if len({x for x, _ in places}) > 1:
                for k in range(s, s + least):
                    hit[k] = True
                    late[k] |= min(places) != (d, s)
        # windows that only touch make one passage, as they leave no word between them
        at = 0
        while at < len(w):
            end = at
            while end < len(w) and hit[end]:
                end += 1
            if end > at:
                spans.add((d, at, end, end - at, sum(late[at:end])))
            at = max(end, at + 1)
        left[d] = [x for x, gone in zip(w, late) if not gone]
    return spans, left


def corpus(seed, least):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [some(rng.choice([least - 1, least, least + 1, 2 * least, 4 * least])) for _ in range(8)]
    texts = [None, "", " \n", " ".join(some(least - 1)), "same " * 300, "same " * 200, " ".join(some(3000))]
    for i in range(70):
        body = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            a = rng.randint(0, max(0, len(piece) - least)) if rng.random() < 0.5 else 0
            body += piece[a:] + some(rng.randint(0, 30))
        texts.append((" " if i % 3 else "\t\n").join(body).upper() if i % 4 == 0 else " ".join(body))
    alone = some(2 * least)
    texts.append(" ".join(alone + some(5) + alone))  # repeats in itself only
    base = some(3 * least)
    for i in range(40):
        near = list(base)
        near[rng.randrange(len(near))] = f"x{i}"
        texts.append(" ".join(near))
    return texts + [" ".join(base)] * 50


@pytest.mark.parametrize(("seed", "least"), [(1, 50), (2, 30), (3, 12)])
def test_spans_equal_brute_force(spark, seed, least):
    texts = corpus(seed, least)
    want, left = brute(list(enumerate(texts)), least)
    got = {tuple(r) for r in repeated_spans(docs(spark, texts).repartition(6), min_words=least).collect()}
    assert got == want and len(want) > 60
    cut = {r.doc_id: r for r in drop_repeats(docs(spark, texts).repartition(5), min_words=least).collect()}
    assert {d: (r.text or "").encode().lower().split() for d, r in cut.items()} == left
    assert cut[0].text is None and cut[1].text == "" and cut[6].text == texts[6]


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_spans(empty).count() == 0 and drop_repeats(empty).count() == 0
    passage = " ".join(f"p{i}" for i in range(55))
    rows = docs(spark, [passage, passage, passage, "x " + passage, "À é"], [3, 3, None, None, 9])
    assert {tuple(r) for r in repeated_spans(rows).collect()} == {(3, 0, 55, 55, 0), (None, 0, 55, 55, 55), (None, 1, 56, 55, 55)}
    assert sorted((r.doc_id or 0, r.text) for r in drop_repeats(rows).collect()) == [(0, ""), (0, "x "), (3, passage), (3, passage), (9, "À é")]
    assert drop_repeats(rows).columns == ["doc_id", "text", "key", "n_chars"]
    alone = docs(spark, [passage, passage, passage + " y", None, None], [3, 3, 3, None, None])  # one document, three times
    assert repeated_spans(alone).count() == 0 and sorted(r.text or "" for r in drop_repeats(alone).collect()) == ["", "", passage, passage, passage + " y"]


def test_positions_of_one_row_leave_others_of_its_identifier_alone(spark):
    unique = " ".join(f"u{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = docs(spark, [passage, passage, unique, unique + " z", passage[:-1] + "x"], [1, 5, 5, None, None])
    got = sorted((r.doc_id or 0, r.text) for r in drop_repeats(rows).collect())
    assert got == sorted([(1, passage), (5, ""), (5, unique), (0, "z"), (0, passage.split()[-1][:-1] + "x")])
    spans = {tuple(r) for r in repeated_spans(rows).collect()}
    assert spans == {(1, 0, 120, 120, 0), (5, 0, 120, 120, 120), (5, 0, 200, 200, 0), (None, 0, 200, 200, 200), (None, 0, 119, 119, 119)}


def test_repeated_and_missing_identifiers_equal_brute_force(spark):
    texts = corpus(5, 20)
    rng = random.Random(6)
    ids = [rng.choice([None, i, i, i // 4]) for i in range(len(texts))]
    whose = {}  # a row's document: its identifier, or else its text
    for k, (i, t) in enumerate(zip(ids, texts)):
        whose[k] = ("id", i) if i is not None else ("text", t)
    words = [(t or "").encode().lower().split() for t in texts]
    where = {}
    for k, w in enumerate(words):
        for s in range(len(w) - 19):
            where.setdefault(tuple(w[s : s + 20]), set()).add(whose[k])
    want = set()
    for k, w in enumerate(words):
        hit = {s + x for s in range(len(w) - 19) if len(where[tuple(w[s : s + 20])]) > 1 for x in range(20)}
        want |= {(ids[k], s, e) for s in hit if s - 1 not in hit for e in [next(x for x in range(s, len(w) + 1) if x not in hit)]}
    rows = docs(spark, texts, ids).repartition(5)
    assert {tuple(r)[:3] for r in repeated_spans(rows, min_words=20).collect()} == want
    left = [r.text for r in drop_repeats(rows, min_words=20).collect()]
    assert len(left) == len(texts) and {x for t in left for x in (t or "").lower().split()} == {x.decode() for w in words for x in w}


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 1000])
def test_scan_does_not_depend_on_batches(batch):
    rng = np.random.default_rng(batch)
    rows = rng.integers(0, [12, 3, 4, 2, 3, 1, 1], (400, 7), np.int64)
    rows[:150, :2] = [4, 1]  # a hot run
    rows = rows[np.lexsort(rows.T[::-1])]
    names = COLUMNS
    parts = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + batch, k]) for k in range(7)], names=names) for i in range(0, len(rows), batch)]
    got = pa.Table.from_batches(scan(iter(parts))).to_pandas()
    docs_of = lambda *k: {tuple(r[list(k)]): set() for r in rows}
    by_key, by_run = docs_of(0), docs_of(0, 1)
    for r in rows:
        by_key[(r[0],)].add(r[2])
        by_run[(r[0], r[1])].add(r[2])
    assert len(got) == len(rows) - sum(len(by_key[(r[0],)]) == 1 and r[0] not in (rows[0, 0], rows[-1, 0]) for r in rows)
    assert (got.key_multi == [len(by_key[(k,)]) > 1 for k in got.key]).all()
    assert (got.multi == [len(by_run[k]) > 1 for k in zip(got.key, got.reach)]).all()
    head = got.groupby(["key", "reach"])[["doc", "row", "lo"]].transform("first")
    assert (got.later == (head != got[["doc", "row", "lo"]]).any(axis=1)).all()
    assert got.key_edge.iloc[0] and got.edge.iloc[0] and got.key_edge.iloc[-1] and got.edge.iloc[-1]
