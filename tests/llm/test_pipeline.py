"""The pipeline against a version that does every stage by hand on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sel", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        junk = i % 5 == 0
        text = " ".join(rng.choice(words) + ("&&&" if junk else "") for _ in range(rng.randint(40, 120)))
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(not junk), 0))
    copy, near = rows[1][1].upper(), rows[2][1] + " tail"
    rows += [(240, copy, "en", "src1", 1), (241, near, "en", "src2", 1), (242, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in range(240) if i % 5} | {240, 241}
    assert good <= set(seen["quality"]) and not set(seen["quality"]) & {i for i in range(240) if i % 5 == 0}
    assert set(seen["quality"]) - set(seen["exact"]) == {1}  # the copy with the larger identifier stays
    assert set(seen["exact"]) - set(seen["near"]) == {241}
    assert set(seen["mix"]) <= set(seen["near"]) and max(map(seen["mix"].count, seen["mix"])) <= 2
    assert sorted(seen["mix"]) == sorted(seen["encode"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted(seen["encode"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Clashing names, null and repeated identifiers, empty and long texts, labels with columns of their own, no rows."""
    from pyspark.sql import functions as F
    from test_edges import CLASHING, labels, rows

    lab = labels(spark).select("*", *(F.lit(5).alias(c) for c in [*CLASHING, "text", "source", "lang"] if c not in ("y",)))
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    short = [r for r in rows() if r[1] is None or len(r[1]) < 100_000] + [(61, "word " * 30_000, "en", "a", 1)]
    plain = spark.createDataFrame(short, "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.select("*", *(F.lit(7).alias(c) for c in CLASHING))
    bare = lambda d: sorted(str((r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r in d.collect())
    for name, stage in corpus_pipeline.STAGES:
        got, alone = stage(spark, wide, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0, name
        if name == "encode":
            assert sorted(map(str, got.collect())) == sorted(map(str, alone.collect())) and got.count() == len(short)
            continue
        assert got.columns == wide.columns and alone.columns == plain.columns, name
        if name == "mix":  # rows of one identifier are told apart by where they lie, so only the words taken are compared
            words = lambda d: {s: sum(len(r.text.split()) for r in d.collect() if r.source == s) for s in ("a", "b", None)}
            assert words(got).keys() == words(alone).keys() and all(r.text and r.text.split() for r in got.collect())
        else:
            assert bare(got) == bare(alone), name
        given = [str(tuple(r)) for r in short]
        assert set(bare(got)) <= set(given) and all(r["gone"] == r["a.b"] == 7 for r in got.collect()), name
    none = spark.createDataFrame([], lab.schema)
    none.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert bare(corpus_pipeline.STAGES[0][1](spark, wide, f"{tmp_path}/none")) == sorted(map(str, map(tuple, short)))


def test_components_of_odd_edges(spark):
    from tessera.llm.components import components

    edges = spark.createDataFrame([(1, 2, 9), (2, 1, 9), (2, 3, 9), (1, 2, 9), (7, 7, 9), (None, 5, 9), (6, None, 9), (11, 10, 9)], "u long, v long, label long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)]
    assert components(edges.limit(0)).count() == 0


def test_run_equals_stages_by_hand(spark, tmp_path):
    import hashlib
    import struct
    from collections import Counter

    from tokenizers import Tokenizer

    from tessera.llm.bpe import tokenizer_path
    from test_exact_and_near import brute, lower
    from test_text_operators import WORD, brute_targets

    rng = random.Random(29)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sel", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(150):
        junk = i % 4 == 0
        text = " ".join(rng.choice(words) + ("&&&" if junk else "") for _ in range(rng.choice([30, 60, 120, 300])))
        rows.append([text, f"src{i % 3}" if i % 7 else None])
        labels.append((i, int(not junk), 0))
    for _ in range(60):  # exact copies, near copies and copies of these
        text, source = rng.choice(rows)
        part = text.split(" ")
        part[rng.randrange(len(part))] = "changed"
        rows.append([rng.choice([text, text.title(), " ".join(part), f"{text} and more"]), source])
    docs = [(i, t, "en", s, 1) for i, (t, s) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    good = [d for d in docs if "&&&" not in d[1]]  # what the labels teach
    last = {}
    for d in good:
        last[lower(d[1])] = d  # the largest identifier of equal texts
    left = sorted(last.values())
    groups, _ = brute([d[1] for d in left])
    left = [d for i, d in enumerate(left) if groups[i] == i]
    assert 40 < len(left) < len(good) - 20

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    encoded = {}
    for i, text, *_ in left:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        encoded[i] = (i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    assert set(got) <= set(encoded.values())  # each row is a whole document that the stages keep

    size = {i: len(WORD.findall(text)) for i, text, *_ in left}
    source = {d[0]: d[3] for d in left}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    totals = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    for s, target in zip(names, brute_targets(totals, [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True):
        longest = max(n for i, n in size.items() if source[i] == s)
        words_ = sum(k * size[r[0]] for r, k in got.items() if source[r[0]] == s)
        assert abs(words_ - target) <= longest / 2 + 1
        plays = [got[encoded[i]] for i in size if source[i] == s]
        assert max(plays) - min(plays) <= 1  # in turn, none twice before all once
