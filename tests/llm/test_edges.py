"""Every operator and stage on odd tables: clashing names, null identifiers, repeated rows, no rows, a very long text."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.bpe import encode, tokenizer_path
from tessera.llm.exact_dedup import exact_dedup, exact_groups
from tessera.llm.html_extract import extract
from tessera.llm.jaccard_join import jaccard_components, near_dedup
from tessera.llm.mixing import mix, mix_counts
from tessera.llm.quality import keep_good, quality_scores
from tessera.llm.repetition import repetition
from tessera.llm.suffix_repeats import drop_repeats, repeated_spans
from tessera.llm.toxicity import toxicity_scores
from tessera.llm.url_filter import url_filter

#: Names that the operators use for columns of their own.
CLASHING = ["id", "h", "row", "rest", "gone", "gone_id", "size", "text_", "whole", "score", "node", "label", "doc", "key", "lo", "hi", "sha", "head", "edge", "keep_id", "kept", "run", "word", "words", "src", "target", "taken", "rank", "most", "y", "at", "n", "digest", "tile", "ranges", "held_out", "a.b"]


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *(F.lit(7).alias(c) for c in CLASHING))


def rows():
    rng = random.Random(1)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren"]) for _ in range(3)) for _ in range(60)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))), "en", rng.choice(["a", "b", None]), 1) for i in range(40)]
    out += [out[3], out[3], (3, "another text under the same identifier, long enough", "en", "a", 1)]
    out += [(None, out[5][1], None, None, None), (None, None, None, None, None), (None, "", "en", "a", 0), (50, None, "en", "b", None), (51, "\t \n", "en", "a", 3)]
    return [*out, (60, " ".join(f"w{i}" for i in range(1_000_000)), "en", "a", 1)]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


BY_ROW = {
    "mix_counts": lambda d, lab: mix_counts(d),
    "repetition": lambda d, lab: repetition(d),
    "toxicity": toxicity_scores,
    "quality": quality_scores,
    "exact_groups": lambda d, lab: exact_groups(d),
    "jaccard_components": lambda d, lab: jaccard_components(d),
    "encode": lambda d, lab: encode(d, tokenizer_path()),
}
OTHER = {"mix": lambda d, lab: mix(d), "keep_good": keep_good, "exact_dedup": lambda d, lab: exact_dedup(d), "near_dedup": lambda d, lab: near_dedup(d), "drop_repeats": lambda d, lab: drop_repeats(d), "repeated_spans": lambda d, lab: repeated_spans(d)}


@pytest.mark.parametrize("name", [*BY_ROW, *OTHER])
def test_documents(spark, name):
    step = (BY_ROW | OTHER)[name]
    given = rows()
    d, lab = table(spark, given), labels(spark)
    got = step(d, lab).collect()
    plain = step(d.drop(*(f"`{c}`" if "." in c else c for c in CLASHING)), lab).collect()
    if name in BY_ROW:
        assert sorted(map(str, got)) == sorted(map(str, plain)) and len(got) == len(given)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in given)
    elif name != "repeated_spans":
        assert step(d, lab).columns == d.columns and len(got) == len(plain)
        assert all(r["gone"] == r["a.b"] == 7 for r in got)
        assert {(r.doc_id, r.lang, r.source, r.n_chars) for r in got} <= {(r[0], *r[2:]) for r in given}
    assert step(d.limit(0), lab).count() == 0


def test_several_texts_under_one_identifier(spark):
    base = [f"b{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["tail"])
    d = table(spark, [(1, " ".join(base), "en", "a", 1), (5, near, "en", "a", 1), (5, " ".join(f"u{i}" for i in range(60)), "en", "a", 1), (None, near, "en", "a", 1)])
    assert sorted((r.doc_id or 0, r.text[:2]) for r in near_dedup(d).collect()) == [(0, "b0"), (1, "b0"), (5, "u0")]


@pytest.mark.parametrize("step", [extract, url_filter])
def test_pages(spark, step):
    page = "<p>" + "some words of the article, and more of them " * 3 + "</p>"
    given = [(1, "http://ads.example.com/x", page), (1, "http://ads.example.com/x", page), (None, None, None), (2, "", ""), (3, "http://" + "a" * 3000 + ".b/" + "c/" * 3000, "<div>" * 5000 + "deep" + "</p>" * 9 + "x" * 1_000_000)]
    d = spark.createDataFrame(given, "page_id long, url string, html string")
    wide = d.select("*", *(F.lit(7).alias(c) for c in [*CLASHING, "host", "path", "rule", "ruled", "tokens", "text", "p", "told"]))
    got = sorted(map(str, step(wide).collect()))
    assert got == sorted(map(str, step(d).collect())) and len(got) == len(given)
    assert step(wide.limit(0)).count() == 0
