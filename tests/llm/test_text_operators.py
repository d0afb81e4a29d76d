"""Repetition, URLs, mixing, encoding, extraction and the classifiers: brute force, exact round trips, held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import mixing as M
from tessera.llm import toxicity as X
from tessera.llm.bpe import TrieBpe, encode, tokenizer_path
from tessera.llm import html_extract as H
from tessera.llm.html_extract import extract, main_text, min_cut
from tessera.llm.mixing import mix, mix_counts
from tessera.llm.quality import keep_good, quality_scores
from tessera.llm.repetition import repetition
from tessera.llm.toxicity import letters, toxicity_scores
from tessera.llm import url_filter as U
from tessera.llm.url_filter import best_words, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], 1) for i, t in enumerate(texts)], SCHEMA)


def odd_texts():
    rng = random.Random(8)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(40)]
    out = [None, "", " \n\t", "one", "a\x0bb\x0cc", "non breaking", "x\r\nx\r\nx", "Und " * 50, "# * $ & | < > %"]
    out += [" ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 60, 300]))) for _ in range(30)]
    out += ["\n".join(rng.choice(["same line here", "other", "", "  "]) for _ in range(12)), " ".join(rng.choice(words) for _ in range(30000))]
    return out


def base_counts(t):
    words = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_repetition_counts(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in repetition(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t), t
        assert not (r.base_failed and r.kept)
    assert repetition(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got[len(texts) - 1].kept  # long and without repeats


def test_url_rules_and_names(spark):
    rows = [(0, None), (1, "no scheme/x"), (2, "http://A.Example.NET/en/1?x=/de/"), (3, "https://a.example.net/de/1"), (4, "http://example.com/de/"), (5, "http://notexample.com/de/1"), (6, "http://x.org/fr/9#f"), (7, "http://net"), (8, "http://ads-track.example.com/en/1"), (9, "http://museumhistory.example.com/en/1"), (10, "a://b?c")]
    pages = spark.createDataFrame([(i, u, "<p>museum history ads track</p>") for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow") == (got[1].host, got[1].path, got[1].rule, got[1].verdict)
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[3].rule, got[3].verdict, got[4].rule, got[5].rule, got[6].rule, got[7].rule) == ("net/", "block", "example.com/de/", None, "org/fr/", None)
    assert (got[8].verdict, got[9].verdict, got[9].tokens.split()[:2], got[10].host) == ("block", "allow", ["museum", "history"], "b")
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_segmentation_is_the_best_of_all():
    counts = {"ab": 5, "abc": 2, "c": 3, "d": 1, "cd": 4, "a": 1}
    total = sum(counts.values()) + 1
    price = {w: math.log(total / n) for w, n in counts.items()}
    unknown = 2 + math.log(total)

    def all_cuts(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in counts or k == 1:
                yield from ([s[:k], *rest] for rest in all_cuts(s[k:]))

    cost = lambda ws: sum(price.get(w, unknown) for w in ws)
    for run in ("abcd", "abcabcd", "zzabz", "a", ""):
        found = best_words(run, {(i, j): price[run[i:j]] for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in price}, unknown)
        assert abs(cost(found) - min(map(cost, all_cuts(run)))) < 1e-9 and "".join(found) == run


PAGES = "page_id long, url string, html string"


def some_urls():
    rng = random.Random(4)
    names = ["museumhistory", "casinowin", "greenriver", "riverhistory", "ads-track", "green", "x" * 40 + "river"]
    out = [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(names)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.choice(['river', 'green-deal', '77', ''])}" for _ in range(150)]
    return [*out, out[0], None, "", "no scheme", "http://" + "longrun" * 2000 + ".com/en/"]


def test_url_verdicts_equal_brute_force(spark):
    urls, html = some_urls(), "<p>museum history casino win green river deal river green ads track</p>"
    got = {r.page_id: r for r in url_filter(spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], PAGES).repartition(3)).collect()}
    skip = {"net", "example", "en", "com", "de", "org", "fr", "http", "https", "html"}
    counts = Counter(w for _ in urls for w in re.findall("[a-z]+", html))
    for ps in U.PHRASES.values():
        for w in " ".join(ps).split():
            counts[w] = max(counts[w], max(1, 2 * len(urls) // 100))
    total = sum(counts.values()) + 1

    def cut(text):
        out = []
        for run in re.findall("[a-z]+", text.lower()):
            if run not in skip:
                places = {(i, i + len(w)): math.log(total / n) for w, n in counts.items() for i in range(len(run)) if run.startswith(w, i)}
                out += best_words(run, places, 2 + math.log(total))
        return out

    taught, vocabulary = {}, {w for r in got.values() for w in cut(f"{r.host} {r.path}")}
    vocabulary |= {w for ps in U.PHRASES.values() for p in ps for w in p.split() if len(w) > 1}
    for r in got.values():
        if r.rule:
            for w in cut(".".join(r.host.split(".")[:-2]) + " " + "/".join(r.path.split("/")[2:])):
                taught.setdefault((w, r.verdict), set()).add(r.host)
    said = Counter({(w, v): 1 for v, ps in U.PHRASES.items() for p in ps for w in p.split() if len(w) > 1})

    def times(w, v, host):
        return U.PHRASE_WEIGHT * said[w, v] + len(taught.get((w, v), set()) - {host})

    judged = Counter()
    for r in got.values():
        size = {v: len(vocabulary) + sum(times(w, v, r.host) for w in vocabulary) for v in ("block", "allow")}
        words = cut(f"{r.host} {r.path}")
        odds = sum(math.log((times(w, "block", r.host) + 1) / size["block"]) - math.log((times(w, "allow", r.host) + 1) / size["allow"]) for w in sorted(set(words)) if len(w) > 1 and times(w, "block", r.host) + times(w, "allow", r.host))
        assert r.tokens.split() == words and abs(r.log_odds - odds) < 1e-6, r
        if r.rule is None:
            judged[r.verdict] += 1
            assert r.verdict == ("block" if odds > 2 else "allow")
    assert min(judged["block"], judged["allow"]) > 3 and len(got) == len(urls)


def test_verdict_does_not_depend_on_other_paths_of_its_host(spark):
    urls = some_urls()
    clean = "http://blog.greenriver.example.com/en/1"
    rows = [(i, u, "<p>green river blog</p>") for i, u in enumerate([clean, *urls])]
    more = rows + [(1000 + i, f"http://blog.greenriver.example.com/de/green-{i}", "<p>green river blog</p>") for i in range(60)]
    one, two = ([(r.verdict, r.rule) for r in url_filter(spark.createDataFrame(x, PAGES)).where("page_id = 0").collect()] for x in (rows, more))
    assert one == two == [("allow", None)]


def test_one_word_of_a_phrase_does_not_block(spark):
    clean = ["essex-sex-education", "middlesex-county-hotels-cheap-flights", "banner-university", "winter-slots-schedule", "adult-learning", "dating-fossils", "xn--80ak6aa92e"]
    bad = ["casino-win", "ads-track", "cheap-pills", "casinobetwin", "poker-jackpot"]
    html = "<p>" + " ".join(clean).replace("-", " ") + " of the and history school county hotels flights learning museum river</p>"
    urls = [f"http://{h}.example.com/en/1" for h in clean + bad] + ["http://x.com/pharmacy-guide", "http://example.net:80/en/x"]
    got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame([(i, u, html) for i, u in enumerate([*urls, *(x for x in some_urls() if x and "casino" not in x and "ads" not in x)])], PAGES)).collect()}
    n = len(clean)
    assert [got[i] for i in range(n)] == ["allow"] * n and [got[i] for i in range(n, n + len(bad))] == ["block"] * len(bad)
    assert got[n + len(bad)] == "allow"


def brute_targets(sizes, weights):
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, 1.5 * sum(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > 2 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def test_mix_counts(spark):
    rng = random.Random(3)
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(300)] + [None, "x " * 3000]
    sources = [rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None]) for _ in texts]
    sources[-1] = "tiny"
    got = sorted(mix_counts(docs(spark, texts, sources)).collect())
    again = sorted(mix_counts(docs(spark, texts, sources).repartition(9)).collect())
    assert got == again and len(got) == len(texts)
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, brute_targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    taken = Counter()
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == size[sources[r.doc_id]] and abs(r.target - want[sources[r.doc_id]]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    words = sum(len(WORD.findall(r.text or "")) for r in mix(docs(spark, texts, sources)).collect())
    assert abs(words - sum(want.values())) <= len(names)
    assert mix_counts(spark.createDataFrame([], SCHEMA)).count() == 0 and mix(docs(spark, [None, ""])).count() == 0


def test_mix_of_whole_documents(spark):
    rng = random.Random(5)
    texts = [f"t{i} " + " ".join("w" for _ in range(rng.choice([0, 3, 40, 400]))) for i in range(200)] + [None, "", "x " * 3000]
    sources = [rng.choice(["hot"] * 6 + ["a", "b", None]) for _ in texts]
    table = docs(spark, texts, sources)
    taken = {r.doc_id: (r.taken, r.size, r.target, r.source) for r in mix_counts(table).collect()}
    got = Counter((r.doc_id, r.text) for r in mix(table, whole=True).collect())
    assert all(texts[i] == t for i, t in got)  # no text is cut
    assert {i: n for (i, _), n in got.items()} == {i: n for i, (k, size, _, _) in taken.items() if size and (n := (2 * k + size) // (2 * size))}
    longest = {s: max(size for _, size, _, x in taken.values() if x == s) for s in set(sources)}
    words = Counter()
    for (i, _), n in got.items():
        words[sources[i]] += n * taken[i][1]
    for _, _, target, s in taken.values():
        assert abs(words[s] - target) <= longest[s] / 2 + 1
    assert mix(docs(spark, [None, ""]), whole=True).count() == 0 and mix(spark.createDataFrame([], SCHEMA), whole=True).count() == 0


def test_schedule_counts_in_closed_form():
    points = M._radical(np.arange(3000))
    bounds = [0, 1 << 60, 3 << 61, 1 << 63, (1 << 64) - 1, 1 << 64]
    for n in (0, 1, 7, 64, 1000, 3000):
        assert M.counts_before(n, bounds) == [sum(int(p) < b for p in points[:n]) for b in bounds]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    library, own = tokenizers.Tokenizer.from_file(path), TrieBpe(open(path).read())
    rng = random.Random(2)
    texts = ["", "it's DON'T we'll x9y 12", "a<|endoftext|>b <|STARTOFTEXT|>", "café café ΑΣ ßİ 😀😀 \x1c\x85z 你好123", "!!!!??", "z" * 3000, "a b c"]
    texts += ["".join(rng.choice("abcdehilnorstuz éß'0!-") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    odd = ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", " ", "\xa0", "\x1c", "\x85", "\u0301", "é", "É", "😀", "你", "'S", "1", "²", "½", "İ", "ı", "ſ", "ß", "Σ", "ς", "the", "ing", "ŉ", "\u200b", "|", "<", "!", "€", "…", "ª", "\n", "\x00", "\x7f", "ǅ", "ﬁ", "क्", "ｆ", "x" * 40]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(1000)]
    for text, (code, decoded) in zip(texts, own.encode_batch([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(code, "<u4")) == want and decoded.decode() == library.decode(want, skip_special_tokens=False) == own.decode(want)
    rows = encode(docs(spark, [None, "", "hello world"]), path, keep_ids=True).collect()
    assert [r.n_tokens for r in sorted(rows)] == [0, 0, len(library.encode("hello world", add_special_tokens=False).ids)]
    assert encode(spark.createDataFrame([], SCHEMA), path).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>A slogan of the site</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><div class="cookie-notice">We use cookies, please accept all of them now.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph of the text,
with <b>bold</b> words and some length to it.<p>Short.<div class="advert">Buy this now for a very low price today</div><p>Last paragraph with a <a href=x>link</a> inside of it.</p>
<section id=comments><p>I did like this article a lot, thank you for it.</p></section></article>
<aside>Most read stories of this week, a list of many words here</aside><form><label>Your mail</label></form><script>var t="</p>";</script><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\nFirst paragraph of the text, with bold words and some length to it.\nShort.\nLast paragraph with a link inside of it."
    assert main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "v", "<p>" + "many words here " * 20000), (5, "w", "<div"), (6, "x", "&lt;plain text without any tag but with enough words&gt;")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == got[3].text == "" and got[4].n_chars == len("many words here " * 20000) - 1
    assert got[6].text.startswith("<plain") and extract(spark.createDataFrame([], pages.schema)).count() == 0


def test_text_after_elements_left_out():
    rest = "This is the article and it has enough words to be kept as the main text of the page."
    for before in ('<svg-icon name="x"></svg-icon>', "<button-group>", "<title-bar>", "<svg/>", '<math class="a" />', "<button>", "<select>", "<iframe src=x>", "<button><p>Open</p><button>Menu</button>", "<svg><title/></svg>", "<svg><path/></svg>", "<svg><svg></svg><text>drawn words</text></svg>"):
        got = main_text(f"{before}<p>{rest}</p>").split("\n")
        assert got[-1] == rest and not {"Menu", "drawn words"} & set(got), before
        got = main_text(f"<p>{rest}</p>{before}<p>{rest}</p><button>Menu</button><svg></svg>").split("\n")
        assert got[0] == got[-1] == rest, before
    for before in ("<script>", "<style>", "<title>", "<textarea>", "<noscript>", "<object>"):
        hidden = before.replace("<", "</")
        assert main_text(f"{before}<p>{rest} Hidden.</p>{hidden}<p>{rest}</p>") == rest
    assert main_text(f"<p>{rest}</p><script>var a = '<p>{rest}</p>'") == rest


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(1, 8)
        a, b = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 3)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda keep: sum(b[i] if keep[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(min_cut(a, b, edges)) - best) < 1e-6


LONG = "This is a paragraph of the article and it has enough words to be kept as its text."


def test_the_cut_decides():
    # a short block goes with what stands around it, and a mark reaches the blocks below it through edges
    assert main_text(f"<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>") == f"{LONG}\nShort.\n{LONG}"
    assert main_text(f"<p>Short.</p><nav><p>{LONG}</p></nav>") == ""
    # boilerplate without a mark beside marked content
    assert main_text(f"<article><h1>A title</h1><p>{LONG}</p></article><div>&copy; 2024 The Company, all rights reserved everywhere</div><div><a href=/a>One</a> <a href=/b>Two</a></div>") == f"A title\n{LONG}"
    assert main_text(f"<article><h1><a href=x>A linked title</a></h1><p>{LONG}</p><ul><li><a href=/1>Related one</a><li><a href=/2>Related two</a></ul></article>") == f"A linked title\n{LONG}"
    # words of a layout are no marks, and marks inside an article are
    assert main_text(f"<div class='layout with-sidebar'><article><p>{LONG}</p><div class=promo><p>{LONG} Buy it.</p></div><p>{LONG}</p></article></div>") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p><section class=comments><article><p>{LONG} I say.</p></article><article><p>{LONG} So do I.</p></article></section></article>") == LONG


HAN = "这是一篇没有任何标记的文章,它的段落足够长,应当被视为正文内容而保留下来,不应当被丢弃。"


def test_context_overrules_words_and_scripts():
    p = f"<p>{LONG}</p>"
    # doubtful names, and names that another name contradicts
    for name in ("social-studies-lesson", "widget-area article", "post-footer-wrapper-content", "entry alert-news"):
        assert main_text(f"<div class='{name}'>{p * 3}</div>") == f"{LONG}\n{LONG}\n{LONG}", name
        assert main_text(f"<article>{p}</article><div class='{name}'><a href=/>Link</a> <a href=/b>Link</a></div>") == LONG, name
    # clear names, at any place in the page
    for name in ("ad", "post sponsored", "related-posts", "comment-content", "postFooter", "cookie-banner"):
        assert main_text(f"<div>{p}</div><div class='{name}'>{p}</div><div>{p}</div>") == f"{LONG}\n{LONG}", name
    # no mark at all
    assert main_text(f"<body>{p}<div>&copy; 2024 Company</div><div><a href=/>Home</a></div><div><a href=/a>About us</a></div></body>") == LONG
    assert main_text(f"<body><p>{HAN}</p><div>{HAN}</div></body>") == f"{HAN}\n{HAN}" and main_text(f"<div>{HAN}</div>") == HAN
    # short cells stay with their article; an unmarked notice beside it goes, a first heading stays
    cells = "".join(f"<tr><td>Row {i}</td><td>{i}</td></tr>" for i in range(20))
    rows = "\n".join(f"Row {i}\n{i}" for i in range(20))
    assert main_text(f"<article><h1>Table of things</h1><table>{cells}</table></article>") == f"Table of things\n{rows}"
    assert main_text(f"<article>{p}<table>{cells}</table>{p}</article>") == f"{LONG}\n{rows}\n{LONG}"
    assert main_text(f"<h1>A title</h1><article>{p}{p}</article><div>Buy this now for a very low price.</div>") == f"A title\n{LONG}\n{LONG}"


def test_cut_of_whole_pages_is_minimal():
    rng = random.Random(3)
    moved = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "article", "nav", "div class=ad", "section", "aside"])
            inner = "".join(f"<p>{'<a>' * (rng.random() < 0.3)}{' '.join(['word'] * rng.choice([1, 4, 20]))}</a></p>" for _ in range(rng.randint(1, 2)))
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        cut, marks = H.blocks("".join(parts))
        texts = ["".join(b.text) for b in cut]
        own = [H.evidence(x, b.linked) for b, x in zip(cut, texts)]
        weight, edges = H.page_graph([b.path for b in cut], own, marks)
        n = len(weight)
        cost = lambda keep: sum(-min(w, 0) if k else max(w, 0) for w, k in zip(weight, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        got = min_cut([max(0.0, w) for w in weight], [max(0.0, -w) for w in weight], edges)
        if n <= 14:
            assert abs(cost(got) - min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))) < 1e-6
        moved += sum(k != (w > 0) for k, w in zip(got, own))
    assert moved > 20


def labelled(spark):
    rng = random.Random(9)
    clean = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sel"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    texts, toxic, quality = [], [], []
    for i in range(500):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumpfog", "vexwort", "zankbub", "grump-fog", "ve.xwort"])
        texts.append(". ".join(" ".join(w + "$$" if junk else w for w in words[k : k + 8]) for k in range(0, len(words), 8)))
        toxic.append(int(bad))
        quality.append(int(not junk))
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in range(500)], "doc_id long, quality int, toxic int")
    return docs(spark, [*texts, None, ""]), labels, toxic, quality


def test_classifiers_on_held_out_rows(spark):
    d, labels, toxic, quality = labelled(spark)
    for got, truth in ((toxicity_scores(d, labels), toxic), (quality_scores(d, labels), quality)):
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows) == 502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
        held = [r for r in rows.values() if r.held_out and r.doc_id < 500]
        assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = {r.doc_id for r in keep_good(d, labels).collect()}
    assert np.mean([(i in kept) == bool(quality[i]) for i in range(500)]) > 0.95
    none = labels.where("1 = 0")
    assert {r.score for r in quality_scores(d, none).collect()} == {0.5} == {r.score for r in toxicity_scores(d, none).collect()}
    assert quality_scores(d.where("1 = 0"), labels).count() == 0


def test_held_out_fold_is_crc32(spark):
    import zlib

    d, labels, *_ = labelled(spark)
    for r in toxicity_scores(d, labels).select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_words_of_any_length_and_script():
    rng = random.Random(5)
    clean = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 3))) for parts in (["ta", "lo", "mi", "ren", "sel"], ["та", "ло", "ми", "рен", "сел"]) for _ in range(150)]
    bad = ["грубиян", "vexwort", "zankbub"]
    texts = [" ".join([*rng.sample(clean, 30), *([bad[i % 3]] if i % 2 else [])]).encode() for i in range(400)]
    words, weight, bias, *_ = X.fit(texts, np.array([i % 2 for i in range(400)]), {0: 200, 1: 200})
    reader = X.Reader(X.Landmarks(words), weight, bias)
    long = "talomirenseltalorenmi" * 8
    cases = ["грубиян", f"{long}_vexwort", f"{long}vexwort{long}", f"{long}\u200bvexwort", f"{'/'.join([long] * 3)}-zankbub.{long}", " ".join(long[:40]) + " " + " ".join("vexwort")]
    found = list(reader.sentences([t.encode() for t in cases]))
    for t, x in zip(cases, found, strict=True):
        assert x and max(x) > 0, t
    assert all(m <= 0 for x in reader.sentences([long.encode(), texts[0]]) for m in x)
    assert letters("ПРИВЕТ".encode()) == "привет" and letters("λόγος".encode()) == "λογος" and letters("क्या".encode()) and letters("你好吗".encode()) == "你好吗"


def test_one_insult_or_its_altered_spelling_is_enough():
    rng = random.Random(8)
    clean = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sel", "grum", "ort"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    bad = ["grumpfog", "vexwort", "zankbub", "quisling"]
    texts = [". ".join(" ".join([*rng.sample(clean, 8), *([rng.choice(bad)] if i % 4 == 0 and k < 2 else [])]) for k in range(6)).encode() for i in range(600)]
    y = np.array([int(i % 4 == 0) for i in range(600)])
    words, weight, bias, evidence, (slope, constant) = X.fit(texts, y, {0: 450, 1: 150})
    reader = X.Reader(X.Landmarks(words), weight, bias)
    toxic = lambda t: slope * evidence(next(reader.sentences([t]))) + constant >= 0
    fresh = [" ".join(rng.sample(clean, 40)).encode() for _ in range(100)]
    assert slope > 0 and sum(map(toxic, fresh)) <= 1 and all(toxic(fresh[0] + b" " + w.encode()) for w in bad)
    wide = [w[:i] + c + w[i:] for w in bad for i in range(1, len(w)) for c in "xq*"]
    assert np.mean([toxic(fresh[1] + b" " + w.encode()) for w in wide]) >= 0.9
    # a sentence more never makes a text less toxic
    assert (np.diff(evidence.gain) >= 0).all() and (evidence.gain >= 0).all()
    for t in [*texts[:40], *fresh[:20]]:
        assert evidence(next(reader.sentences([t + b". " + wide[0].encode() + b"."]))) >= evidence(next(reader.sentences([t])))


def test_steps_of_evidence_and_spellings():
    got = X.Evidence.of([[0.1, 0.9], [0.1, 0.1, 0.5], [0.9]], np.array([1, 0, 1]))
    brute = [np.log((b + 0.5 / 3) / (g + 0.5 / 3)) for b, g in ((1 / 3, 1.0), (2 / 3, 0.0))]  # 0.1 and 0.5 pool, 0.9 stands alone
    assert got.cut.tolist() == [0.1, 0.9] and np.allclose(got.gain, np.maximum(brute, 0))
    assert got([]) == 0 and got([-1.0]) == 0 and np.isclose(got([0.9, 0.9, 0.2]), 2 * brute[1])
    assert X.Evidence.of([[], []], np.array([0, 1]))([3.0]) == 0
    out = set(X.altered("idiot", "xyz"))
    assert {"idiiot", "idot", "idiott"} <= out and "idiot" not in out and len({len(w) for w in out}) == 4 - 1
    words = [f"{'ab' if i % 2 else 'kl'}{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)}" for i in range(40)]
    assert X._apart([*["grumpfog"] * 30, *words], 5) == ["grumpfog", *words[:4]]  # looks past the first 8 * most


def test_string_kernel_equals_its_definition():
    def kernel(s, t):
        def features(w):
            w = "^" + w
            out = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + X.SPAN)):
                        out[w[i] + w[j] + w[k]] += X.DECAY ** (k - i + 1) * (X.EDGE if i == 0 else 1.0)
            return out

        a, b = features(s), features(t)
        return sum(a[x] * b[x] for x in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    words = ["idiot", "idiiot", "idxiot", "losère", "stupid", "tion", "abc"]
    got = X.Landmarks(words).kernel(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            want = kernel(s, t)
            assert abs(got[i, j] - (want**X.POWER if want >= X.CLOSE else 0)) < 1e-4
    assert letters(b"1d.i-0T!!") == "idiot" and letters("ÎÑz".encode()) == "îñz" and letters(b"123") == ""
