"""URL filters: rules by host and path, and for the rest a naive Bayes verdict on segmented names.

Runs of letters in host and path are cut into words by a unigram Viterbi pass. The unigram counts are those of all words
of all pages; of these, each distinct run is joined with the words that occur in it, so nothing is cut to a most
frequent part and no vocabulary leaves Spark's tables. A multinomial naive Bayes model scores the words.

It learns from the URLs that the rules decide, and from a few labelled phrases. What a rule decides by is no evidence: the last
labels of the host and the first segments of the path, as many as any rule names, are left out when learning. A word
counts once a host and class, and a URL is scored without what its own host has taught: whether another path of its
host meets a rule does not change its verdict. Words without any evidence, single letters and repetitions within a name
weigh nothing. Log-odds equal to the margin allow. Only letters a to z are read: a name in another script, and what is
left of it in a coded host (xn--...), gives few words or none, and without evidence it is allowed.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Hosts and paths of any length
are read whole. Repeated rows are judged one by one; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, staged

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled phrases; each of their words is worth PHRASE_WEIGHT hosts, in however many phrases it stands, so one of them alone does not reach the margin.
PHRASES = {
    "block": ("ads track", "adult x", "ads click banner", "tracker pixel ads", "porn xxx", "adult video x", "casino bet win", "cheap pills", "spam ads", "malware download", "phishing login", "sex cam adult", "gambling slots", "affiliate ads track", "poker bets jackpot", "viagra pharmacy pills", "escort dating hookup", "warez crack torrent", "free bets bonus", "link farm spam"),
    "allow": ("news article", "school science", "library book", "forum help", "docs guide", "museum history", "health research", "weather report", "data page html"),
}
PHRASE_WEIGHT = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that are no names.
PLAIN = frozenset({"http", "https", "html", "com"})


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, summed up before the shuffle."""
    seen: Counter = Counter()

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for b in batches:
        for x in b.column(0).cast(pa.binary()).to_pylist():
            seen.update(re.findall(rb"[a-z]+", (x or b"").lower()))
        if len(seen) > 500_000:
            yield packed()
    yield packed()


def best_words(run: str, cost: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest cut of a run, of equal ones that whose last words are longest; a letter that is no word stands alone at the cost ``unknown``."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for (start, end), c in cost.items():
        ends.setdefault(end, []).append((start, c))
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        words = sorted(ends.get(end, ()))
        if (end - 1, end) not in cost:
            words.append((end - 1, unknown))
        for start, c in words:
            if best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _parts(lengths: list[int]) -> Callable:
    """Every part of a run that is as long as some word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str]] = []

        def packed() -> pa.RecordBatch:
            runs, starts, words = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(starts, pa.int64()), pa.array(words, pa.string())], names=["run", "start", "word"])

        for b in batches:
            for r in b.column(0).to_pylist():
                for n in lengths:
                    for s in range(len(r) - n + 1):
                        out.append((r, s, r[s : s + n]))
                        if len(out) >= 20_000:
                            yield packed()
        if out:
            yield packed()

    return run


def _cut(total: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cost = {(x["start"], x["start"] + x["size"]): math.log(total / x["n"]) for x in found or ()}
                out.append(best_words(r, cost, 2 + math.log(total)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return run


def word_counts(texts: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """(word, n) of one text column; the words of the phrases count as a hundredth of the commonest word at least."""
    counts = staged(bounded(texts).mapInArrow(_page_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    most = counts.agg(F.max("n")).first()[0] or 1
    own = texts.sparkSession.createDataFrame([(w, max(1, most // 100)) for w in sorted({w for ps in phrases.values() for p in ps for w in p.split()})], "word string, n long")
    return counts.unionByName(own).groupBy("word").agg(F.max("n").alias("n"))


def segments(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs."""
    totals = counts.groupBy(F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()  # a row per word length
    total = sum(r.n for r in totals) + 1
    parts = runs.mapInArrow(_parts(sorted(r["size"] for r in totals)), "run string, start long, word string")
    # a run's own parts, so no more than its letters allow
    known = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("start", F.length("word").alias("size"), "n")).alias("found"))
    return runs.join(known, "run", "left").select("run", "found").mapInArrow(_cut(total), "run string, words array<string>")


def url_filter(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html", margin: float = 2.0) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, tokens, log_odds (of block)."""
    spark = pages.sparkSession
    skip = sorted(frozenset(re.findall(r"[a-z]+", " ".join(h + p for _, h, p in rules))) | PLAIN)
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    steps = max((p.count("/") - 1 for _, _, p in rules), default=0)
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "ruled": verdict})

    # distinct names, their runs of letters, and those among them that no rule looks at
    names = urls.select("host", "path", "ruled").distinct()
    inner_host = F.regexp_replace("host", rf"(^|\.)[^.]*(\.[^.]*){{0,{max(0, labels - 1)}}}$", "") if labels else F.col("host")
    inner_path = F.regexp_replace("path", rf"^(/[^/]*){{0,{steps}}}", "")
    names = names.select("host", "path", "ruled", letter_runs(F.concat_ws(" ", "host", "path")).alias("runs"), letter_runs(F.concat_ws(" ", inner_host, inner_path)).alias("inner"))
    names = staged(names, "url-names")
    runs = names.select(F.explode("runs").alias("run")).distinct().where(~F.col("run").isin(skip))
    cut = staged(segments(runs, word_counts(pages.select(F.col(f"`{text_col or url_col}`").cast("string").alias("text")))), "url-runs")

    # words by host and class: a host counts once
    taught = names.where("ruled IS NOT NULL").select("host", "ruled", F.explode("inner").alias("run")).distinct()
    taught = taught.join(cut, "run").select("host", "ruled", F.explode("words").alias("word")).distinct()
    own = staged(taught.groupBy("host", "word").agg(F.count(F.when(F.col("ruled") == "block", 1)).alias("own_block"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("own_allow")), "url-evidence")
    said = sorted({(w, v) for v, ps in PHRASES.items() for p in ps for w in p.split() if len(w) > 1})
    phrases = spark.createDataFrame([(w, PHRASE_WEIGHT * (v == "block"), PHRASE_WEIGHT * (v == "allow")) for w, v in said], "word string, block long, allow long")
    counts = own.groupBy("word").agg(F.sum("own_block").alias("block"), F.sum("own_allow").alias("allow")).unionByName(phrases).groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counts = staged(counts, "url-counts")
    by_host = own.groupBy("host").agg(F.sum("own_block").alias("host_block"), F.sum("own_allow").alias("host_allow"))
    all_block, all_allow = counts.agg(F.sum("block"), F.sum("allow")).first()
    size = cut.select(F.explode("words").alias("word")).unionByName(phrases.select("word")).distinct().count()  # of the vocabulary

    words = names.select("host", "path", F.posexplode("runs").alias("at", "run")).join(cut, "run").select("host", "path", "at", F.posexplode("words").alias("place", "word"))
    words = words.join(counts, "word", "left").join(own, ["host", "word"], "left").join(by_host, "host", "left")
    block, allow, host_block, host_allow = (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)) for a, b in (("block", "own_block"), ("allow", "own_allow"), (F.lit(all_block), "host_block"), (F.lit(all_allow), "host_allow")))
    odds = F.log((block + 1) / (host_block + size)) - F.log((allow + 1) / (host_allow + size))
    # a word counts once a name, as it does once a host in what is taught; a single letter, as a coded or cut name is full of, is no evidence
    again = F.row_number().over(Window.partitionBy("host", "path", "word").orderBy("at", "place")) > 1
    words = words.withColumn("odds", F.when((block + allow > 0) & (F.length("word") > 1) & ~again, odds).otherwise(0.0))
    place = F.struct("at", "place", "word", "odds")
    scored = words.groupBy("host", "path").agg(F.array_sort(F.collect_list(place)).alias("told"))  # the words of one name
    told = scored.select(F.col("host").alias("h"), F.col("path").alias("p"), F.array_join("told.word", " ").alias("tokens"), F.aggregate("told.odds", F.lit(0.0), lambda a, x: a + x).alias("log_odds"))
    judged = urls.join(told, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    log_odds = F.coalesce("log_odds", F.lit(0.0))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(log_odds > margin, "block").otherwise("allow")).alias("verdict"), F.coalesce("tokens", F.lit("")).alias("tokens"), log_odds.alias("log_odds"))
