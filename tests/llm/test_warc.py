"""Archives: round trips against a version by hand, segments, framing, and archives that are damaged or written by others."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W

PAGES = "page_id long, url string, html string"


def given():
    rng = random.Random(3)
    big = "".join(rng.choice("abcé \n\r中") for _ in range(40_000))
    out = [(i, f"http://a.b/{i}", f"<p>page {i % 7} " + "x" * (40 * (i % 7)) + "</p>") for i in range(60)]
    out += [(100, "http://a.b/long", big), (99, "http://a.b/long", big), (101, None, None), (102, "", ""), (103, "http://a.b/c\r\nX: y", "short"), (104, "u", "short")]
    out += [(105, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 5), (None, "u", big), (None, "u", None)]
    return out


def by_hand(rows, least=100):
    first: dict = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= least and first.get(b, i) != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None, True))
    return sorted(out, key=str)


def shown(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)


@pytest.mark.parametrize("segment, chunk", [(W.SEGMENT, W.CHUNK), (700, 64), (151, 7)])
def test_round_trip(spark, segment, chunk):
    rows = given()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    wide = pages.select("*", *(F.lit(7).alias(c) for c in ("row", "id", "sha", "salt", "payload", "first", "record", "origin", "n")))
    assert shown(W.archived(wide, segment=segment, chunk=chunk)) == by_hand(rows)


def test_texts_come_back(spark, tmp_path):
    rows = given()
    path = f"file://{tmp_path}/w"
    W.write_warc(spark.createDataFrame(rows, PAGES), path, segment=500, chunk=33)
    got = {(r.source_id, r.record_type): r for r in W.read_warc(spark, path).collect()}
    assert bytes(got[99, "response"].payload).decode() == rows[60][2] and got[100, "revisit"].payload is None
    assert got[103, "response"].target_uri == "http://a.b/c X: y" and got[101, "response"].target_uri == W.URN
    assert len(W.read_warc(spark, path).where("intact").collect()) == len(rows)


def test_repeated_rows_and_empty_table(spark):
    page = "same page " * 20
    rows = [(5, "u", page), (5, "u", page), (6, "u", page), (7, "u", "tiny"), (7, "u", "tiny")]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    got = [(r.page_id, r.record_type, r.refers_to) for r in W.archived(pages, segment=99, chunk=10).collect()]
    assert sorted(got, key=str) == [(5, "response", None), (5, "response", None), (6, "revisit", 5), (7, "response", None), (7, "response", None)]
    assert W.archived(pages.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "u", page), (None, "u", page)], PAGES)
    assert sorted((r.record_type, r.refers_to) for r in W.archived(lone).collect()) == [("response", None), ("response", None)]


def parts_of(text, segment=120, row=1):
    body = text.encode()
    return list(W.page_records(row, "http://a.b/", body, hashlib.sha256(body).hexdigest(), None, segment, 16))


def test_damaged_archives(spark, tmp_path):
    whole, lost, short, wrong, late = (parts_of(f"text {k} " * 40, row=k) for k in range(1, 6))
    assert len(whole) > 3
    del lost[2]
    short[-1] = short[-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 1")
    wrong[1] = wrong[1][:-2] + b"??"
    late.pop()
    rng = random.Random(1)
    records = [x for part in (whole, lost, short, wrong, late) for x in part]
    rng.shuffle(records)  # segments lie in any order, over several files
    for k in range(3):
        members = [gzip.compress(x + b"\r\n\r\n") for x in records[k::3]]  # one member a record
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(members))
    cut = parts_of("plain and cut " * 9, segment=10_000, row=9)[0]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(info + parts_of("plain", 10_000, 8)[0] + b"\r\n\r\n" + cut[:-4])
    got = {r.source_id: (r.intact, r.payload and bytes(r.payload)) for r in W.read_warc(spark, f"file://{tmp_path}").collect()}
    assert got[1] == (True, b"text 1 " * 40) and got[8] == (True, b"plain")
    assert all(not got[k][0] for k in (2, 3, 4, 5, 9)) and got[2][1] is None and got[3][1] is None and got[5][1] is None and got[9][1] is None


def test_framing():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 300):
        data = rng.randbytes(n)
        assert W.unframed(W.framed(data, 16)) == data
        assert all(W.unframed(W.framed(data, 16)[:k]) is None for k in range(len(W.framed(data, 16))))
    assert W.unframed(b"3;name=x\r\nabc\r\nA\r\n0123456789\r\n0\r\nExpires: now\r\n\r\n") == b"abc0123456789"
    assert W.unframed(b"3\r\nabcd\r\n0\r\n\r\n") is None and W.unframed(b"-3\r\nabc\r\n0\r\n\r\n") is None and W.unframed(b"") is None
    assert W.payload_of(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab" and W.payload_of(b"HTTP/1.1 200") is None
    with pytest.raises(ValueError):
        list(W.cut_records(io.BytesIO(b"no archive\r\n")))
