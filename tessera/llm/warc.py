"""WARC archives: writing pages as segmented, chunk-framed records, and reassembling them.

Writing. A page becomes a response record whose block is an HTTP message in chunked transfer framing. A block longer
than ``SEGMENT`` bytes is cut: the first part is the response record (segment 1), the others are continuation records
that name the first one's identifier as their origin, and the last states the total length. A payload of ``LEAST`` bytes
or more that an earlier identifier has too becomes a revisit record without payload. Spark's text writer puts the
records' bytes into compressed files of at most ``RECORDS`` records, hence of bounded size.

Reading. Files are read whole, unzipped and cut into records as a stream. Records without segments are decoded where
they stand. Segments are shuffled by their origin's identifier, put in order by number, checked for gaps and for the
total length, joined and decoded; a group is one payload, which is one row anyway. Revisits are joined to what they refer to by narrow rows, dealt over ``SALTS`` copies, as a third of all
records may refer to one.

Null payloads count as empty, null or empty urls are written as ``URN``, line breaks in urls as spaces. Rows that repeat
both the payload and the identifier that stands for it are all responses, the others refer to the one with the least url;
a row without identifier is preferred to none that has one. A record's identifier follows from identifier, url and
payload, so rows that repeat all three are written, and come back, as equal records. Payloads of any length are taken
whole. An empty table gives empty archives. Other columns do not matter.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, tidy

LEAST = 100
#: Bytes of a segment's block, of a chunk, and records of a file at most.
SEGMENT, CHUNK, RECORDS = 1 << 16, 1 << 13, 4096
SALTS = 8
#: Stands for a missing url, as the target of a record is mandatory.
URN = "urn:unknown"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, target_uri string, source_id long, refers_to_record string, origin string, segment int, total long, stated_digest string, payload binary, intact boolean"
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("source_id", pa.int64()), ("refers_to_record", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("stated_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])


def framed(payload: bytes, size: int = CHUNK) -> bytes:
    """``payload`` in chunked transfer framing."""
    chunks = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in chunks) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body, whose chunks may have extensions and whose end may have trailers; None if it is cut or malformed."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";", 1)[0].strip() if line >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(size, 16), line + 2
        if not n:
            return b"".join(out) if body.endswith(b"\r\n\r\n" if body[at : at + 2] != b"\r\n" else b"\r\n") else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message, its transfer framing undone; None if the message is cut."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return unframed(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _record(kind: str, record_id: str, block: bytes, fields: dict) -> bytes:
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None).encode() + b"\r\n" + block


def record_name(source: int | None, url: str | None, digest: str) -> str:
    """The identifier of a page's record."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{source} {digest} {url}'.encode()).digest()[:16], version=5)}"


def page_records(source: int | None, url: str | None, payload: bytes, digest: str, first: tuple | None, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a page. ``first``: identifier and url of the page that it revisits."""
    own = record_name(source, url, digest)
    about = {"WARC-Target-URI": " ".join((url or URN).splitlines()), "WARC-Source-ID": source, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first:
        yield _record("revisit", own, _REVISIT, {**about, "WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{record_name(*first, digest)}>", "Content-Type": "application/http; msgtype=response"})
        return
    block = _HTTP + framed(payload, chunk)
    http = "application/http; msgtype=response"
    if len(block) <= segment:
        yield _record("response", own, block, {**about, "Content-Type": http})
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record("response", own, parts[0], {**about, "Content-Type": http, "WARC-Segment-Number": 1})
    for k, part in enumerate(parts[1:], 2):
        end = len(block) if k == len(parts) else None
        yield _record("continuation", f"{own}:{k}", part, {"WARC-Target-URI": about["WARC-Target-URI"], "WARC-Segment-Origin-ID": f"<{own}>", "WARC-Segment-Number": k, "WARC-Segment-Total-Length": end})


def _pages_to_records(segment: int, chunk: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, volume = [], 0
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "sha", "first_id", "first_url")), strict=True):
                for record in page_records(*r[:2], r[2] or b"", r[3], None if r[4] is None else r[4:], segment, chunk):
                    held.append(record)
                    volume += len(record)
                    if volume > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, volume = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    return step


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """A record per row of ``pages`` (several for a long payload), as compressed archives in ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    alike = rows.where((F.length("payload") >= least) & F.col("id").isNotNull()).groupBy("sha").agg(F.min(F.struct("id", "url")).alias("first"))
    firsts = alike.select("sha", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = rows.select("id", "url", "payload", "sha", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")).join(firsts, ["sha", "salt"], "left")
    again = again.withColumn("first_id", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    # a revisit's payload is not written, so it is not handed to the worker either
    marked = again.select("id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"), "sha", "first_id", "first_url")
    records = bounded(marked).mapInArrow(tidy(_pages_to_records(segment, chunk)), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def cut_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes | None]]:
    """Header fields (lower-case names) and block of each record; the block is None where the file ends before it."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields.get("content-length", 0))
        block = stream.read(n)
        yield fields, block if len(block) == n else None


def _decoded(block: bytes | None, stated: str | None) -> tuple[bytes | None, bool]:
    payload = None if block is None else payload_of(block)
    return payload, payload is not None and (stated is None or hashlib.sha256(payload).hexdigest() == stated)


def _files_to_records(segments: bool):
    """The records of whole files: those in segments, with their blocks as they are, or all others, decoded."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, volume = [], 0
            for content in b.column(0):
                data = content.as_buffer()
                stream = io.BytesIO(data)
                for f, block in cut_records(gzip.GzipFile(fileobj=stream) if bytes(data[:2]) == b"\x1f\x8b" else stream):
                    number, kind = f.get("warc-segment-number"), f.get("warc-type")
                    if (number is not None) != segments or kind not in ("response", "resource", "revisit", "continuation"):
                        continue
                    name, origin = f["warc-record-id"].strip("<>"), f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>")
                    stated = f.get("warc-payload-digest", "")
                    stated = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
                    if segments:
                        payload, intact = block, block is not None
                    elif kind == "revisit":
                        payload, intact = None, block is not None
                    else:
                        payload, intact = _decoded(block, stated) if kind == "response" else (block, block is not None)
                    total = f.get("warc-segment-total-length")
                    source = f.get("warc-source-id")
                    rows.append((name, kind, f.get("warc-target-uri"), None if source is None else int(source), f.get("warc-refers-to", "").strip("<>") or None, origin, int(number) if segments else None, None if total is None else int(total), stated, payload, intact))
                    volume += len(payload or b"") + 256
                    if volume > 1 << 22:
                        yield packed(rows)
                        rows, volume = [], 0
            if rows:
                yield packed(rows)

    return step


def _reassembled(parts: pa.Table) -> pa.Table:
    """One record from the segments of one origin; not intact where a segment is missing or the total length differs. Equal records written k times come back k times."""
    rows = parts.to_pylist()
    by_number = {r["segment"]: r for r in rows}
    ordered = [by_number[k] for k in sorted(by_number)]
    head, last = ordered[0], ordered[-1]
    whole = ordered[0]["segment"] == 1 and last["segment"] == len(ordered) and all(r["intact"] for r in ordered)
    block = b"".join(r["payload"] for r in ordered) if whole and last["total"] is not None else None
    if block is not None and len(block) != last["total"]:
        block = None
    payload, intact = _decoded(block, head["stated_digest"])
    copies = sum(r["segment"] == head["segment"] for r in rows)
    return pa.Table.from_pylist([head | {"record_id": head["origin"], "segment": None, "total": last["total"], "payload": payload, "intact": intact}] * copies, schema=_RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource and revisit of the archives in ``path`` (plain or gzip, one member or one a record), segments reassembled.

    ``payload`` is null where it is cut, incomplete or wrongly framed, and for revisits; ``intact`` says that it is whole
    and has the digest that the record states. A file is held by one task in its compressed form.
    """
    files = bounded(spark.read.format("binaryFile").load(path)).select("content")
    single = files.mapInArrow(tidy(_files_to_records(False)), RECORD)
    parts = files.mapInArrow(tidy(_files_to_records(True)), RECORD)
    return single.unionByName(parts.groupBy("origin").applyInArrow(_reassembled, RECORD)).drop("origin", "segment")


def resolved(records: DataFrame) -> DataFrame:
    """A narrow row per record: source_id, payload_bytes, payload_digest, record_type, refers_to (the source of what a revisit refers to), intact."""
    narrow = records.select("record_id", "record_type", "source_id", "refers_to_record", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "intact")
    own = narrow.where("record_type <> 'revisit'")
    asked = narrow.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    targets = own.join(asked, "record_id", "left_semi").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to_record"), F.col("source_id").alias("refers_to"), "payload_bytes", "payload_digest", F.col("intact").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    again = narrow.where("record_type = 'revisit'").select("record_type", "source_id", "refers_to_record", "intact", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt"))
    again = again.join(targets, ["refers_to_record", "salt"], "left")
    columns = ["source_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    again = again.withColumn("intact", F.col("intact") & F.coalesce("whole", F.lit(False)))
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(again.select(columns))


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back: one narrow row per page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, **options)
    return resolved(read_warc(spark, path)).withColumnRenamed("source_id", id_col)
