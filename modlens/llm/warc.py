"""WARC archives: writing with revisit records and segments, and reading them back.

Writing: each page is a record.  Of pages with equal payloads of at least REVISIT_BYTES the
one with the smallest page_id is a `response`, the others are `revisit` records that refer
to it.  One aggregate per payload digest gives the responses with their payloads (partial
results first, so a payload that makes up a third of all pages moves once from each task);
revisits come from page ids and digests alone.  Names of records follow from page_id, digest
and url, and the number among equal rows, so a task that runs again gives the same ones.
HTTP bodies are sent in chunks, and a block longer than SEGMENT_BYTES goes on in
`continuation` records.  Files are gzip text written by Spark, of MAX_RECORDS each: as
continuations are records too, a file unpacks to some 33 MB at most.

Reading: files are parsed record by record as they are unpacked; continuation records are
grouped by their origin's identifier, put in the order of their segment numbers and checked
against the total length; then the chunked framing is taken off.  A record whose segments or
chunks are not whole comes out with complete = false and no payload.

Defined results: null html is an empty payload; null url is an empty target; rows with a
null page_id come after all others; of rows with equal page_id and payload one is the
response and the others revisit it; extra columns are ignored; a record is held as a whole in
one task, so a single page must fit there.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as T
from .work import Work

REVISIT_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 4 << 10
MAX_RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload, or None where the framing breaks off."""
    out, at = [], 0
    while True:
        to = body.find(b"\r\n", at)
        if to < 0:
            return None
        try:
            n = int(body[at:to].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        part = body[to + 2 : to + 2 + n]
        if len(part) < n or body[to + 2 + n : to + 4 + n] != b"\r\n":
            return None
        out.append(part)
        at = to + 4 + n


def _head(fields: list[tuple[str, object]]) -> bytes:
    safe = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: "%%%02X" % ord(m[0]), str(v))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def records(rid: str, uri: str, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT_BYTES):
    """The records of one page, each without the empty lines behind it."""
    base = [("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        block = HTTP + b"\r\n"
        yield _head([("WARC-Type", "revisit"), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), kind, ("Content-Length", len(block))]) + block
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        many = len(parts) > 1
        last = ("WARC-Segment-Total-Length", len(block) if many and k == len(parts) else None)
        number, size = ("WARC-Segment-Number", k if many else None), ("Content-Length", len(part))
        if k == 1:
            yield _head([("WARC-Type", "response"), *base, number, kind, size]) + part
        else:
            yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{rid}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{rid}>"), number, last, size]) + part


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, segment: int = SEGMENT_BYTES) -> None:
    """Writes page_id, url and html as gzipped WARC files in the folder `path`."""
    T.small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"))
    large = F.octet_length("html") >= revisit_bytes
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")

    def named(page, url, number):
        """A name that follows from the row alone, and for repeated rows from their number: a task that runs again gives it again."""
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.hex("digest"), F.lit(":"), F.substring(F.sha2(url, 256), 1, 16), F.lit(":"), number.cast("string"))

    def record(number, refers_to, payload):
        return [named(F.col("page_id"), F.col("url"), number).alias("rid"), "url", "digest", refers_to.cast("string").alias("refers_to"), payload.cast("string").alias("html")]

    none = F.lit(None)
    # each large payload once: copies are collapsed before they are shuffled, and equal digests have equal payloads
    whole = rows.where(large).groupBy("digest").agg(F.min(order).alias("first"), F.first("html").alias("html"))
    responses = whole.select("digest", "first.page_id", "first.url", "html").select(record(F.lit(0), none, F.col("html")))
    # what is left needs no large payload
    keys = rows.groupBy("digest", "page_id", "url", large.alias("large"), F.when(~large, F.col("html")).alias("html")).agg(F.count("*").alias("n"))
    small = keys.where("not large").withColumn("number", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(record(F.col("number"), none, F.col("html")))
    shared = keys.where("large").groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("all")).where("all > 1").select("digest", "first")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url"))
    others = keys.where("large").join(shared, "digest").withColumn("from", F.when(own, F.lit(1)).otherwise(F.lit(0))).where(F.col("n") > F.col("from"))
    revisits = others.withColumn("number", F.explode(F.sequence(F.col("from"), F.col("n") - 1))).select(record(F.col("number"), named(F.col("first.page_id"), F.col("first.url"), F.lit(0)), none))
    typed = responses.unionByName(small).unionByName(revisits)

    def run(batches):
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                own = list(records(r["rid"], r["url"], (r["html"] or "").encode(), r["digest"].hex(), r["refers_to"], segment))
                out += own
                size += sum(map(len, own))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = typed.transform(T.mapped, run, "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


class _Stream:
    """Bytes of a file, unpacked as they are asked for; gzip files may have many members."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buf = memoryview(raw), 0, bytearray()
        self.gz = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 16)]
        self.at += len(part)
        if self.gz is None:
            self.buf += part
            return True
        while part:
            self.buf += self.gz.decompress(part)
            part = self.gz.unused_data
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buf.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buf)
            if not self.more():
                return None
        out = bytes(self.buf[:i])
        del self.buf[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self.more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def parse(raw: bytes):
    """(headers in lower case, block) of every record of a file."""
    s = _Stream(raw)
    while (head := s.until(END)) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        block = s.take(int(fields.get("content-length", 0)))
        s.take(len(END))
        yield fields, block


RECORD = "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, segment int, origin string, total long, block binary"
PAGE = "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, complete boolean, payload binary"


def _bare(x: str | None) -> str | None:
    return x[1:-1] if x and x[:1] == "<" else x


def _parsed(batches):
    types = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    for b in batches:
        for raw in b.column("content"):
            rows, size = [], 0
            for f, block in parse(raw.as_py()):
                n, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                rows.append((_bare(f.get("warc-record-id")), f.get("warc-type"), f.get("warc-target-uri"), _bare(f.get("warc-refers-to")), f.get("warc-payload-digest"), n and int(n), _bare(f.get("warc-segment-origin-id")), total and int(total), block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _payload(block: bytes | None) -> bytes | None:
    head, gap, body = (block or b"").partition(END)
    if not gap:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def _decoded(payloads: bool):
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                block = r["block"]
                if r["segments"] is not None:
                    s = sorted(r["segments"], key=lambda x: x["segment"])
                    block = b"".join(x["block"] for x in s)
                    whole = [x["segment"] for x in s] == list(range(1, len(s) + 1)) and s[-1]["total"] == len(block)
                    block = block if whole else None
                p = None if r["record_type"] == "revisit" else _payload(block)
                done = r["record_type"] == "revisit" or p is not None
                rows.append((*(r[k] for k in ("record_id", "record_type", "target_uri", "refers_to", "declared_digest")), None if p is None else len(p), None if p is None else hashlib.sha256(p).hexdigest(), done, p if payloads else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PAGE.split(", ")])

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response and revisit record of the WARC files in the folder `path`."""
    T.small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.transform(T.mapped, _parsed, RECORD).where(F.col("record_type").isin("response", "revisit", "continuation"))
    part = "struct(segment, total, block)"
    one = rows.where("segment is null").select("record_id", "record_type", "target_uri", "refers_to", "declared_digest", "block", F.expr(f"cast(null as array<{'struct<segment:int,total:bigint,block:binary>'}>)").alias("segments"))
    many = rows.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "target_uri", "refers_to", "declared_digest")],
        F.expr("cast(null as binary)").alias("block"), F.expr(f"collect_list({part})").alias("segments"),
    )
    return one.unionByName(many).transform(T.mapped, _decoded(payloads), PAGE)


def round_trip(pages: DataFrame, work: Work | None = None) -> DataFrame:
    """Writes the pages, reads the archives back and returns what they say: page_id, payload_bytes,
    payload_digest, record_type, refers_to and complete."""
    spark = pages.sparkSession
    work = work or Work(spark, "warc")
    write(pages, f"{work.path}/archives")
    got = work.table(read(spark, f"{work.path}/archives", payloads=False).drop("payload", "target_uri"), "records")
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    responses = got.where("record_type = 'response'").select(page("record_id").alias("page_id"), "record_id", "payload_bytes", "payload_digest", "complete")
    revisits = got.where("record_type = 'revisit'").select(page("record_id").alias("page_id"), "refers_to", "declared_digest")
    target = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest", "complete")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    again = revisits.join(target, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to"),
        (F.coalesce("complete", F.lit(False)) & (F.col("declared_digest") == F.concat(F.lit("sha256:"), "payload_digest"))).alias("complete"),
    )
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete").select(cols).unionByName(again.select(cols))
