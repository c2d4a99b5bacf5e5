"""WARC archives: writing with revisits and segments, reading with segment reassembly.

A record's block longer than a segment is written as a first record and continuations. A reader
task parses whole archive files; continuations may lie in other files, so segments are grouped
by the identifier of their origin, ordered by number and checked against the total length before
the HTTP response in them, in chunked transfer framing, is decoded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import maybe_broadcast, shared_dir, stage, strings_of

#: Bytes of a block in one record, of a chunk of transfer framing, and of an archive file before compression (about).
SEGMENT, CHUNK, FILE = 32 << 10, 8 << 10, 16 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str, part: str = "") -> str:
    """The same in every run and attempt, so that a task that is run again deals its records alike."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}{part}').urn}>"


def framed(payload: bytes) -> bytes:
    """An HTTP response with the payload in chunked transfer framing."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), CHUNK):
        piece = payload[at : at + CHUNK]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(block: bytes) -> bytes:
    """Payload of an HTTP response, chunked or not."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    at, parts = 0, []
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk's length does not hold")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, identifier: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, revisit: bool, segment: int) -> Iterator[bytes]:
    """Records of one page: a response in as many segments as it takes, or a revisit of the page `origin`."""
    own = [("WARC-Page-ID", page_id), ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers = [*own, ("WARC-Refers-To", record_id(origin, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
        yield record("revisit", record_id(page_id, digest, " revisit"), headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    identifier, block = record_id(page_id, digest), framed(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    own.append(("Content-Type", "application/http;msgtype=response"))
    yield record("response", identifier, own + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] * (k == len(parts))
        yield record("continuation", record_id(page_id, digest, f" {k}"), [("WARC-Segment-Origin-ID", identifier), ("WARC-Segment-Number", k), *last], part)


def write(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = REVISIT_BYTES) -> None:
    """Archives of pages(page_id, url, html) in the folder `path`.

    Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is
    stored and the others revisit it; rows that repeat it are stored as well. Null html is an
    empty payload. Records are dealt over files of about FILE bytes by a hash of their bytes, continuations
    apart from their origin, and sorted by it: the archives are the same in every run.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    large = base.where(F.octet_length("payload") >= least)
    repeated = stage(large.groupBy("digest").agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1"), "warc-repeated")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    told = base.join(maybe_broadcast(repeated), "digest", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    told = told.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "origin", revisit.alias("revisit"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(2))
            out, size = [], 0
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                page, url, digest, origin, again = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4, 5))
                for x in records(page, url, bytes(buf[a:b]), digest, origin, again, segment):
                    out.append(x)
                    size += len(x)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    files = max(1, -(-total // FILE))
    built = told.mapInArrow(build, "record binary").repartition(files, F.xxhash64("record")).sortWithinPartitions(F.xxhash64("record"))
    built.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def inflated(archive: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    member, step = zlib.decompressobj(31), 1 << 18
    for at in range(0, len(archive), step):
        data = bytes(archive[at : at + step])
        while data:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(data)
            data = member.unused_data
    if not member.eof:
        raise ValueError("an archive breaks off")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive that comes in pieces; header names in lower case."""
    held, ended = bytearray(), False

    def more(size: int) -> bool:
        """Whether at least `size` bytes are there, after reading on if need be."""
        nonlocal ended
        while len(held) < size and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= size

    while more(1):
        end = held.find(b"\r\n\r\n")
        while end < 0 and more(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("not the start of a WARC record")
        _, *lines = held[:end].decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if not more(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's length does not hold")
        block = bytes(held[start:stop])
        del held[: stop + 4]
        yield headers, block


FIELDS = "id string, type string, page_id long, url string, digest string, refers string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of all archives under path: FIELDS and payload (null for revisits).

    Raises if a record, a chunk, a segment or the total length is not as stated.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parsed(segmented: bool):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    rows, size = [], 0
                    for h, block in parse(inflated(memoryview(content.as_buffer()))):
                        if ("warc-segment-number" in h) != segmented:
                            continue
                        page = h.get("warc-page-id")
                        row = [h["warc-record-id"], h["warc-type"], page and int(page), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to")]
                        if segmented:
                            row += [h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), int(h.get("warc-segment-total-length", 0)), block]
                        else:
                            row.append(None if h["warc-type"] == "revisit" else unframed(block))
                        rows.append(row)
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows, segmented)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows, segmented)

        return apply

    whole = files.mapInArrow(parsed(False), f"{FIELDS}, payload binary")
    parts = files.mapInArrow(parsed(True), f"{FIELDS}, origin string, number int, total long, block binary")
    first = F.col("number") == 1
    grouped = parts.groupBy("origin").agg(F.max(F.when(first, F.struct("id", "type", "page_id", "url", "digest", "refers"))).alias("head"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head, total, pieces = batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                payload, copies = reassembled([(p["number"], p["block"]) for p in pieces], total)
                at = pa.array([0] * copies)
                yield pa.RecordBatch.from_arrays([*(x.take(at) for x in head.flatten()), pa.array([payload] * copies, pa.binary())], NAMES[:7])

    return whole.unionByName(grouped.select("head", "total", "parts").mapInArrow(join, f"{FIELDS}, payload binary"))


def reassembled(parts: list[tuple[int, bytes]], total: int) -> tuple[bytes, int]:
    """(payload, copies) from numbered segments; a record written several times has each segment as often."""
    numbers = [n for n, _ in parts]
    copies = numbers.count(1)
    if not copies or numbers != sorted([*range(1, max(numbers) + 1)] * copies):
        raise ValueError("segments are missing")
    block = b"".join(b for _, b in parts[::copies])
    if len(block) != total:
        raise ValueError("segments do not add up to the total length")
    return unframed(block), copies


NAMES = ["id", "type", "page_id", "url", "digest", "refers", "payload"]


def batch_of(rows: list[list], segmented: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names, kinds = ([*NAMES[:6], "origin", "number", "total", "block"], [*kinds, pa.string(), pa.int32(), pa.int64(), pa.binary()]) if segmented else (NAMES, [*kinds, pa.binary()])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def resolved(read_back: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of what `read` gives.

    Size and digest are those of the decoded payload; a revisit has those of the response that
    it refers to, found by record identifier.
    """
    narrow = read_back.select("id", "type", "page_id", "url", "refers", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("found"), "digest")
    narrow = stage(narrow, "warc-records")
    bad = narrow.where("type = 'response' and found <> digest").limit(1).count()
    if bad:
        raise ValueError("a payload does not have its stated digest")
    kept = narrow.where("type = 'response'").dropDuplicates(["id"]).select(F.col("id").alias("k_id"), F.col("page_id").alias("k_page"), F.col("bytes").alias("k_bytes"), F.col("found").alias("k_found"))
    again = narrow.where("type = 'revisit'").join(kept, F.col("refers") == F.col("k_id"), "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = again.select("page_id", "url", F.col("k_bytes"), F.col("k_found"), "type", "k_page").toDF(*columns)
    return narrow.where("type = 'response'").select("page_id", "url", "bytes", "found", "type", F.lit(None).cast("long")).toDF(*columns).unionByName(again)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """pages written to archives in `path` (by default in the shared folder) and read back; see `resolved`.

    One row for each row of pages, repeated ones included. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/tarn-warc-{uuid.uuid4().hex}"
    write(pages, path)
    return resolved(read(spark, path))
