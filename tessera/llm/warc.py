"""WARC archives: pages to records, and records back to pages with their segments put together.

The writer makes one gzip member per record. Response payloads travel in chunked transfer framing inside an
HTTP message; a block above the segment size is split, the first part as response record number 1 and the
rest as continuation records that name it as their origin. The reader parses archives as streams, groups
the parts of a split record by origin identifier, orders them by segment number, verifies the total length
and decodes the chunks. Records that were not split are never shuffled.

Files are written under a name of the task's attempt and renamed when complete, so a lost executor or a
second attempt leaves the same archives behind.

Defined cases: a null html is an empty payload; payloads below 100 bytes are always responses; of equal
payloads the rows with the smallest page_id are responses and all others revisit it (a null page_id is only
a response where no row of its payload has an id); repeated rows give one record each; an empty table gives
no records; a record whose segments don't add up to the stated length is reported with valid = false and a
null payload, and page_records() leaves its size null; page ids are integers (any other gives null ids back);
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .textops import portions

MIN_DEDUP = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_BYTES = 256 << 20
FEW_REVISITS = 100_000


def located(uri: str) -> str:
    """The name by which pyarrow knows a place: Hadoop's s3a and s3n are its s3; host and port of any other stay."""
    scheme, mark, rest = uri.partition("://")
    return f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0], 16)
        if size == 0:
            return b"".join(out)
        if end + 2 + size + 2 > len(body):
            raise ValueError("chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def page_members(page_id, url: str | None, payload: bytes, digest: str, revisit_of, serial: str, segment: int = SEGMENT_BYTES):
    """The records of one page as gzip members."""
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{digest[:16]}#{serial}>"
    uri = quote(url or "about:blank", safe="/:?#[]@!$&'()*+,;=%~")
    common = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit_of is not None:
        refers = ("WARC-Refers-To", f"<urn:x-page:{revisit_of}:{digest[:16]}>")
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _member([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, refers, profile, kind], http)
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _member([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, kind], block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _member([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", "1"), kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}.{k}>"), *common, ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", name)]
        if k == len(parts):
            head.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _member(head, part)


def _first_pages(pages: DataFrame) -> DataFrame:
    """(digest, first) of payloads that more than one row has."""
    payload = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= MIN_DEDUP)
    return facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")


def write_pages(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page below path; returns the written table of archives: path, records, bytes."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    # Only page ids and digests meet here, not texts: which rows revisit which page.
    facts = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    salts = 8
    firsts = _first_pages(pages).select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    facts = facts.where(F.col("n") >= MIN_DEDUP).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    revisits = cut(facts.join(firsts, ["digest", "salt"]).where("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct(), "warc-revisits")
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    again = revisits.count()
    if not again:
        rows = rows.withColumn("first", F.lit(None).cast("long"))
    else:
        marks = revisits.withColumnsRenamed({"page_id": "_id", "digest": "_d"})
        # some 80 bytes each: few go to every task, many meet the pages by a shuffle
        rows = rows.join(F.broadcast(marks) if again <= FEW_REVISITS else marks, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").drop("_id", "_d")

    def write(batches):
        context = TaskContext.get()
        pid, attempt = context.partitionId(), context.taskAttemptId()
        files, base = fs.FileSystem.from_uri(located(path))
        files.create_dir(base, recursive=True)
        out, records, written, k, serial, made = None, 0, 0, 0, 0, []

        def close() -> None:
            nonlocal out
            out.close()
            name = f"pages-{pid:05d}-{k:04d}.warc.gz"
            final = f"{base}/{name}"
            if files.get_file_info(final).type != fs.FileType.NotFound:
                files.delete_file(final)
            files.move(f"{base}/.{pid}-{k}-{attempt}", final)
            made.append((f"{path.rstrip('/')}/{name}", records, written))  # the whole URI
            out = None

        for b in portions(batches):
            for page_id, url, html, digest, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if out is None:
                    out = files.open_output_stream(f"{base}/.{pid}-{k}-{attempt}", compression=None)
                serial += 1
                for member in page_members(page_id, url, html.as_py(), digest, first, f"{pid}.{serial}", segment):
                    out.write(member)
                    written += len(member)
                records += 1
                if written >= file_bytes:
                    close()
                    k, records, written = k + 1, 0, 0
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-archives")


def records(stream):
    """(fields, block) of the records of a gzip or plain WARC stream, one at a time."""
    buffer, z, raw = bytearray(), None, b""
    plain: bool | None = None

    def more() -> bool:
        """Grow buffer; False at the end."""
        nonlocal z, raw, plain
        while True:
            if not raw:
                raw = stream.read(1 << 18)
                if not raw:
                    return False
            if plain is None:
                plain = raw[:2] != b"\x1f\x8b"
            if plain:
                buffer.extend(raw)
                raw = b""
                return True
            z = z or zlib.decompressobj(31)
            got = z.decompress(raw)
            raw = z.unused_data if z.eof else b""
            if z.eof:
                z = None
            if got:
                buffer.extend(got)
                return True

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        while (end := buffer.find(b"\r\n\r\n")) < 0 or buffer[:1] in (b"\r", b""):
            while buffer[:2] == b"\r\n":
                del buffer[:2]
            if not more():
                return
        head = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(fields.get("content-length", 0))
        while len(buffer) < end + 4 + size:
            if not more():
                return
        yield fields, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


_RECORD = "type string, record_id string, target_uri string, payload_digest string, refers_to_id string, origin_id string, segment int, total bigint, block binary"
_FIELDS = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id"]


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives whose path is in the column path, one task or more per archive, in streams."""
    many = max(partitions(archives.sparkSession), 1)
    types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def each(batches):
        for b in portions(batches):
            for path in b.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(located(path))
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(at, compression=None) as stream:
                    for fields, block in records(stream):
                        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                        rows.append((*(fields.get(f) for f in _FIELDS), int(number) if number else None, int(total) if total else None, block))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select("path").repartition(many, "path").mapInArrow(each, _RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """One row per whole record: type, record_id, target_uri, payload_digest, refers_to_id, valid, payload.

    Parts of split records meet by origin identifier; a record's parts are all that is ever gathered.
    """
    found = found.where(F.col("type").isin("response", "revisit", "continuation"))
    alone = found.where("segment is null").withColumn("blocks", F.array("block")).withColumn("total", F.lit(None).cast("long")).withColumn("whole", F.lit(True))
    parts = found.where("segment is not null").withColumn("record_id", F.coalesce("origin_id", "record_id"))
    sorted_parts = F.sort_array(F.collect_set(F.struct("segment", "block")))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("record_id").agg(*(first(c) for c in ("type", "target_uri", "payload_digest", "refers_to_id")), F.max("total").alias("total"), sorted_parts.alias("_parts"))
    grouped = grouped.withColumn("blocks", F.col("_parts.block"))
    # numbers 1..n without a gap, and the last part states the length
    grouped = grouped.withColumn("whole", F.col("_parts.segment") == F.sequence(F.lit(1), F.size("_parts"))).withColumn("whole", F.col("whole") & F.col("total").isNotNull() & F.col("type").isNotNull())
    names = ["type", "record_id", "target_uri", "payload_digest", "refers_to_id"]
    both = alone.select(*names, "total", "whole", "blocks").unionByName(grouped.select(*names, "total", "whole", "blocks"))

    def decode(batches):
        for b in portions(batches):
            payloads, valid = [], []
            for kind, total, whole, blocks in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7)):
                body = b"".join(blocks.as_py())
                ok, payload = bool(whole) and (total is None or total == len(body)), None
                if ok and kind == "response":
                    head, _, rest = body.partition(b"\r\n\r\n")
                    try:
                        payload = dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                    except ValueError:
                        ok = False
                payloads.append(payload)
                valid.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(valid), pa.array(payloads, pa.binary())], [*names, "valid", "payload"])

    return both.mapInArrow(decode, "type string, record_id string, target_uri string, payload_digest string, refers_to_id string, valid boolean, payload binary")


def page_records(whole: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits get the size from the record they name."""
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    facts = whole.select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to_id").alias("refers_to"),
        "valid",
    )
    facts = cut(facts, "warc-pages")
    salts = 8
    again = facts.where("record_type = 'revisit'").drop("payload_bytes").withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    named = again.select("refers_to", "payload_digest").distinct()
    # null-safe only where needed: a revisit always names a page
    origin = facts.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").join(named, ["refers_to", "payload_digest"]).distinct()
    origin = origin.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = again.join(origin, ["refers_to", "payload_digest", "_s"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    return facts.where("record_type = 'response'").select(*names).unionByName(again.select(*names)).drop("valid")
