"""WARC archives: written by Spark's text sink, read by verified chains of records.

Writing. Every page becomes one record. Of pages with equal payloads (SHA-1) the one with
the largest id is the response, the others are revisit records that refer to it and
carry no payload. The whole record is a column; the text sink writes it with its own
commit protocol, so a lost task leaves no half archive.

Reading. Archives are cut into blocks of ``BLOCK`` bytes, a task each.

1. A task searches its block for the magic and follows every well-formed header to
   its successor, the offset behind the record's content. Within the block such links are
   followed at once, so each candidate yields the first offset that leaves the block.
2. Pointer jumping from the start of each file, doubling the links each round, marks the
   offsets that the chain really enters blocks at. Magic inside a payload is a candidate,
   but no chain from the start leads to it.
3. Each task with an entry walks the chain from there and reads the records.

Links are one row per candidate that another block leads to. A block costs one read of
its bytes in 1 and one in 3, plus the headers or records that run over its end.

Defined cases: a null html has an empty payload; a null url no target header; line
breaks of a url are written percent-encoded and so read back; a
null id sorts below all others. Rows that repeat the largest id of their payload are all
responses. Payloads below ``least`` bytes are all responses. An empty table writes no
record and reads none. A file whose chain breaks raises an error. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versegrid.session import drop_staged, stage

MAGIC = b"WARC/1.1\r\n"
BLOCK = 16 << 20
#: Bytes behind a block that are read along for the header of its last record; longer headers are read on to their end.
HEADER = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Base 32 digits in the order of RFC 4648, beside those of number conversion.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LENGTH = re.compile(rb"\r\nContent-Length: *(\d+) *\r\n", re.I)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: 40 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def _url_safe(url: Column) -> Column:
    safe = url
    for sign in "%\r\n":
        safe = F.replace(safe, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return safe


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` to ``folder``."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest, size = base32_sha1(F.col("html").cast("binary")), F.octet_length("html")
    copied = rows.filter(size >= least).select(digest.alias("copy"), "id").groupBy("copy").agg(
        F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("copy", "first")
    copied = stage(copied, "warc-copies")  # only payloads that occur again; their number decides how Spark joins
    named = rows.withColumn("digest", digest)
    joined = named.join(copied, (F.col("digest") == F.col("copy")) & (size >= least), "left")
    revisit = F.coalesce((F.col("id") < F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull()), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    identity = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), identity, F.lit(">"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _url_safe(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"))
    joined.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "none").text(folder)


def _header_end(data: bytes, at: int) -> tuple[int, int] | None:
    """Length of the header at ``at`` and of its content, or None if there is no well-formed one."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    length = LENGTH.search(data, at, end + 2) if end > 0 else None
    return (end + 4 - at, int(length[1])) if length else None


def _read_on(source, data: bytes, start: int, at: int, size: int) -> bytes:
    """``data``, which begins at ``start`` of the file, lengthened until the header at ``at`` ends in it or the file does."""
    step = HEADER
    while data.find(b"\r\n\r\n", at) < 0 and start + len(data) < size:
        data += source.read_at(min(step, size - start - len(data)), start + len(data))
        step *= 2
    return data


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def candidates(blocks: DataFrame) -> DataFrame:
    """``(path, offset, leaves)`` per record that a block seems to begin: where its chain leaves the block; null if it breaks."""
    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, start, stop, size in zip(*[c.to_pylist() for c in batch.columns]):
                with _open(path) as source:
                    data = source.read_at(min(stop + HEADER, size) - start, start)
                    if (last := data.rfind(MAGIC, 0, stop - start + len(MAGIC) - 1)) >= 0:
                        data = _read_on(source, data, start, last, size)
                successor, at = {}, data.find(MAGIC)
                while 0 <= at < stop - start:
                    if found := _header_end(data, at):
                        after = at + sum(found)
                        # a record ends with two line breaks, as far as that can be seen here
                        if start + after + 4 <= size and (after + 4 > len(data) or data[after:after + 4] == b"\r\n\r\n"):
                            successor[at] = after + 4
                    at = data.find(MAGIC, at + 1)
                leaves: dict[int, int | None] = {}
                for at in sorted(successor, reverse=True):
                    after = successor[at]
                    leaves[at] = start + after if after >= stop - start else leaves.get(after)
                yield pa.record_batch([
                    pa.array([path] * len(leaves), pa.string()), pa.array([start + at for at in leaves], pa.int64()),
                    pa.array(list(leaves.values()), pa.int64())], names=["path", "offset", "leaves"])

    return blocks.mapInArrow(search, "path string, offset long, leaves long")


def entries(blocks: DataFrame) -> DataFrame:
    """``(path, offset)`` where the chain from the start of each file enters a block."""
    found = stage(candidates(blocks), "warc-candidates")
    targets = found.select("path", F.col("leaves").alias("offset")).unionByName(
        found.select("path", F.lit(0).cast("long").alias("offset"))).distinct()
    links = stage(found.join(targets, ["path", "offset"], "left_semi"), "warc-links")
    reached = stage(links.filter("offset = 0").select("path", "offset"), "warc-reached")
    n = reached.count()
    while n:
        step = links.select("path", "offset", F.col("leaves").alias("to"))
        moved = reached.join(step, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        more = stage(reached.unionByName(moved).filter("offset IS NOT NULL").distinct(), "warc-reached")
        drop_staged(reached)
        reached, before, n = more, n, more.count()
        if n == before:
            break
        onward = links.select("path", F.col("offset").alias("leaves"), F.col("leaves").alias("far"))
        twice = stage(links.join(onward, ["path", "leaves"], "left").select("path", "offset", F.coalesce("far", "leaves").alias("leaves")),
                      "warc-links")
        drop_staged(links)
        links = twice
    return reached


def read_archives(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """``(path, offset, record_type, record_id, target, payload_digest, refers_to, payload)`` of every real record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").filter("length > 0")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block))).alias("no"))
    blocks = stage(cut.select("path", (F.col("no") * block).cast("long").alias("start"),
                              F.least((F.col("no") + 1) * block, "length").cast("long").alias("stop"), F.col("length").alias("size")), "warc-blocks")
    n = max(1, blocks.count())
    blocks = blocks.repartition(n, F.xxhash64("path", "start"))
    entered = entries(blocks)
    # the first record of every file has to be entered, even if nothing like a record stands there
    first = blocks.filter("start = 0").select("path", F.col("start").alias("offset"))
    entered = first.unionByName(entered).distinct().select(F.col("path").alias("of"), "offset")
    inside = blocks.join(entered, (F.col("path") == F.col("of")) & (F.floor(F.col("offset") / block) == F.floor(F.col("start") / block))) \
        .select("path", "offset", "stop", "size").repartition(n, F.xxhash64("path", "offset"))

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, at, stop, size in zip(*[c.to_pylist() for c in batch.columns]):
                with _open(path) as source:
                    start, data, rows, held = at, source.read_at(min(stop + HEADER, size) - at, at), [], 0
                    while at < stop:
                        data = _read_on(source, data, start, at - start, size)
                        found = _header_end(data, at - start)
                        if not found or at + sum(found) + 4 > size:
                            raise ValueError(f"{path}: no whole record at {at}")
                        body, length = at - start + found[0], found[1]
                        content = data[body:body + length] if body + length <= len(data) else source.read_at(length, start + body)
                        rows.append((path, at, *_fields(data[at - start:body]), content.partition(b"\r\n\r\n")[2]))
                        at, held = start + body + length + 4, held + length
                        if held > 4 << 20:
                            yield _record_batch(rows)
                            rows, held = [], 0
                    yield _record_batch(rows)

    return inside.mapInArrow(walk, RECORD)


RECORD = "path string, offset long, record_type string, record_id string, target string, payload_digest string, refers_to string, payload binary"


def _fields(header: bytes) -> list[str | None]:
    lines = (x.partition(": ") for x in header.decode("utf-8", "replace").split("\r\n")[1:])
    named = {name.lower(): value for name, _, value in lines}
    target = named.get("warc-target-uri")
    if target is not None:
        target = re.sub(r"%(0A|0D|25)", lambda m: chr(int(m[1], 16)), target)
    digest = named.get("warc-payload-digest")
    return [named.get("warc-type"), named.get("warc-record-id"), target, digest and digest.removeprefix("sha1:"), named.get("warc-refers-to")]


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
    columns = zip(*rows) if rows else [[]] * 8
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RECORD.split(", ")])


def page_records(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; revisits take the payload they refer to."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    read = stage(records.select(
        number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("own")), "warc-read")
    full = read.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("own").alias("full_digest")).distinct()
    both = read.filter("record_type = 'revisit'").join(full, "refers_to").filter("payload_digest = full_digest").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return read.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(both)
