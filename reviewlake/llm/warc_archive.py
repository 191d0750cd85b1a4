"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages with equal payloads of at least LEAST_REVISIT bytes are stored once; the others become revisit records that
name it.  Each partition becomes archives of at most ARCHIVE_ROWS frames and about ARCHIVE_BYTES.  Its task trains a dictionary on a bounded sample of its own records, puts it
in front of each, and streams one frame per record.  Spark's own file writer puts the bytes down and commits them, so a lost or
repeated task leaves no half archive, on any file system that Spark can write to.  (That writer puts a separator after each
row; it is an empty skippable frame, which every Zstandard reader passes over.)

Reading: whole archives come as binary files; the dictionary is loaded, each frame is decoded by itself in small
steps, and every header and length is checked.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import small_batches

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_BYTES = 32 << 10
ARCHIVE_ROWS = 1 << 16
ARCHIVE_BYTES = 256 << 20
SAMPLE_RECORDS = 256
SAMPLE_BYTES = 2 << 20
LEVEL = 6
STEP = 64 << 10
ID = "urn:page:"

RECORDS = ("archive string, position long, record_id string, record_type string, target_uri string, refers_to string, "
           "payload_length long, payload_digest string, payload binary, problem string")


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to); a null payload is empty.

    Of equal payloads of at least LEAST_REVISIT bytes the smallest id is the response.  Rows with that id again are
    responses too; rows with a null id revisit it; if all ids are null, all are responses.  The digest is the group's key, so a
    hot payload only meets sums here, and Spark splits it in the join.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST_REVISIT
    groups = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One uncompressed record.  White space and control characters of the address are percent-encoded."""
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; too little to train on gives their first bytes as a plain dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of a bounded size below ``path``; an empty table gives no record.

    Spark's writer starts a file after ARCHIVE_ROWS rows.  An archive that has its bytes before is filled up with rows
    without bytes, so the next file begins with the dictionary too.
    """
    rows = with_types(pages, page_id, url, html)
    small_batches(pages.sparkSession, 256)
    most_rows, most_bytes = ARCHIVE_ROWS, ARCHIVE_BYTES

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record_bytes(*values)

        coming, head, size = records(), [], 0
        for r in coming:
            head.append(r)
            size += len(r)
            if len(head) == SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                break
        if not head:
            return
        dictionary = train([r[:SAMPLE_BYTES] for r in head])
        known = zstandard.ZstdCompressionDict(dictionary)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        front = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        out, waiting, held, size = [], 0, 0, 0  # rows to give, their bytes; rows and bytes of the open archive
        for source in (head, coming):
            for r in source:
                if held == most_rows or size >= most_bytes:
                    out += [b""] * (most_rows - held)
                    held = 0
                if not held:
                    out.append(front)
                    waiting, held, size = waiting + len(front), 1, len(front)
                out.append(compressor.compress(r))
                held, size, waiting = held + 1, size + len(out[-1]), waiting + len(out[-1])
                if waiting >= SAMPLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, waiting = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    written = rows.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
    written.write.options(lineSep=EMPTY_FRAME, maxRecordsPerFile=ARCHIVE_ROWS).text(path)


def frames_of(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, record, problem) of each frame; the dictionary is taken from the first one."""
    at, known, first = 0, None, True
    while at < len(data):
        head = bytes(data[at:at + 8])
        magic = struct.unpack("<I", head[:4])[0] if len(head) >= 4 else 0
        if magic in SKIPPABLE:
            size = struct.unpack("<I", head[4:])[0] if len(head) == 8 else len(data)
            if at + 8 + size > len(data):
                yield at, None, "skippable frame is cut off"
                return
            if magic == DICTIONARY_MAGIC and first:
                content = bytes(data[at + 8:at + 8 + size])
                if content[:4] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                known = zstandard.ZstdCompressionDict(content) if content else None
            elif magic == DICTIONARY_MAGIC:
                yield at, None, "dictionary is not in front"
            at += 8 + size
            first = False
            continue
        first = False
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj() if known else zstandard.ZstdDecompressor().decompressobj()
        parts, fed = [], at
        try:
            while not one.eof and fed < len(data):
                parts.append(one.decompress(data[fed:fed + STEP]))
                fed = min(fed + STEP, len(data))
        except zstandard.ZstdError as e:
            yield at, None, f"frame can't be decoded: {e}"
            return
        if not one.eof:
            yield at, None, "frame is cut off"
            return
        yield at, b"".join(parts), None
        at = fed - len(one.unused_data)


def parsed(record: bytes) -> dict:
    """Fields of a record; ``problem`` says what is wrong with it, null if nothing."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_length", "payload_digest", "payload"))
    problems = []
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1") or not split:
        return out | {"problem": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or name.lower() in fields:
            problems.append(f"bad header line {name[:40]!r}")
        fields[name.lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in fields]
    if missing or not fields["content-length"].isdigit():
        return out | {"problem": f"missing or bad: {', '.join(missing) or 'content-length'}"}
    block, end = rest[:int(fields["content-length"])], rest[int(fields["content-length"]):]
    if end != b"\r\n\r\n":
        problems.append("content length and record length differ")
    named = lambda n: fields[n].strip("<>") if n in fields else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    out |= {"record_id": named("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
            "refers_to": named("warc-refers-to"), "payload_digest": digest}
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha256:") and told[7:] != hashlib.sha256(block).hexdigest():
        problems.append("block digest differs")
    http, split, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
    if not http.startswith(b"HTTP/") or not split or not length:
        problems.append("no HTTP header")
    else:
        out["payload_length"] = int(length[1])
        if out["record_type"] == "response":
            out["payload"] = payload
            if len(payload) != int(length[1]):
                problems.append("payload length differs")
            if digest and hashlib.sha256(payload).hexdigest() != digest:
                problems.append("payload digest differs")
        elif out["record_type"] == "revisit" and (payload or not out["refers_to"]):
            problems.append("revisit with a payload, or without the record it refers to")
    return out | {"problem": "; ".join(problems) or None}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, one row each; damaged ones come with their ``problem``."""
    small_batches(spark, 256)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [part.split(" ")[0] for part in RECORDS.split(", ")]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for at, record, problem in frames_of(memoryview(content.as_buffer())):
                    fields = parsed(record) if problem is None else dict.fromkeys(names) | {"problem": problem}
                    rows.append(fields | {"archive": name, "position": at})
                    size += len(fields["payload"] or b"") + 500
                    if size >= SAMPLE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(decoded, RECORDS)


def page_of(record_id: Column) -> Column:
    """The page id that a record id was made from."""
    return F.regexp_extract(record_id, f"^{ID}(-?[0-9]+)$", 1).try_cast("long")
