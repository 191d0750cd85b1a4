import hashlib
import struct

import pytest
import zstandard

from reviewlake.llm import queries, warc_archive
from reviewlake.session import scratch_path


def write(spark, rows, **kwargs):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int").repartition(2)
    path = scratch_path(spark, "warc")
    warc_archive.write_archives(pages, path)
    return path


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = {r.page_id: r for r in queries.QUERIES["op8_warc"](spark, sf_dir).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    assert len(rows) == len(pages)
    for p in pages:
        r, raw = rows[p.page_id], (p.html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.problem) == (len(raw), hashlib.sha256(raw).hexdigest(), None)
        same = first[p.html] if len(raw) >= 100 else p.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if same == p.page_id else ("revisit", same))


def test_revisits_nulls_and_addresses(spark):
    long, bytes_99, bytes_100 = "ü" * 3000, "a" * 99, "é" * 50
    rows = [(5, "http://a/b c\r\nX: y", long), (3, None, long), (None, "u", long), (9, "u", bytes_99), (8, "u", bytes_99),
            (11, "u", bytes_100), (10, "u", bytes_100), (12, "u", None), (13, "u", ""), (14, "u", "\0\r\n\r\nWARC/1.1\r\n"),
            (None, "u", "z" * 200), (None, "u", "z" * 200), (15, "u", "x" * 3_000_000)]
    path = write(spark, [(*r, "clash", 1) for r in rows])
    got = warc_archive.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    at = {}
    for r in got:
        at.setdefault(r.record_id.removeprefix("urn:page:"), []).append(r)
    assert at["3"][0].record_type == "response" and at["5"][0].refers_to == "urn:page:3"
    assert at["5"][0].target_uri == "http://a/b%20c%0D%0AX:%20y" and at["3"][0].target_uri == "about:blank"
    assert at["8"][0].record_type == at["9"][0].record_type == "response" and at["11"][0].refers_to == "urn:page:10"
    assert bytes(at["14"][0].payload).decode() == rows[9][2] and len(at["15"][0].payload) == 3_000_000
    assert sorted((r.record_type, r.payload_length) for r in at[""]) == [("response", 200), ("response", 200), ("revisit", 6000)]
    empty = write(spark, [])
    assert warc_archive.read_archives(spark, empty).count() == 0


def test_archive_layout(spark):
    """A plain Zstandard reader that skips skippable frames gets the records, given the dictionary in front."""
    path = write(spark, [(k, "u", f"<p>page {k} {'word ' * 50}</p>", "", 0) for k in range(400)])
    raw = bytes(spark.read.format("binaryFile").load(path).first().content)
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(raw[8:8 + size])
    text = zstandard.ZstdDecompressor(dict_data=known).stream_reader(raw[8 + size:], read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") == len(list(warc_archive.frames_of(memoryview(raw)))) > 50


def record(**changes):
    raw = warc_archive.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    for a, b in changes.items():
        raw = raw.replace(a.encode(), b)
    return raw


@pytest.mark.parametrize("raw, problem", [
    (record(), None),
    (record(payload=b"pAyload"), "digest differs"),
    (record(payload=b"longer payload"), "length"),
    (record()[:-1], "length"),
    (b"nothing", "no WARC header"),
    (record().replace(b"Content-Length: 7", b"Content-Length: 8"), "payload length differs"),
    (record().replace(b"WARC-Date", b"WARC-Type"), "missing or bad: warc-date"),
    (record().replace(b"WARC-Target-URI:", b"no colon"), "bad header line"),
])
def test_damaged_records(raw, problem):
    got = warc_archive.parsed(raw)["problem"]
    assert got is None if problem is None else problem in got


def test_damaged_archives():
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(record())
    got = lambda data: [p for _, _, p in warc_archive.frames_of(memoryview(data))]
    assert got(frame + frame) == [None, None]
    assert got(frame + frame[:-3]) == [None, "frame is cut off"]
    assert "can't be decoded" in got(b"garbage!" + frame)[0]
    late = struct.pack("<II", 0x184D2A5D, 4) + b"abcd"
    assert got(frame + late) == [None, "dictionary is not in front"]
    packed = zstandard.ZstdCompressor().compress(b"some dictionary content")
    front = struct.pack("<II", 0x184D2A5D, len(packed)) + packed
    known = zstandard.ZstdCompressionDict(b"some dictionary content")
    assert got(front + zstandard.ZstdCompressor(dict_data=known).compress(record())) == [None]


@pytest.mark.parametrize("limits, archives", [((4, 1 << 20), 4), ((100, 1), 10), ((7, 1 << 20), 2)])
def test_archives_have_a_bound(spark, monkeypatch, limits, archives):
    """One partition of ten records makes several archives, each with the dictionary in front; all are read back."""
    monkeypatch.setattr(warc_archive, "ARCHIVE_ROWS", limits[0])
    monkeypatch.setattr(warc_archive, "ARCHIVE_BYTES", limits[1])
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(10)]
    path = scratch_path(spark, "warc")
    warc_archive.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = [f.content for f in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) == archives
    assert all(struct.unpack("<I", f[:4])[0] == warc_archive.DICTIONARY_MAGIC for f in files)
    got = warc_archive.read_archives(spark, path).collect()
    assert all(r.problem is None for r in got) and sorted(bytes(r.payload).decode() for r in got) == sorted(h for _, _, h in rows)
