import base64
import gzip
import hashlib
import io
import zlib

import pytest

from tickloom.llm import warc
from tickloom.llm.store import new_folder


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def round_trip(spark, pages, **options):
    folder = new_folder(spark, "warc-test")
    archives = warc.write_archives(pages, f"{folder}/whole", **options)
    index = warc.normalise(archives, f"{folder}/members")
    return archives, index, warc.read_archives(index, folder)


def test_round_trip_with_copies(spark):
    texts = ["<p>a</p>", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>a</p>", "", "line\nend\r\n\r\n"]
    rows = [(k, f"http://h/{k}?q=ü \r\n", t, "extra") for k, t in enumerate(texts)]
    archives, index, read = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3))
    got = {r["page_id"]: r for r in read.collect()}
    assert len(got) == len(rows) == archives.groupBy().sum("records").first()[0] == index.count()
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t or "", k)
        r, own = got[k], first[t or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["payload_ok"]) == (len((t or "").encode()), digest(t or ""), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == k else ("revisit", own))


def test_small_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    _, _, read = round_trip(spark, pages, min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in read.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_null_and_repeated_ids_and_an_empty_table(spark):
    pages = spark.createDataFrame([(None, None, "a"), (5, None, "a"), (5, None, "a"), (None, "u", None)], "page_id long, url string, html string")
    _, _, read = round_trip(spark, pages)
    rows = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read.collect()), key=str)
    assert rows == sorted([(0, "revisit", 5, 1), (5, "response", None, 1), (5, "response", None, 1), (0, "response", None, 0)], key=str)
    assert round_trip(spark, pages.limit(0))[2].collect() == []


def record(k, payload):
    return warc.record_bytes(k, f"u{k}", payload, None, False)


@pytest.mark.parametrize("split", [None, 1])
def test_every_record_becomes_a_member(split, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    payloads = [b"", b"abc", b"\r\n\r\n" * 5, bytes(range(256)) * 40]
    records = [record(k, p) for k, p in enumerate(payloads)]
    # One stream, or a stream whose members end inside records.
    raw = b"".join(records)
    source = gzip.compress(raw) if split is None else gzip.compress(raw[:1001]) + gzip.compress(raw[1001:])
    target = io.BytesIO()
    entries = list(warc.normalise_stream(io.BytesIO(source), target))
    data = target.getvalue()
    assert gzip.decompress(data) == raw and sum(e[1] for e in entries) == len(data)
    for (offset, length, _), whole in zip(entries, records, strict=True):
        assert zlib.decompress(data[offset:offset + length], 31) == whole


def test_a_cut_archive_is_an_error():
    source = gzip.compress(record(1, b"abc" * 1000))
    with pytest.raises(EOFError):
        list(warc.normalise_stream(io.BytesIO(source[:-20]), io.BytesIO()))
    with pytest.raises(EOFError):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(record(1, b"abc")[:-5])), io.BytesIO()))


def test_archives_are_split_by_bytes(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", str(k) * 500) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    archives, index, read = round_trip(spark, pages)
    assert archives.count() == 1 and index.count() == 20 and index.select("path").distinct().count() == 1
    offsets = [(r["offset"], r["length"]) for r in index.orderBy("offset").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:]))
