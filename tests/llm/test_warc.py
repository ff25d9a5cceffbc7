import base64
import hashlib
import io
import os
import re

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from quadrat.llm import warc


def want(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None) if len(data) >= 1000 else None
        revisit = top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(rows)


def test_edges(spark):
    big, other = "é" * 600, "z" * 300_000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/ c\r\nd", big), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"), (None, "u", big), (None, None, None), (9, "u", other), (8, "u", other), (9, "u", other), (2**62, "u", "a\r\n\r\nb"), (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "x" * 1000), (14, "u", "x" * 1000)]
    check(spark, rows)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()])


def test_bundle_is_plain_zstandard(monkeypatch):
    class Out(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    monkeypatch.setattr(warc, "FRAME", 5000)
    out = Out()
    bundle = warc.Bundle(out)
    records = [warc.record(f"<urn:uuid:{i}>", i, "http://x", b"p" * (i * 37), i * 37, hashlib.sha1(b"p" * (i * 37)).hexdigest(), *((None, None) if i % 3 else (i + 1, "http://y"))) for i in range(200)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    frames = warc.seek_table(pa.BufferReader(out.kept))
    assert len(frames) > 5
    for r, (frame, at) in zip(records, places):
        start, packed, whole = frames[frame]
        data = zstandard.ZstdDecompressor().decompress(out.kept[start : start + packed], max_output_size=whole)
        assert data[at : at + len(r)] == r
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.kept), read_across_frames=True).read()
    assert whole == b"".join(records)


def test_lookup_reads_one_record(spark, sf, tmp_path):
    """By its record identifier, from the index that stands beside the bundles."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = f"file://{tmp_path}/w"
    warc.archive(pages, folder=folder)
    row = pages.orderBy("page_id").first()
    index = warc.index(spark, folder)
    name = index.filter(f"id = {row.page_id}").first().record_id
    got = warc.read(index.filter(F.col("record_id") == name), folder).collect()
    assert len(got) == 1 and bytes(got[0].payload) == row.html.encode() and got[0].id == row.page_id


def strict_records(data):
    """Named fields (lower case) and blocks of all records of a file, by the grammar of WARC 1.1."""
    out = []
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, data = data.split(b"\r\n\r\n", 1)
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, value = line.decode("utf-8").split(":", 1)
            assert re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) and name.lower() not in fields
            fields[name.lower()] = value.strip()
        n = int(fields["content-length"])
        block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
        assert end == b"\r\n\r\n"
        out.append((fields, block))
    return out


def test_archives_are_warc(spark, tmp_path):
    """Every file, read by the grammar alone: mandatory fields, unique identifiers, revisits by their profile."""
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/ c\r\nd", big), (3, "http://b/", big), (3, "http://b/", big), (4, "u", None), (None, None, "s"), (7, "u", "s"), (7, "u", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.round_trip(df, folder=f"file://{tmp_path}/w")
    found = []
    for name in os.listdir(f"{tmp_path}/w"):
        if name.endswith(".warc.zst"):
            with open(f"{tmp_path}/w/{name}", "rb") as f:
                found += strict_records(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read())
    assert len(found) == len(rows) and len({f["warc-record-id"] for f, _ in found}) == len(rows)
    for fields, block in found:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
        assert fields["content-type"].startswith("application/http") and re.fullmatch(r"\S+", fields["warc-target-uri"])
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert re.fullmatch(r"sha1:[A-Z2-7]{32}", fields["warc-payload-digest"])
        if fields["warc-type"] == "response":
            assert base64.b32decode(fields["warc-payload-digest"][5:]) == hashlib.sha1(payload).digest()
        else:
            assert fields["warc-type"] == "revisit" and payload == b"" and fields["warc-profile"] == "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            same = [f for f, _ in found if f["warc-type"] == "response" and f["warc-payload-digest"] == fields["warc-payload-digest"]]
            assert fields["warc-refers-to-target-uri"] in {f["warc-target-uri"] for f in same} and fields["warc-refers-to-date"] == same[0]["warc-date"]
    assert sorted(f["warc-type"] for f, _ in found) == ["response"] * 7 + ["revisit"] * 2
