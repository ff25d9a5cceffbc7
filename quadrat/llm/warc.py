"""WARC archives in seekable Zstandard bundles.

A bundle groups records into independent frames and ends in a seek table (a skippable frame that lists
compressed and decompressed sizes), so any Zstandard tool reads it as one stream and a reader with the
index decompresses only the frames it needs. The index, a table beside the bundles, maps a record's
identifier to bundle, frame and offset in the frame. Payloads that were stored before are written as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, remove, shared_root

FRAME, BUNDLE = 1 << 20, 256 << 20  # bytes before compression
#: Frames of a bundle that one task reads one after another, and bytes of records for each reading task, about.
FRAMES, READ = 32, 32 << 20
LEVEL = 3
LEAST = 1000  # bytes of a payload that may be revisited
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, id long, bundle string, frame int, at long, size long"
NAMESPACE = uuid.UUID("6f6d1f0a-3b0c-5a37-9d1c-1f7f6c3f0a55")


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, payload_bytes, sha1, refers_to, refers_url): what is written for each row; a revisit has no payload.

    Of equal payloads of at least LEAST bytes, the largest id is the response (every row of that id, if
    it repeats) and the others refer to it. Payloads are compared by SHA-256; digests are counted before
    they are shuffled, and payloads that occur once are not joined to anything.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    top = F.max(F.struct("id", "url"))
    first = rows.filter(F.octet_length("payload") >= LEAST).groupBy(F.col("sha256").alias("s")).agg(top.alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(first, F.col("sha256") == F.col("s"), "left")
    revisit = F.col("top.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("top.id"))
    return joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.when(revisit, F.col("top.id")).alias("refers_to"), F.when(revisit, F.col("top.url")).alias("refers_url"))


def target(page_id: int | None, url: str | None) -> str:
    """A page's URI without characters that end a field; a page without one has a name of its own."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, sha1: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC 1.1 record: a response with its HTTP head and payload, or a revisit with the head alone.

    sha1 is the payload's digest in hexadecimal; a revisit has it too, and the length in its HTTP head. The
    record that it refers to is named by URI, date and page.
    """
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(page_id, url)}"]
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {target(refers_to, refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {refers_to}"]
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {payload_bytes}"]
    block = "\r\n".join([*head, "", ""]).encode() + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def fields_of(lines: list[str]) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's named fields, those of its HTTP head, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = fields_of(lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if not first.startswith("WARC/") or end != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, fields_of(http.decode().split("\r\n")[1:]), payload


class Bundle:
    """A bundle being written: records go into frames, frames into a file that ends in their seek table."""

    def __init__(self, out) -> None:
        self.out, self.sizes, self.pending, self.held, self.total = out, [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it where the record will be."""
        at = (len(self.sizes), self.held)
        self.pending.append(data)
        self.held += len(data)
        self.total += len(data)
        if self.held >= FRAME:
            self._flush()
        return at

    def _flush(self) -> None:
        if self.pending:
            frame = self.zstd.compress(b"".join(self.pending))
            self.out.write(frame)
            self.sizes.append((len(frame), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the footer of a bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end")
    source.seek(size - 9 - 8 * n)
    data, start, out = source.read(8 * n), 0, []
    for k in range(n):
        packed, whole = struct.unpack_from("<II", data, 8 * k)
        out.append((start, packed, whole))
        start += packed
    return out


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """The index (record_id, id, bundle, frame, at, size) of the bundles written under folder, one row a record.

    folder is a URI that all workers reach; the index is the Parquet table ``index`` in it. A task writes
    files of its own, named by attempt; the index has the files of the attempts that ended well, so a task
    that runs again leaves at most a file that nothing refers to. Record identifiers are made from a
    bundle's name and the record's number in it: no two records share one, whatever rows repeat.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        bundle, name, files, n = None, "", 0, 0
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if bundle is None:
                    name = f"part-{context.partitionId():05d}-{files:04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    bundle, files, n = Bundle(fs.open_output_stream(f"{path}/{name}", compression=None)), files + 1, 0
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                page = None if pd.isna(row.id) else int(row.id)
                own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}:{n}')}>"
                data = record(own, page, row.url, row.payload, row.payload_bytes, row.sha1, refers, row.refers_url)
                rows.append((own, page, name, *bundle.add(data), len(data)))
                n += 1
                if bundle.total >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pd.DataFrame(rows, columns=["record_id", "id", "bundle", "frame", "at", "size"]).astype({"id": "Int64"})
        if bundle is not None:
            bundle.close()

    # ids as text: nulls and all 64 bits survive pandas
    text = planned.withColumn("id", F.col("id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    text.mapInPandas(run, INDEX).write.parquet(f"{folder}/index")
    return index(planned.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the archives in a folder."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, id, record_type, payload_bytes, payload_digest, refers_to, payload) of the index's records.

    A task reads runs of neighbouring frames; a bundle's seek table gives their places, and only frames
    that hold a wanted record are decompressed, one at a time. The number of tasks follows the bytes of the
    wanted records. A response's payload is held to its digest; a revisit's length and digest are those
    that the record states, and its payload is null.
    """
    columns = ["record_id", "id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.BinaryType()]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _open(folder)
        name, source, table, number, frame = None, None, [], -1, b""
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                if row.bundle != name:
                    if source is not None:
                        source.close()
                    source, name, number = fs.open_input_file(f"{path}/{row.bundle}"), row.bundle, -1
                    table = seek_table(source)
                if row.frame != number:
                    start, packed, whole = table[row.frame]
                    source.seek(start)
                    frame, number = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=whole), row.frame
                fields, http, payload = parse(frame[row.at : row.at + row.size])
                whole = fields["WARC-Type"] == "response"
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if fields["WARC-Record-ID"] != row.record_id or whole and (digest != hashlib.sha1(payload).hexdigest() or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{row.bundle}, frame {row.frame}, offset {row.at}: not the record {row.record_id}, or not its payload")
                number_of = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
                rows.append((row.record_id, number_of("Page-ID"), fields["WARC-Type"], int(http["Content-Length"]), digest, number_of("Refers-To-Page-ID"), payload if whole else None))
                held += len(payload)
                if len(rows) >= 500 or held > READ:
                    yield frame_of(rows)
                    rows, held = [], 0
            yield frame_of(rows)
        if source is not None:
            source.close()

    wanted, bundles = index.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("bundle")).first()
    ordered = index.select("record_id", "bundle", "frame", "at", "size").repartition(max(1, bundles, wanted // READ), "bundle", F.floor(F.col("frame") / FRAMES))
    return ordered.sortWithinPartitions("bundle", "frame", "at").mapInPandas(run, T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds)]))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """The index and the folder of the archives of all rows of pages, in the shared folder unless given."""
    folder = folder or f"{shared_root(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return write(plan(pages, id_col, url_col, payload_col), folder), folder


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from archives.

    A null payload is written as an empty one, a page without URL under a name of its own; a null id stays
    null; repeated rows are records of their own; an empty table writes no bundle. Archives stay in folder if
    that is given; otherwise they are deleted after they were read.
    """
    records, where = archive(pages, id_col, url_col, payload_col, folder)
    back = cut(read(records, where).drop("payload", "record_id"))
    if not folder:
        remove(pages.sparkSession, where)
    return back.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
