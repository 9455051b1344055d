"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a seek
table in a skippable frame at its end (the seekable format: sizes of every frame before and after
compression, their number, and a magic number as the last four bytes). The index maps a record's
id to its bundle, frame and offset within the frame, so one record is read by seeking to its
frame and decompressing that alone. Of records with equal payloads one is the response, the
others are revisits that refer to it and hold no payload.

Bundles are written by executors under names that no other attempt uses, and the manifest that
lists them is a written table: files of lost or repeated attempts are not in it and are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import join_groups, materialise, scratch_path

#: Bytes of records (before compression) from which on a frame is closed; a larger record has its own frame.
FRAME_BYTES = 1 << 20
LEVEL = 3
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Payloads smaller than this are never revisits.
LEAST_BYTES = 0
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
MANIFEST = "bundle string, frame int, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint, page_id bigint, record_type string, refers_to bigint"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit if it refers to a page."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        block = b""
    else:
        head += ["Content-Type: application/http; msgtype=response"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and where the next record starts."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if data[end + 4 + len(block) : end + 8 + len(block)] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return head, block.partition(b"\r\n\r\n")[2], end + 8 + len(block)


class BundleWriter:
    """Writes records to frames of one bundle; rows for the manifest come with each closed frame."""

    def __init__(self, out, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.at, self.table, self.held, self.size, self.rows = 0, [], [], 0, []

    def add(self, record: bytes, *about) -> list[tuple]:
        self.rows.append((self.size, len(record), *about))
        self.held.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        frame = self.compressor.compress(b"".join(self.held))
        self.out.write(frame)
        rows = [(len(self.table), self.at, len(frame), *r) for r in self.rows]
        self.table.append((len(frame), self.size))
        self.at += len(frame)
        self.held, self.size, self.rows = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC))
        return rows


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of every frame, read from a bundle's end."""
    file.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - entry * frames)
    raw, out, at = file.read(entry * frames), [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", raw, entry * i)
        out.append((at, packed, plain))
        at += packed
    return out


def _open(path: str):
    """The store and path that a URI names, for any store that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), *[(x, pa.int64()) for x in ("frame_offset", "frame_bytes", "record_offset", "record_bytes", "page_id")], ("record_type", pa.string()), ("refers_to", pa.int64())])

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(path, *r) for r in found]), schema)], schema=schema)

        fs, writer, out, path = None, None, None, ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                if writer is None:
                    fs, root = _open(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(_open(path)[1], compression=None)
                    writer = BundleWriter(out)
                page, other = page_id.as_py(), refers_to.as_py()
                record = warc_record(page, url.as_py(), (html.as_py() or "").encode("utf-8", "replace"), other)
                if found := writer.add(record, page, "response" if other is None else "revisit", other):
                    yield rows(found)
        if writer is not None:
            found = writer.close()
            out.close()
            if found:
                yield rows(found)

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes bundles with a record per row of pages (page_id, url, html) to folder and returns the index (MANIFEST).

    Null html has an empty payload. Of records with equal payloads (of least_bytes or more) that
    with the smallest page_id is the response; null ids come last. Rows repeated under one id
    are a record each, all of one type if their payloads are equal. An empty table gives no
    bundle; other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    sha = F.sha2("html", 256)
    rows = materialise(pages.select("page_id", F.octet_length("html").alias("size"), sha.alias("sha")), "payloads")
    same = rows.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialise(same.filter("n > 1 and first is not null"), "repeated")
    # who revisits whom is found out among ids; payloads are only joined with what their own page and digest refers to
    record = F.concat_ws(" ", "page_id", "sha")
    revisits = join_groups(rows.select("page_id", "sha"), repeated, "sha", "n").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = materialise(revisits.groupBy(record.alias("record")).agg(F.first("first").alias("refers_to"), F.count("*").alias("copies")), "revisits")
    marked = join_groups(pages.select("page_id", "url", "html", sha.alias("sha")).select("page_id", "url", "html", record.alias("record")), revisits, "record", "copies", "left")
    return materialise(marked.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), MANIFEST), "manifest")


READ = "page_id bigint, record_type string, refers_to bigint, payload_digest string, payload binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle, offset, size in zip(*batch.columns):
            fs, path = _open(bundle.as_py())
            with fs.open_input_file(path) as f:
                f.seek(offset.as_py())
                data, at, out = unpack.decompressobj().decompress(f.read(size.as_py())), 0, []
            while at < len(data):
                head, payload, at = parse_record(data, at)
                number = lambda k: int(head[k]) if head.get(k) else None
                out.append((number("X-Page-ID"), head["WARC-Type"], number("X-Refers-To-Page-ID"), head["WARC-Payload-Digest"].removeprefix("sha1:"), payload))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], READ.replace(" bigint", "").replace(" string", "").replace(" binary", "").split(", "))


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles of an index (READ), each frame read by a seek of its own; revisits have no payload here."""
    frames = index.select("bundle", "frame_offset", "frame_bytes").distinct()
    return frames.repartition("bundle", "frame_offset").mapInArrow(_reader, READ)


def read_record(index: DataFrame, page_id: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one page's record, from its frame alone."""
    row = index.filter(F.col("page_id") == page_id).orderBy("record_type").first()
    fs, path = _open(row["bundle"])
    with fs.open_input_file(path) as f:
        f.seek(row["frame_offset"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(row["frame_bytes"]))
    return parse_record(data, row["record_offset"])[:2]


def resolve(records: DataFrame) -> DataFrame:
    """read_archives' rows with payload_bytes and payload_digest of the full payload; revisits have them from the response they refer to.

    The digest is computed anew from the payload that was read, and must be the header's.
    """
    sha1 = F.sha1("payload")
    facts = records.select(
        "page_id",
        "record_type",
        "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("payload_digest").alias("said"),
        sha1.alias("sha1"),
    )
    facts = materialise(facts, "records")
    # an id may have several payloads, so a revisit's own is the one with its digest
    target = lambda page: F.concat_ws(" ", F.col(page).cast("string"), "said").alias("target")
    revisits = facts.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "said", target("refers_to"))
    wanted = revisits.groupBy("target").agg(F.count("*").alias("n"))
    originals = facts.filter("record_type = 'response'").groupBy(target("page_id")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("sha1").alias("sha1"))
    originals = materialise(originals.join(wanted, "target"), "originals")
    found = join_groups(revisits, originals, "target", "n").drop("n", "target")
    whole = facts.filter("record_type = 'response'").unionByName(found)
    ok = F.col("said") == base32(F.col("sha1"))
    return whole.select("page_id", "payload_bytes", F.when(ok, F.col("said")).otherwise(F.raise_error(F.lit("a payload isn't what its digest says"))).alias("payload_digest"), "record_type", "refers_to")


def base32(hexes):
    """Upper-case base32 of 20 bytes in hex, five bits a character."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)]
    return F.concat(*[F.substring(alphabet, (F.shiftright(g, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for g in groups for j in range(8)])


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages to archives (in the shared scratch folder if none is given) and reads all of them back."""
    spark: SparkSession = pages.sparkSession
    return resolve(read_archives(write_archives(pages, folder or scratch_path(spark, "warc"), least_bytes)))
