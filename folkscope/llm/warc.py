"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent zstd frames, each holding some whole WARC records, then a
skippable frame with the seek table: compressed and plain size and a checksum of every
frame (the public seekable format of the zstd project). A record is found by its frame and
its offset in the plain frame, so one record costs one frame to read.

Each task streams its pages into a bundle of its own, frame by frame, and returns one
index row per record; bundles that the committed index does not name are leftovers of lost
tasks (``files``).

Defined cases: null html is empty; a null url is written empty and line breaks in a url
are percent-encoded; of records with equal payloads those with the largest page_id are
responses (more than one if that page_id is repeated) and the others revisit it; a null
page_id counts as smaller than any other and is written without a name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.files import attempt_file, create, open_input
from folkscope.llm.registry import read_table, register
from folkscope.session import materialise, scratch_path

FRAME_BYTES = 1 << 20  # plain bytes after which a frame is closed
BUNDLE_BYTES = 1 << 28  # compressed bytes after which a bundle is closed
TASK_FRAMES = 8  # frames that one task reads back
ZSTD_LEVEL = 3
DATE = "2025-01-01T00:00:00Z"  # the tables hold no time of capture

# The seekable format's magic numbers and its descriptor with checksums.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def record_uuid(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'page:{page_id}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit names what it refers to and carries no payload."""
    block = b"" if refers_to is not None else payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uuid(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uuid(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(plain: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    end = plain.index(b"\r\n\r\n", offset)
    version, *lines = plain[offset:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {offset}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {offset} does not end where its length says")
    return headers, plain[start:stop], stop + 4


class BundleWriter:
    """Collects records into frames, writes each frame as it fills, and the seek table at the end."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.uri, self.frame_bytes = uri, frame_bytes
        self.out = create(uri)
        self.packer = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        self.table: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.filled = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its offset in the plain frame."""
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.filled
        self.parts.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if not self.parts:
            return
        import xxhash

        plain = b"".join(self.parts)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.written += len(packed)
        self.parts, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Reads the seek table from the end of a bundle, then any frame by its number."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 12 * frames)
        self.table = list(struct.iter_unpack("<III", self.file.read(12 * frames)))
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        import xxhash
        import zstandard

        packed, plain_size, checksum = self.table[number]
        self.file.seek(self.starts[number])
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain_size)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        return plain


INDEX = "page_id long, bundle string, frame int, record_offset long"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("record_offset", pa.int64())])


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the largest page_id of those with an equal payload, null for that page itself.

    Payloads are compared by SHA-256 and length; the largest page_id of a payload is found
    with partial aggregation over digests. The join back may meet a payload that many pages
    share: the other side has one row for it, so AQE can split its partition.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    long_enough = F.octet_length("payload") >= min_bytes
    groups = (
        pages.where(long_enough)
        .groupBy(F.sha2("payload", 256).alias("group_digest"), F.octet_length("payload").alias("group_bytes"))
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and latest is not null")
    )
    groups = materialise(groups.select("group_digest", "group_bytes", "latest"), "warc-groups")
    same = (F.sha2("payload", 256) == F.col("group_digest")) & (F.octet_length("payload") == F.col("group_bytes"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("latest")), None).otherwise(F.col("latest"))
    return pages.join(groups, same, "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per page below ``folder``; returns the index, committed there as a table.

    ``pages`` has page_id, url and html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            places = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = BundleWriter(attempt_file(folder, "bundle", ".warc.zst"), frame_bytes)
                frame, offset = bundle.add(record(page_id, url, payload, refers_to))
                places.append((page_id, bundle.uri, frame, offset))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            columns = zip(*places, strict=True) if places else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)
        if bundle is not None:
            bundle.close()

    index = mark_revisits(pages, min_bytes).mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, block_sha1 string"
)
READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("block_sha1", pa.string()),
])


def read_bundles(index: DataFrame, task_frames: int = TASK_FRAMES) -> DataFrame:
    """Every record that the index names, read from its frame; each frame is one unit of work.

    The index is small beside what it names, so the number of tasks is counted from its frames
    and named: by the size of the index alone a few tasks would read everything. A response's
    payload is checked against its digest. Fails on a record that is not where the index says.
    """
    n_frames = index.select("bundle", "frame").distinct().count()
    spread = index.repartition(max(1, -(-n_frames // task_frames)), "bundle", "frame")
    frames = spread.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_offset", "page_id")).alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            for bundle, frame, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    reader, name = BundleReader(bundle), bundle
                plain, rows = reader.frame(frame), []
                for place in sorted(records, key=lambda r: r["record_offset"]):
                    headers, block, _ = parse_record(plain, place["record_offset"])
                    page_id = int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None
                    if page_id != place["page_id"]:
                        raise ValueError(f"index of {bundle} names another record at frame {frame}, {place['record_offset']}")
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    block_digest = sha1_base32(block)
                    if kind == "response" and block_digest != digest:
                        raise ValueError(f"payload of page {page_id} does not match its digest")
                    refers_to = headers.get("X-Refers-To-Page")
                    rows.append({
                        "page_id": page_id, "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest,
                        "record_type": kind, "refers_to": int(refers_to) if refers_to else None,
                        "url": headers.get("WARC-Target-URI"), "block_sha1": block_digest,
                    })
                yield pa.RecordBatch.from_pylist(rows, READ_ARROW)

    return frames.mapInArrow(run, READ)


BASE32_SQL = """
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(d, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT + 1, 1)), '')
"""


@register(
    "op8_warc_bundles",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest,
        CASE WHEN latest IS NULL OR page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id IS NOT DISTINCT FROM latest THEN NULL ELSE latest END AS refers_to
    FROM g
    """,
)
def op8_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to bundles and read back."""
    index = write_bundles(read_table(spark, folder, "pages"), scratch_path(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
