"""A deterministic, sharded WARC writer, and a reader.

Records are range-sorted by page_id; each is its own gzip member; files roll when their compressed
size passes a bound and start with a warcinfo record. Identifiers, dates and digests come from the
page alone, so that a repeated task writes the same bytes. Files are committed through temporary
names and a manifest (see ``files``).

Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest
page_id is a response and the others are revisits that refer to it.

Defined cases: a null html is the empty payload; a null url gives a record without target; rows
that repeat the smallest page_id of their payload are responses all; a null page_id never is the
one referred to; a page larger than the bound gets a file that passes the bound by that record;
extra columns are ignored; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import files
from wordloom.session import new_folder, ship_package, stored

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, kind: str = "page") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{page_id}')}>"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    # a header value holds no line ends: they are percent-encoded, all else stays
    lines = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    block = b"software: wordloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))


def with_references(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of each page."""
    rows = payloads(pages)
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    shared = keyed.where((F.col("n") >= min_revisit_bytes) & (F.col("n") > 0)).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = stored(shared.select(F.col("digest").alias("shared_digest"), "first_id"), "warc-shared")
    full = rows.where(F.octet_length("payload") > 0)
    joined = full.join(shared, F.sha1("payload") == F.col("shared_digest"), "left").drop("shared_digest")
    # empty payloads, often very many, share one digest and needn't meet in one task
    empty = rows.where(F.octet_length("payload") == 0)
    first = keyed.where("n = 0").agg(F.min("page_id")).first()[0] if min_revisit_bytes <= 0 else None
    joined = joined.unionByName(empty.withColumn("first_id", F.lit(first).cast("bigint")))
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> dict:
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done, out, n = None, 0, [], None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for page_id, url, payload, refers_to, own in zip(*(some.column(i).to_pylist() for i in range(5))):
                    if own != part:
                        if out is not None:
                            done.append((part, seq, out.commit(), n))
                        part, seq, out = own, 0, None
                    if out is None:
                        stem = f"pages-{part:06d}-{seq:05d}"
                        out, n = files.Pending(folder, stem, ".warc.gz"), 0
                        out.write(member(info_record(stem, date)))
                    out.write(member(record(page_id, url, payload, refers_to, refers_to is not None, date)))
                    n += 1
                    if out.size >= file_bytes:
                        done.append((part, seq, out.commit(), n))
                        seq, out = seq + 1, None
        if out is not None:
            done.append((part, seq, out.commit(), n))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["part", "seq", "name", "n"])

    # the payload's hash orders rows of one page_id and lets them be dealt to several files
    ordered = files.dealt(with_references(pages, min_revisit_bytes), F.col("page_id"), F.xxhash64("payload", "url"), F.octet_length("payload"), payloads(pages))
    found = sorted(ordered.mapInArrow(run, "part int, seq int, name string, n bigint").collect())
    manifest = {"files": [{"names": [f.name], "n_records": f.n} for f in found]}
    files.write_manifest(folder, manifest)
    return manifest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def members(source, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The content of each gzip member of an open file, one at a time."""
    state, parts, data = zlib.decompressobj(31), [], b""
    while data := data or source.read(read_bytes):
        parts.append(state.decompress(data))
        data = state.unused_data
        if state.eof:
            yield b"".join(parts)
            state, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the last member is cut off")


def page_of(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of SCHEMA; checks digests. Records of other types give None."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a block doesn't match its digest")
    # a revisit keeps the HTTP header of the full answer, and so its length
    length = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
        raise ValueError("a payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("x-page-id"), fields.get("warc-target-uri"), length, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row of SCHEMA for each page record of the committed files, a task per file."""
    ship_package(spark)
    names = [(n,) for f in files.read_manifest(folder)["files"] for n in f["names"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        labels = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    system, path = files.resolve(folder)
                    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
                        for data in members(source):
                            if row := page_of(*parse(data)):
                                yield row

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[6] or b"") + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], labels)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], labels)

    return spark.createDataFrame(names, "name string").repartition(max(1, len(names))).mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, min_revisit_bytes)
    return read(pages.sparkSession, folder)
