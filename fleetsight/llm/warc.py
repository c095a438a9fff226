"""WARC archives: write whole-file gzip streams, rewrite them member by member with an offset index, read back.

``write_archives`` lays records out as Spark text with the record separator as line end and gzip over the
whole file. ``normalize`` inflates each such stream once, in pieces, and writes every record as a gzip
member of its own, with a sidecar index of offset, length and record id beside the archive. ``read_archives``
reads records by that index. Files go to a folder that driver and executors share; an archive is written
under a temporary name and moved, so that a repeated task leaves the same file.

Defined results: a null html is an empty payload; of pages with equal payloads that with the largest id is
the response and the others revisit it (rows that repeat that id are all responses); payloads under
``least_bytes`` are always responses; a page without an id never is the one referred to and revisits one
that is; white space in a url is escaped in the header.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.session import checkpointed, scratch_folder

SEPARATOR = "\r\n\r\n"
RECORDS_PER_FILE = 5_000
PIECE = 1 << 16
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_FROM = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: four times 40 bits as eight digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, refers_to``: the page whose payload a row repeats, null for responses.

    Digests are written once, grouped and joined without the payloads; a payload that fills a third of the
    pages is one row of the grouped side.
    """
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1("html"))
    large = checkpointed(chosen.filter(F.octet_length("html") >= least_bytes).select("page_id", "sha1"))
    first = large.groupBy("sha1").agg(F.max("page_id").alias("refers_to"))
    repeats = large.distinct().join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    repeats = repeats.filter("refers_to IS NOT NULL").select(
        F.col("page_id").alias("repeat_id"), F.col("sha1").alias("repeat_sha1"), "refers_to"
    )
    same = chosen.page_id.eqNullSafe(repeats.repeat_id) & (chosen.sha1 == repeats.repeat_sha1)
    return chosen.join(repeats, same, "left").drop("repeat_id", "repeat_sha1")


def record(page: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """One WARC record without the separator after it."""
    end = "\r\n"
    size, revisit = F.octet_length(html), F.col("refers_to").isNotNull()
    urn = lambda name: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(name).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), size, F.lit(end * 2))
    head = [
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), urn(page),
        F.lit(f"{end}WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\s\x00-\x1f]", "%20"),
        F.lit(f"{end}WARC-Date: 2024-01-01T00:00:00Z{end}WARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.lit(f"{end}WARC-Payload-Length: "), size,
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {REVISIT_PROFILE}{end}WARC-Refers-To: "), urn("refers_to"))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + size),
        F.lit(end * 2), F.when(revisit, "").otherwise(F.concat(http, F.col(html))),
    ]
    return F.concat(*[part.cast("string") for part in head])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Whole-file gzip archives, each with up to ``RECORDS_PER_FILE`` records."""
    rows = with_roles(pages, least_bytes).select(record().alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", SEPARATOR).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def inflated(content: bytes) -> Iterator[bytes]:
    """The stream in pieces, whether it is one member or many."""
    view, at, stream = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view):
        piece = stream.decompress(view[at : at + PIECE])
        at += PIECE
        if stream.eof:
            at = min(at, len(view)) - len(stream.unused_data)
            stream = zlib.decompressobj(31)
        if piece:
            yield piece


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the separator after them, from pieces of a stream; holds one record at a time."""
    held = bytearray()
    mark = SEPARATOR.encode()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        looked = 0
        while (end := held.find(mark, looked)) < 0:
            looked = max(0, len(held) - len(mark) + 1)
            if not fill(len(held) + 1):
                if held:
                    raise ValueError("archive ends within a record")
                return
        size = end + 2 * len(mark) + int(headers(bytes(held[:end]))["content-length"])
        if not fill(size):
            raise ValueError("archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _rewrite(target: str):
    """Archives in, their members and index written, one row per archive out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py().rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt")
                store, folder = _filesystem(target)
                store.create_dir(folder, recursive=True)
                index, offset, draft = [], 0, f"{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    for body in records(inflated(content.as_buffer().to_pybytes())):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(body) + packer.flush()
                        out.write(member)
                        found = headers(body[: body.index(SEPARATOR.encode())])
                        index.append({"offset": offset, "length": len(member), "id": found["warc-record-id"]})
                        offset += len(member)
                with store.open_output_stream(f"{draft}-index", compression=None) as out:
                    out.write("".join(json.dumps(entry) + "\n" for entry in index).encode())
                store.move(f"{draft}-index", f"{folder}/{name}.warc.gz.index")
                store.move(draft, f"{folder}/{name}.warc.gz")
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([len(index)]), pa.array([offset])], ["archive", "n_records", "n_bytes"])

    return run


def normalize(spark: SparkSession, source: str, target: str) -> DataFrame:
    """``archive, n_records, n_bytes``: every archive of ``source`` rewritten under ``target``, with its index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    return checkpointed(files.mapInArrow(_rewrite(target), "archive string, n_records long, n_bytes long"))


def _read(source: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset", "member_length"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def number(urn: str | None) -> int | None:
        value = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
        return None if value == "none" else int(value)

    def row(member: bytes, name: str, offset: int) -> tuple:
        body = zlib.decompress(member, 31)
        end = body.index(SEPARATOR.encode())
        found = headers(body[:end])
        block = body[end + 4 : -4]
        if found["warc-type"] == "revisit":
            size, digest = int(found["warc-payload-length"]), found["warc-payload-digest"].removeprefix("sha1:")
        else:
            payload = block[block.index(SEPARATOR.encode()) + 4 :]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        refers_to = number(found["warc-refers-to"]) if "warc-refers-to" in found else None
        return number(found["warc-record-id"]), size, digest, found["warc-type"], refers_to, name, offset, len(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py().rsplit("/", 1)[-1]
                store, folder = _filesystem(source)
                with store.open_input_stream(f"{folder}/{name}.index", compression=None) as file:
                    entries = [json.loads(line) for line in file.read().splitlines()]
                body = memoryview(content.as_buffer())
                rows = [row(bytes(body[e["offset"] : e["offset"] + e["length"]]), name, e["offset"]) for e in entries]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the normalised archives in ``folder``, read member by member by the index.

    Size and digest of a response are those of the payload found; a revisit states them in its header.
    """
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long,"
        " archive string, member_offset long, member_length long"
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.mapInArrow(_read(folder), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all pages through the shared folder."""
    spark = pages.sparkSession
    whole, members = scratch_folder(spark, "warc-whole"), scratch_folder(spark, "warc")
    write_archives(pages, whole, least_bytes)
    if not normalize(spark, whole, members).filter("n_records > 0").isEmpty():
        return read_archives(spark, members)
    return spark.createDataFrame([], read_archives(spark, whole).schema)
