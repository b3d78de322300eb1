"""WARC archives: one gzip member a record, and a sequential reader.

Writer: payload digests are counted first (one row a digest moves, not the
payloads): of equal payloads of at least ``least`` bytes the one with the largest
id is stored, the others refer to it and carry no payload. The digests that recur
are broadcast if there are at most ``TOLD`` of them, so that payloads aren't
shuffled; beyond that rows are joined by digest, payloads with them. Tasks write
their records straight to archives in a folder that all executors reach (by default
under spark.checkpoint.dir; local paths, or any store that pyarrow opens). Every
attempt writes files of its own names and the manifest has those of the attempts
that counted, so lost executors and repeated tasks do no harm.

Reader: each archive is read in order, a chunk at a time: incremental zlib finds
the members' ends, Content-Length frames header and block, the block's SHA-1 must
be the declared one (WARC-Block-Digest), and a full payload's must be its payload
digest. Memory is one record.

Defined cases: a null html is an empty payload; a null url becomes an empty
target; null ids are written as an empty id and come back null (among equal
payloads they are the smallest; where all ids are null, one row is the response
and refers_to of the others is null); of rows that share the largest id of their
payload one is the response (the first by target), the others refer to it; other columns are ignored; an empty table gives no archive and no
rows; a damaged archive raises an error.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import scan

#: Payloads below this many bytes are always stored.
LEAST = 1000
#: Bytes after which a task begins another archive, and bytes read at once.
ARCHIVE, CHUNK = 256 << 20, 1 << 18
#: Recurring digests that are broadcast.
TOLD = 200_000
LEVEL = 6
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """An archive that breaks its own framing or digests."""


@contextmanager
def opened(path: str, mode: str) -> Iterator[BinaryIO]:
    """A file in a folder given as a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode) as f:
            yield f
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_output_stream(inner) if "w" in mode else store.open_input_stream(inner) as f:
            yield f


def record(kind: str, ident: str, url: str, payload: bytes, digest: str, refers: str = "") -> bytes:
    """One record, uncompressed: header lines, an empty line, the block, two empty lines. Only a response has a payload."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Target-URI: {clean(url)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def clean(url: str) -> str:
    """A header value has no line ends."""
    return " ".join(url.split("\n")).replace("\r", " ")


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(f: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """What each gzip member of a stream holds, one at a time."""
    rest = b""
    while True:
        rest = rest or f.read(chunk)
        if not rest:
            return
        z, out = zlib.decompressobj(31), []
        try:
            while not z.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise Damaged("the archive ends within a member")
                out.append(z.decompress(rest))
                rest = z.unused_data
        except zlib.error as e:
            raise Damaged(f"not a gzip member: {e}") from e
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lowered) and block of one record; checks framing and digests."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise Damaged("no record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no Content-Length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise Damaged("Content-Length does not frame the record")
    digest = "sha1:" + hashlib.sha1(block).hexdigest()
    if fields.get("warc-block-digest") != digest:
        raise Damaged("the block has another digest")
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != digest:
        raise Damaged("the payload has another digest")
    return fields, block


def planned(pages: DataFrame, key: str, url: str, html: str, least: int = LEAST) -> DataFrame:
    """id, url, html, digest, revisit, refers: who refers to whom. Rows are numbered only where several share the largest
    id of their payload; beyond the broadcast the hot digests of the join are split by AQE."""
    t = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), t.alias("html"), F.sha1(t.cast("binary")).alias("digest"))
    big = rows.where(F.octet_length("html") >= least).groupBy("digest", "id").agg(F.count("*").alias("n"))
    again = big.groupBy("digest").agg(F.sum("n").alias("n"), F.max("id").alias("last"), F.coalesce(F.max_by("n", "id"), F.max("n")).alias("tied")).where("n > 1")
    again = scan.cut(again.select(F.col("digest").alias("again"), "last", "tied"))
    again = F.broadcast(again) if again.count() <= TOLD else again
    found = rows.join(again, rows["digest"] == again["again"], "left")
    out = ["id", "url", "html", "digest", "revisit", F.when(F.col("revisit"), F.col("last")).alias("refers")]
    largest = F.col("id").eqNullSafe(F.col("last"))
    tied = F.coalesce(largest & (F.col("tied") > 1), F.lit(False))
    alone = found.where(~tied).withColumn("revisit", F.col("again").isNotNull() & ~largest)
    first = F.row_number().over(Window.partitionBy("digest", "id").orderBy("url"))
    return alone.select(*out).unionByName(found.where(tied).withColumn("revisit", first > 1).select(*out))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Writes the archives; path, records and bytes of each, held in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in zip(*(b.column(c).slice(at, 64).to_pylist() for c in ("id", "url", "html", "digest", "revisit", "refers")), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with opened(path, "wb") as f:
                while ahead is not None and size < archive:
                    ident, where, text, digest, revisit, refers = ahead
                    data = member(record("revisit" if revisit else "response", "" if ident is None else str(ident), where, text.encode(), digest, "" if refers is None else str(refers)), level)
                    f.write(data)
                    size, count = size + len(data), count + 1
                    ahead = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return scan.cut(planned(pages, key, url, html, least).mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in ``path``: page_id, url, record_type, payload_bytes (counted for a response, as
    declared by a revisit), payload_digest, refers_to and the block (the payload of a response; empty for a revisit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                size = 0
                with opened(path, "rb") as f:
                    for data in members(f):
                        h, block = parsed(data)
                        rows.append((_ident(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], len(block) if h["warc-type"] == "response" else int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), _ident(h.get("warc-refers-to", "")), block))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, min(scan.partitions(manifest), manifest.count()))
    return manifest.select("path").repartition(n).mapInArrow(read, ", ".join(f"{n} {t}" for n, t, _ in _FIELDS))


_FIELDS = [("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("refers_to", "long", pa.int64()), ("block", "binary", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _, _ in _FIELDS])


def _ident(field: str) -> int | None:
    inner = field.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def archive_folder(df: DataFrame) -> str:
    """A new folder below spark.checkpoint.dir."""
    scan.shared_dir(df)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = read_archives(write_archives(pages, archive_folder(pages)))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), x AS (
  SELECT page_id, n, sha1(h) AS d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS last FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM x
"""
