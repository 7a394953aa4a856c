"""WARC archives, written and read as tables of chunks.

A payload is cut into numbered chunks before it is shuffled, so no task holds a whole record: the writer gets the
chunks of a record in order and streams them, carrying the record's digest along, and the reader gives out chunks as it
meets them. The records of an archive are gzip members of their own. Of equal payloads one record is the response,
the others are revisits that refer to it and store no payload.

A record's HTTP header has the length of the payload, of a revisit too; the WARC header has the payload's SHA-1. The
writer fails if the digest it has carried differs from the one the header was written with, and so does the reader.

Defined results: a null payload is empty. Rows that repeat the largest id among equal payloads are all responses, with one
record id; null ids come before others, and where all ids are null, all rows are responses. The url is written as it is, without spaces and
control characters, which are percent-encoded; a null one is empty. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.files import reading, writing
from ledgerloom.llm.workers import in_tasks, spread
from ledgerloom.workspace import new_folder, staged

CHUNK = 1 << 18  # bytes of a payload in a row
LEAST_REVISIT = 0  # bytes; smaller payloads are always stored
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digested(pages: DataFrame) -> DataFrame:
    """(row_id, page_id, url, payload, payload_bytes, sha1) for (page_id, url, html).

    Rows are numbered as they are read, so that repeated rows stay apart.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    return p.withColumns({"row_id": F.monotonically_increasing_id(), "sha1": F.sha1("payload"),
                          "payload_bytes": F.octet_length("payload").cast("long")})


def revisits(payloads: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(of_page, of_sha1, refers_to): the pages whose payload another one stores."""
    digests = staged(payloads.where(F.col("payload_bytes") >= least).select("page_id", "sha1").distinct(), "digests")
    stored = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    later = digests.join(stored.where("n > 1").drop("n"), "sha1").where("page_id IS DISTINCT FROM refers_to")
    return later.select(F.col("page_id").alias("of_page"), F.col("sha1").alias("of_sha1"), "refers_to")


def chunked(payloads: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each chunk of a payload, ``chunk`` and ``data``; chunk 0 is there for an empty one too."""
    last = F.greatest(F.ceil(F.col("payload_bytes") / size) - 1, F.lit(0))
    rows = payloads.withColumn("chunk", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return rows.withColumn("data", F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size))).drop("payload")


def planned(pages: DataFrame, least: int = LEAST_REVISIT, size: int = CHUNK) -> DataFrame:
    """The chunks to write, with ``refers_to`` and ``is_response``; those of a record are together and in order.

    Chunks meet their verdicts by page and digest, so equal payloads aren't gathered anywhere. The chunks of a record come
    from one row and go one way through the shuffle, even where it splits a hot key.
    """
    payloads = digested(pages)
    same = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha1") == F.col("of_sha1"))
    rows = chunked(payloads, size).join(revisits(payloads, least), same, "left")
    is_response = F.col("of_sha1").isNull()
    rows = rows.where(is_response | (F.col("chunk") == 0)).select(
        "row_id", "page_id", "url", "payload_bytes", "sha1", "refers_to", is_response.alias("is_response"), "chunk",
        F.when(is_response, F.col("data")).alias("data"))
    return rows.sortWithinPartitions("row_id", "chunk")


def record_id(page_id: str | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha1}')}>"


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def escaped(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def headers(row) -> tuple[bytes, bytes]:
    """The WARC and the HTTP header of a record."""
    page = "" if row.page_id is None else row.page_id
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n"
            f"X-Page: {page}\r\n\r\n").encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if row.is_response else 'revisit'}",
        f"WARC-Record-ID: {record_id(row.page_id, row.sha1)}", f"WARC-Target-URI: {escaped(row.url)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32(row.sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (row.payload_bytes if row.is_response else 0)}"]
    if not row.is_response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row.refers_to, row.sha1)}",
                  f"X-Refers-To-Page: {row.refers_to}"]
    return "\r\n".join(lines).encode() + END, http


class Writer:
    """Streams records into an archive; holds one chunk and the state of a digest and a compressor."""

    def __init__(self, out):
        self.out, self.pack, self.n = out, None, 0

    def begin(self, row) -> None:
        self.end()
        self.pack, self.digest, self.n = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), self.n + 1
        self.expected = row.sha1 if row.is_response else self.digest.hexdigest()
        self.add(b"".join(headers(row)))

    def add(self, data: bytes) -> None:
        self.out.write(self.pack.compress(data))

    def payload(self, data: bytes) -> None:
        self.digest.update(data)
        self.add(data)

    def end(self) -> None:
        if self.pack is not None:
            if self.digest.hexdigest() != self.expected:
                raise ValueError(f"record {self.n}: digest {self.digest.hexdigest()}, not {self.expected}")
            self.out.write(self.pack.compress(END) + self.pack.flush())


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write planned chunks into ``folder``; a row for each archive: path and n_records."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        with ExitStack() as stack:
            for frame in frames:
                for row in frame.where(frame.notna(), None).itertuples(index=False):
                    if writer is None:
                        path = f"{folder}/{row.part:07d}.warc.gz"
                        writer = Writer(stack.enter_context(writing(path)))
                    if row.chunk == 0:
                        writer.begin(row)
                    if row.data is not None:
                        writer.payload(row.data)
            if writer is not None:
                writer.end()
        if writer is not None:
            yield pd.DataFrame({"path": [path], "n_records": [writer.n]})

    return staged(
        in_tasks(chunks.withColumn("part", F.spark_partition_id()), work, "path string, n_records long",
                 ids=("page_id", "refers_to")), "archives")


def _fields(stream: io.BufferedReader) -> tuple[dict[str, str], int]:
    """The fields of a header, after its first line, and the bytes it takes."""
    fields, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b""):
            return fields, size
        name, _, value = line.decode().partition(":")
        fields[name.lower()] = value.strip()


def records_of(path: str, size: int) -> Iterator[tuple[dict, int, bytes, bool]]:
    """The chunks of an archive: (record, number, data, whether it is the record's last)."""
    with reading(path) as file, io.BufferedReader(gzip.GzipFile(fileobj=file)) as stream:
        while stream.readline():
            warc, _ = _fields(stream)
            first = stream.readline()
            http, taken = _fields(stream)
            rest, digest, number = int(warc["content-length"]) - len(first) - taken, hashlib.sha1(), 0
            record = {
                "page_id": int(http["x-page"]) if http["x-page"] else None, "url": warc["warc-target-uri"],
                "record_type": warc["warc-type"], "payload_bytes": int(http["content-length"]),
                "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"),
                "refers_to": int(warc["x-refers-to-page"]) if "x-refers-to-page" in warc else None}
            stored = rest
            while rest > size:
                data = stream.read(size)
                digest.update(data)
                yield record, number, data, False
                rest, number = rest - len(data), number + 1
            data = stream.read(rest)
            digest.update(data)
            if record["record_type"] == "response" and (stored, base32(digest.hexdigest())) != (
                    record["payload_bytes"], record["payload_digest"]):
                raise ValueError(f"{path}: {warc['warc-record-id']} doesn't match its header")
            yield record, number, data, True
            if stream.read(len(END)) != END:
                raise ValueError(f"{path}: {warc['warc-record-id']} doesn't end where it should")


SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
          "archive string, record int, chunk int, data binary, is_last boolean")


def read_chunks(archives: DataFrame, size: int = CHUNK, last_only: bool = False) -> DataFrame:
    """The records of archives as rows of chunks; with ``last_only``, a row for each record, without data."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for frame in frames for p in frame["path"]):
            rows, held, n = [], 0, 0
            for record, number, data, is_last in records_of(path, size):
                if is_last or not last_only:
                    rows.append(record | {"archive": path, "record": n, "chunk": number, "is_last": is_last,
                                          "data": None if last_only else data})
                    held += 200 + (0 if last_only else len(data))
                n += is_last
                if held > 1 << 23:
                    yield framed(rows)
                    rows, held = [], 0
            if rows:
                yield framed(rows)

    def framed(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
            {"page_id": "Int64", "refers_to": "Int64"})

    return in_tasks(spread(archives.select("path")), work, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(planned(pages), new_folder(spark, "warc"))
    return read_chunks(archives, last_only=True).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# the base32 digits of a digest are its bits, five by five
SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha1 FROM pages),
stored AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS stored_by FROM p),
digits AS (
    SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', sha1[i + 1]) - 1) AS hex FROM stored)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(
           (hex[i * 5 // 4 + 1] * 16 + coalesce(hex[i * 5 // 4 + 2], 0)) // CAST(2 ** (3 - i * 5 % 4) AS INT) % 32 AS INT)]),
           '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM stored_by THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stored_by THEN stored_by END AS refers_to
FROM digits"""
