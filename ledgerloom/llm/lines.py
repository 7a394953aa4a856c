"""Removal of lines that many documents have, as bitmaps of the lines to keep.

Every line is a row of its key's hash, its document and its place, without its text. The rows are range-partitioned by
hash and document and sorted by hash, document and place, so a task streams the occurrences of each key in order and
counts documents by their first one. A task holds the rows of fewer than ``least`` documents: from then on a key's
verdict is known. A key that many documents have, such as a line of a third of all, is cut into several ranges; each
range reports how many documents its first and its last key have in it, and the few rows that this leaves open are
judged by the sums. The result has one row for each document, with a compressed bitmap of the lines it keeps; text is read again
only where a bitmap is applied.

A line's key is the line without space bytes at both ends and with A-Z in lower case, told from others by 128 bits.

Defined results: a null or empty text is one empty line. Lines whose keys are shorter than ``least_chars`` stay. Rows that
repeat id and text count as documents of their own and share a bitmap. Rows of one id, or without id, are told
apart by 64 bits of the text; null ids come last in the order of documents. An empty table gives an empty result; only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.workers import in_arrow, text_batches
from ledgerloom.workspace import staged

LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
HASH, DOC = ["hash_a", "hash_b"], ["doc_id", "text_key"]
LINE = [*HASH, *DOC, "place", "copies"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def line_rows(least_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()))
            copies = Counter(rows)
            digests, owners, places, counts = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n = copies.pop(rows[i], 0)  # equal rows of a batch go on as one
                if not n:
                    continue
                for place, line in enumerate((text or b"").lower().split(b"\n")):
                    line = line.strip()  # of bytes, strip and lower know the six spaces and A-Z only
                    if line and (least_chars <= 1 or len(line.decode("utf-8", "replace")) >= least_chars):
                        digests.append(xxhash.xxh3_128_digest(line))
                        owners.append(i)
                        places.append(place)
                        counts.append(n)
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column("doc_id").take(of),
                batch.column("text_key").take(of), pa.array(places, pa.int32()), pa.array(counts, pa.int64())], names=LINE)

    return work


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the one before in some column."""
    new = np.ones(len(columns[0]), bool)
    for i, c in enumerate(columns):
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        differs = codes[1:] != codes[:-1]
        new[1:] = differs if i == 0 else new[1:] | differs
    return new


class Range:
    """The keys of a sorted range of lines, judged as its rows go by."""

    def __init__(self, least: int, keep_first: bool):
        self.least, self.keep_first = least, keep_first
        self.held: pa.Table | None = None  # of the last key, rows of fewer than ``least`` documents
        self.settled = None  # of the last key, once enough documents have it: its hash
        self.before, self.last_doc, self.ended = 0, None, 0  # documents counted since, the last of them, keys that ended

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([batch]).select(LINE)
        if self.settled is not None:
            key = [rows.column(c).combine_chunks() for c in HASH]
            same = int(np.argmin(np.append(
                (key[0].to_numpy() == self.settled[0]) & (key[1].to_numpy() == self.settled[1]), False)))
            if same:
                part = rows.slice(0, same)
                self.before += self.documents(part, self.last_doc)[-1]
                self.last_doc = self.doc_of(part)
                yield self.out(part, np.zeros(same, bool))
            rows = rows.slice(same)
            if rows.num_rows:
                yield from self.close(None)
        if rows.num_rows:
            yield from self.judge(rows)

    def judge(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows if self.held is None else pa.concat_tables([self.held, rows])
        self.held = None
        new = np.flatnonzero(changes([rows.column(c).combine_chunks() for c in HASH]))
        if len(new) > 1:
            whole = rows.slice(0, new[-1])
            if not self.ended:  # the range's first key may have begun in another
                yield from self.close(whole.slice(0, new[1]))
                whole = whole.slice(new[1])
            self.ended += 1
            if whole.num_rows:
                key = np.cumsum(changes([whole.column(c).combine_chunks() for c in HASH])) - 1
                firsts = self.firsts(whole, None)
                n = np.bincount(key, firsts)
                drop = n[key] >= self.least
                if self.keep_first:
                    drop[np.flatnonzero(np.diff(key, prepend=-1))] = False
                yield self.out(whole.filter(pa.array(drop)), None)
        last = rows.slice(new[-1])
        n = self.documents(last, None)[-1]
        if n < self.least:
            self.held = last
            return
        self.settled = tuple(last.column(c)[0].as_py() for c in HASH)
        self.before, self.last_doc = n, self.doc_of(last)
        self.first = last.slice(0, 1)
        lead = np.zeros(last.num_rows, bool)
        lead[0] = self.keep_first
        if self.keep_first and self.ended:  # this range holds the key's first line, which stays
            last, lead = last.slice(1), lead[1:]
        yield self.out(last, lead)

    def close(self, rows: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """The end of the range's first or last key, or of one that is settled: its rows, if they are held, and its sum."""
        if rows is not None:
            yield self.out(rows, np.ones(rows.num_rows, bool))
            first, n = rows.slice(0, 1), self.documents(rows, None)[-1]
        else:
            first, n = self.first, self.before
        self.settled, self.ended = None, self.ended + 1
        yield pa.RecordBatch.from_arrays(
            [first.column(c).combine_chunks() for c in (*HASH, *DOC, "place")]
            + [pa.array([int(n)], pa.int64()), pa.array([False])], names=OUT)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.settled is not None or self.held is not None:
            yield from self.close(self.held)

    @staticmethod
    def doc_of(rows: pa.Table) -> tuple:
        """The key's last document, and the place of its first line."""
        doc = tuple(rows.column(c)[rows.num_rows - 1].as_py() for c in DOC)
        new = np.flatnonzero(changes([rows.column(c).combine_chunks() for c in (*HASH, *DOC)]))
        return (*doc, rows.column("place")[int(new[-1])].as_py())

    def firsts(self, rows: pa.Table, after: tuple | None) -> np.ndarray:
        """For each row, the documents that it is the first line of: as many as copies of the row are there."""
        new = changes([rows.column(c).combine_chunks() for c in (*HASH, *DOC)])
        place = rows.column("place").to_numpy()
        start = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        first_place = place[start]
        if after is not None and tuple(rows.column(c)[0].as_py() for c in DOC) == after[:2]:
            first_place = np.where(start == 0, after[2], first_place)
        return np.where(place == first_place, rows.column("copies").to_numpy(), 0)

    def documents(self, rows: pa.Table, after: tuple | None) -> np.ndarray:
        return np.cumsum(self.firsts(rows, after))

    def out(self, rows: pa.Table, is_open: np.ndarray | None) -> pa.RecordBatch:
        flags = np.zeros(rows.num_rows, bool) if is_open is None else is_open
        return pa.RecordBatch.from_arrays(
            [rows.column(c).combine_chunks() for c in (*HASH, *DOC, "place")]
            + [pa.nulls(rows.num_rows, pa.int64()), pa.array(flags)], names=OUT)


OUT = [*HASH, *DOC, "place", "documents", "open"]


def judged_rows(least: int, keep_first: bool):
    """Lines to drop; lines that the range alone can't judge (``open``); and the sums (``documents``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Range(least, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from keys.add(batch)
        yield from keys.end()

    return work


def bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, n_dropped = [], []
        for n, places in zip(b.column("n_lines").to_pylist(), b.column("dropped")):
            bits = np.ones(n, bool)
            bits[places.values.to_numpy(zero_copy_only=False)] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            n_dropped.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), b.column("n_lines"), pa.array(n_dropped, pa.int64()),
             pa.array(keep, pa.binary())], names=[*DOC, "n_lines", "n_dropped", "keep"])


def keep_bitmaps(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, keep_first: bool = False, least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) for each distinct (doc_id, text) of ``docs``.

    Lines whose key stands in at least ``least`` documents are dropped; with ``keep_first``, all but the first one. ``keep``
    has a bit for each line, packed from the highest on and compressed by zlib.
    """
    texts, id_type = keyed(docs), dict(docs.dtypes)["doc_id"]
    doc = f"doc_id {id_type}, text_key long"
    lines = staged(in_arrow(
        texts, line_rows(least_chars), f"hash_a long, hash_b long, {doc}, place int, copies long"), "lines")
    order = [*HASH, F.asc_nulls_last("doc_id"), F.col("text_key")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "place")
    judged = staged(in_arrow(
        ranged, judged_rows(least, keep_first), f"hash_a long, hash_b long, {doc}, place int, documents long, open boolean"),
        "judged")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), *DOC, "place")
    sums = judged.where("documents IS NOT NULL").groupBy(*HASH).agg(
        F.sum("documents").alias("n"), F.min(first).alias("first"))
    drop = F.col("n") >= least
    if keep_first:
        drop &= ~first.eqNullSafe(F.col("first"))
    left_open = judged.where("documents IS NULL AND open").drop("documents").join(sums, HASH).where(drop)
    dropped = judged.where("documents IS NULL AND NOT open").select(*DOC, "place").unionAll(left_open.select(*DOC, "place"))
    n_lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"))) + 1
    whole = texts.select(*DOC, n_lines.cast("long").alias("n_lines"), F.lit(None).cast("int").alias("place"))
    marked = whole.unionAll(dropped.select(*DOC, F.lit(None).cast("long").alias("n_lines"), "place"))
    of_docs = marked.groupBy(*DOC).agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("dropped"))
    return in_arrow(of_docs, bitmap_rows, f"{doc}, n_lines long, n_dropped long, keep binary")


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        kept = []
        for text, bitmap in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keep").to_pylist()):
            lines = (text or b"").split(b"\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
            kept.append(b"\n".join(lines[i] for i in np.flatnonzero(bits)))
        out = batch.drop_columns(["text", "keep"])
        yield out.append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))


def applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each row of ``docs`` with the lines that its bitmap keeps."""
    d, b = keyed(docs).alias("d"), bitmaps.alias("b")
    same = (F.col("d.text_key") == F.col("b.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    met = d.join(b, same).select("d.doc_id", "n_lines", "n_dropped", "text", "keep")
    return in_arrow(met, kept_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return applied(docs, keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key),
kept AS (SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM marked GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN d USING (row)
"""
