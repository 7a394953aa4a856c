"""Mining of phrases whose words stand together more often than their parts would.

Words are ranked by frequency and numbered by rank. A phrase of k + 1 words is a pair of units: a frequent phrase of k words and the
word after it. The units of a chunk of text are numbered by their frequency in the whole corpus, so the frequent pairs lie in
few tiles of the plane of unit and word; a tile with many pairs is counted at direct addresses with one dense ``bincount``, the pairs of
sparse tiles are sorted as coordinates and counted by runs. Spark adds up the counts of the chunks; the phrases that are
frequent in all are the units of the next turn, ranked anew, up to the longest phrases. A phrase can only be frequent
if both its parts are, the one without its last and the one without its first word, so no other pairs are counted.

A task never holds a vocabulary: a chunk has the numbers of its own words and phrases only, as rows that are sorted beside it.

Defined results: a null text is empty, a null lang is ``und``. Rows that repeat count each time. Words of different langs are
different words. Phrases do not cross pieces or documents. An empty table gives an empty result; only lang and text are
read, so other columns never clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.sums import running
from ledgerloom.llm.workers import in_arrow, text_batches
from ledgerloom.workspace import staged

LEAST = 10
MOST_WORDS = 3
PERCENT = 50  # of its occurrences a phrase has inside one longer phrase, if that one stands for it
TOP = 2000
MILLION = 1_000_000
CHUNK = 1 << 23  # bytes of text that are numbered together
TILE = 1024
DENSE = TILE * TILE // 16  # pairs from which a tile is counted at direct addresses
ROWS = 1 << 16  # rows that a task gives out at once
CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
PACK = pa.Codec("zstd")


# chunks


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of all and compressed."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(numbers).to_bytes(8, "little") + PACK.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(PACK.decompress(data[9:], decompressed_size=n * width, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").reshape(-1)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, tokens, entries): the words of some texts, numbered from 1 on in the chunk and 0 between pieces, and the
    language, word and count of each number."""
    first, made = TaskContext.get().partitionId() << 32, count()

    def fresh():
        numbers = count(1)

        def of_lang() -> dict:
            words: dict[bytes, int] = defaultdict(numbers.__next__)
            words[b""], words[b"\n"] = -1, 0
            return words

        return defaultdict(of_lang), [], 0

    def out() -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        counts = np.bincount(tokens)[1:]
        at = [(n - 1, lang, word) for lang, words in known.items() for word, n in words.items() if n > 0]
        order = np.argsort([a[0] for a in at])
        entries = pa.StructArray.from_arrays([
            pa.array([at[i][1] for i in order], pa.string()),
            pa.array([at[i][2].decode("utf-8", "replace") for i in order], pa.string()), pa.array(counts, pa.int64()),
        ], names=["lang", "word", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([first + next(made)]), pa.array([pack(tokens)], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)], names=["chunk", "tokens", "entries"])

    known, parts, size = fresh()
    for batch in text_batches(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            if not text:
                continue
            words = known["und" if lang is None else lang]
            split = (text.lower().translate(CUTS) + b"\n").replace(b"\n", b" \n ").split(b" ")
            numbers = np.array([words[w] for w in split], np.int64)
            parts.append(numbers[numbers >= 0])
            size += len(text)
        if size > CHUNK:
            yield out()
            known, parts, size = fresh()
    if parts:
        yield out()


def beside(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``chunks`` (chunk, data), each with its ``rows`` (chunk, ...) after it in the same task. Rows stay rows, which Spark
    sorts and hands on in small batches: no list of all rows of a chunk, or of several chunks, is built on the way."""
    both = chunks.unionByName(rows, allowMissingColumns=True)
    place = 2 * F.col("chunk") + F.col("data").isNull().cast("long")  # a single number is sorted by its digits
    return both.repartition("chunk").sortWithinPartitions(place)


def chunks_beside(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """What ``beside`` has put together: each chunk that has rows, its numbers and the columns ``names`` of its rows."""
    chunk, data, parts = 0, b"", []
    for batch in batches:
        numbers, packed = batch.column("chunk"), batch.column("data")
        starts = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for start, end in zip([-1, *starts], [*starts, batch.num_rows]):
            if start >= 0:
                if parts:
                    yield chunk, unpack(data), [np.concatenate(p) for p in zip(*parts)]
                chunk, data, parts = numbers[start].as_py(), packed[start].as_py(), []
            if start + 1 < end:
                parts.append([batch.column(c).slice(start + 1, end - start - 1).to_numpy() for c in names])
    if parts:
        yield chunk, unpack(data), [np.concatenate(p) for p in zip(*parts)]


def encoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks with the numbers that words have in the corpus, from 1 on; 0 for rare words and between pieces."""
    for chunk, tokens, (place, number) in chunks_beside(batches, ["at", "id"]):
        table = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
        table[place + 1] = number + 1
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([pack(table[tokens])], pa.binary())], names=["chunk", "data"])


# counting


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of (a, b), numbers by rank, and how often each is there."""
    if not len(a):
        return a, b, a
    across = int(b.max()) // TILE + 1
    tile = (a // TILE).astype(np.int64) * across + b // TILE
    address = a % TILE * TILE + b % TILE
    tiles, size = np.unique(tile, return_counts=True)
    cells, counts = [], []
    dense = tiles[size >= DENSE]
    for t in dense:
        table = np.bincount(address[tile == t], minlength=TILE * TILE)
        hit = np.flatnonzero(table)
        cells.append(t * TILE * TILE + hit)
        counts.append(table[hit])
    sparse = ~np.isin(tile, dense)
    cell = tile[sparse]  # coordinates in the sparse tiles
    cell *= TILE * TILE
    cell += address[sparse]
    del tile, address, sparse
    cell.sort()
    first = np.ones(len(cell), bool)
    np.not_equal(cell[1:], cell[:-1], out=first[1:])
    new = np.flatnonzero(first)
    cells.append(cell[new])
    counts.append(np.diff(new, append=len(cell)))
    cell, counts = np.concatenate(cells), np.concatenate(counts)
    tile, address = cell // (TILE * TILE), cell % (TILE * TILE)
    return tile // across * TILE + address // TILE, tile % across * TILE + address % TILE, counts


def unit_numbers(words: np.ndarray, phrases: list[np.ndarray], n_words: int) -> np.ndarray:
    """At each place of ``words``, which of the ``phrases`` (a column for each word) begins there; -1 where none does."""
    code, at = phrases[0], words
    for column, after in zip(phrases[1:], (words[i:] for i in range(1, len(phrases)))):
        at = at[:len(after)]
        none = (at < 0) | (after < 0)
        at = at.astype(np.int64)
        at *= n_words
        at += after
        at[none] = -1
        known, code = np.unique(code * n_words + column, return_inverse=True)
        place = np.minimum(np.searchsorted(known, at), len(known) - 1)
        at = np.where(known[place] == at, place, -1).astype(np.int32)
    number = np.zeros(int(code.max(initial=0)) + 2, np.int32)  # the last one is for -1
    number[-1] = -1
    number[code] = np.arange(len(code))
    return number[at]


def pair_rows(k: int):
    """How often the phrases of k + 1 words stand in each chunk, if both of their phrases of k words are frequent."""
    names = ["chunk", *columns(k + 1), "n"]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk"), batch.column("data")):
                yield chunk.as_py(), unpack(data.as_py()), []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, phrases in alone(batches) if k == 1 else chunks_beside(batches, [*columns(k), "f"]):
            words -= 1
            known = np.unique(words[words >= 0])
            if not len(known):
                continue
            local = np.searchsorted(known, words).astype(np.int32)
            local[words < 0] = -1
            del words
            if k == 1:
                units, parts = local, [known]
            else:
                order = np.argsort(-phrases.pop(), kind="stable")
                parts = [p[order] for p in phrases]
                units = unit_numbers(local, [np.searchsorted(known, p) for p in parts], len(known))
            a, b = units[:len(local) - k], local[k:]
            use = (a >= 0) & (b >= 0) & (units[1:len(a) + 1] >= 0 if len(units) > len(a) else True)
            a, b = a[use], b[use]
            del units, local, use
            a, b, n = tile_counts(a, b)
            for i in range(0, len(a), ROWS):
                x, y = a[i:i + ROWS], b[i:i + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), chunk)), *[pa.array(p[x]) for p in parts], pa.array(known[y]),
                     pa.array(n[i:i + ROWS].astype(np.int64))], names=names)

    return work


def columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the words of each language; and for each length the frequent phrases: (id, lang, word, f) of one word,
    (w1, w2, ..., f) by the ids of words of more."""
    chunks = staged(in_arrow(docs.select("lang", "text"), chunk_rows,
                             "chunk long, tokens binary, entries array<struct<lang: string, word: string, n: long>>"), "chunks")
    entries = chunks.select("chunk", F.posexplode("entries").alias("at", "e")).select("chunk", "at", "e.*")
    totals = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    ranked = running(counts, [F.desc("f"), F.col("lang"), F.col("word")], rank=F.lit(1))
    words = staged(ranked.select(F.col("rank_before").alias("id"), "lang", "word", "f"), "words")
    known = entries.join(words, ["lang", "word"]).select("chunk", "at", "id")
    encoded = staged(in_arrow(
        beside(chunks.select("chunk", F.col("tokens").alias("data")), known), encoded_rows, "chunk long, data binary"), "encoded")
    levels, rows = [words], encoded
    for k in range(1, most_words):
        ids = columns(k + 1)
        pairs = in_arrow(rows, pair_rows(k), ", ".join(f"{c} long" for c in ["chunk", *ids, "n"]))
        if k + 1 == most_words:
            levels.append(staged(pairs.groupBy(*ids).agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases"))
            break
        # a phrase has one row for each chunk, so no group is large
        same = Window.partitionBy(*ids)
        of_chunks = pairs.withColumns({"f": F.sum("n").over(same), "first": F.min("chunk").over(same)})
        of_chunks = staged(of_chunks.where(F.col("f") >= least).drop("n"), "phrases")
        levels.append(of_chunks.where(F.col("chunk") == F.col("first")).drop("chunk", "first"))
        rows = beside(encoded, of_chunks.select("chunk", *ids, "f"))
    return totals, levels


# scores


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact to 38 digits."""
    a, left, right = (c.cast("decimal(19, 0)") for c in (a, left, right))
    return F.call_function("div", F.lit(MILLION).cast("decimal(7, 0)") * (a * a), left * right)


def scored(levels: list[DataFrame], percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and more words that no longer one stands for, each at the cut
    where it scores least."""
    out = []
    for k in range(2, len(levels) + 1):
        ids = columns(k)
        longer = [
            levels[m - 1].select(*[F.col(f"w{at + i}").alias(f"w{i}") for i in range(1, k + 1)], F.col("f").alias("longer"))
            for m in range(k + 1, len(levels) + 1) for at in range(m - k + 1)]
        c = levels[k - 1].withColumnRenamed("f", "a")
        if longer:
            most = reduce(DataFrame.unionAll, longer).groupBy(*ids).agg(F.max("longer").alias("longer"))
            stands = 100 * F.coalesce("longer", F.lit(0)) >= percent * F.col("a")
            c = c.join(most, ids, "left").where(~stands).drop("longer")
        for i in range(1, k + 1):
            own = levels[0].select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"),
                                   F.col("f").alias(f"f{i}_{i}"), *(["lang"] if i == 1 else []))
            c = c.join(own, f"w{i}")
        for size in range(2, k):
            for at in sorted({0, k - size}):
                part = levels[size - 1].select(
                    *[F.col(f"w{i}").alias(f"w{at + i}") for i in range(1, size + 1)],
                    F.col("f").alias(f"f{at + 1}_{at + size}"))
                c = c.join(part, [f"w{at + i}" for i in range(1, size + 1)])
        cuts = F.array(*[F.struct(
            score(F.col("a"), F.col(f"f1_{cut}"), F.col(f"f{cut + 1}_{k}")).alias("score"), F.lit(cut).alias("cut"),
            F.col(f"f1_{cut}").alias("l"), F.col(f"f{cut + 1}_{k}").alias("r")) for cut in range(1, k)])
        out.append(c.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(1, k + 1)]).alias("phrase"), "a",
                            F.array_min(cuts).alias("best")))
    return reduce(DataFrame.unionAll, out).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """``phrases`` with their rank in the language, from 1 on, up to ``top``. Ranks come from running sums over ranges of
    all phrases, so no language is sorted in one task."""
    placed = staged(running(phrases, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], one=F.lit(1)), "placed")
    starts = placed.groupBy("lang").agg(F.min("one_before").alias("start"))
    rank = (F.col("one_before") - F.col("start") + 1).cast("long")
    return placed.join(starts, "lang").withColumn("rank", rank).where(F.col("rank") <= top).drop(
        "one_before", "one_total", "start")


def collocations(
    docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, percent: int = PERCENT, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    totals, levels = frequent_phrases(docs, least, most_words)
    return ranked(scored(levels, percent), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f1 AS (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL HAVING f >= 10),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
    SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS cut, x.f AS l, y.f AS r
    FROM f2 c JOIN f1 x ON c.lang = x.lang AND c.w1 = x.w1 JOIN f1 y ON c.lang = y.lang AND c.w2 = y.w1
    LEFT JOIN inside i ON c.lang = i.lang AND c.w1 = i.w1 AND c.w2 = i.w2
    WHERE coalesce(100 * i.longer < 50 * c.f, true)
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
    FROM f3 c JOIN f1 x ON c.lang = x.lang AND c.w1 = x.w1 JOIN f2 y ON c.lang = y.lang AND c.w2 = y.w1 AND c.w3 = y.w2
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
    FROM f3 c JOIN f2 x ON c.lang = x.lang AND c.w1 = x.w1 AND c.w2 = x.w2 JOIN f1 y ON c.lang = y.lang AND c.w3 = y.w1),
s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""
