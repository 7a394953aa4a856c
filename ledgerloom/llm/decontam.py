"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words that looks at five of them and ignores the rest. Test and training words
under each mask are hashed and joined on the hash. Around a hit, words are compared one by one along its diagonal: an
overlap is a window of 12 words (or a whole shorter item) with at least 75 % equal words in the same places. The four
masks together hit every window of 10 to 12 words with as many substitutions as are allowed. Items of six to nine words
have two masks of four words more; with them, every allowed substitution of such an item is hit, too. An item of up to five
words overlaps where all its words stand in order: its mask looks at all of them.

Words are lower-case runs of letters and digits; case, punctuation and spacing don't matter. Seeds and words are compared
as 64-bit hashes. A hit makes one number, the bits of the equal words around it, and is dropped or counted in the task that found
it; ``stage`` asks only whether a document has one, so a phrase that many items and documents share costs comparisons, not
rows. The benchmark is broadcast in blocks of bounded size, also where many items share a seed.

Defined results: null and blank texts have no words and match nothing. Equal items are one, under the smallest id (null only if all are). Repeated documents are judged each for
itself; a null doc_id groups with other null ones. An empty benchmark or table gives an empty result. Columns of the
inputs never clash with computed ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import text as tx
from ledgerloom.workspace import staged

# The offsets that each mask looks at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7), (0, 1, 3, 4, 5))
SHORT_MASKS = ((0, 1, 2, 5), (0, 2, 3, 4))  # more masks, for items of ``SHORT`` words
SHORT = (6, 9)  # least and most words
WHOLE_MASKS = tuple(tuple(range(n)) for n in range(1, SHORT[0]))  # each for the items of its length
ALL_MASKS = (*MASKS, *SHORT_MASKS, *WHOLE_MASKS)
OFFSETS = sorted({o for mask in ALL_MASKS for o in mask})
WINDOW = 12
AROUND = range(-WINDOW, WINDOW)  # the words that are compared around a hit, from its first word
MIN_EQUAL_PERCENT = 75
BLOCK = 500_000  # seeds that are broadcast at once; a larger benchmark is joined in several blocks


def hashes(text: Column) -> Column:
    """The words of a text as 64-bit hashes."""
    return F.transform(tx.plain_words(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, keep: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row for each position of ``words`` and each of ``masks`` that fits there: ``at`` (from 0) and ``seed``."""
    n = F.size("words")
    shifted = F.arrays_zip(*[
        F.slice("words", 1 + o, F.greatest(n - o, F.lit(0))).alias(f"w{o}") for o in OFFSETS])
    placed = df.select(*keep, F.posexplode(shifted).alias("at", "w"))
    hashed = [
        F.when(F.col(f"w.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(ALL_MASKS.index(mask)), *[F.col(f"w.w{o}") for o in mask]))
        for mask in masks]
    return placed.select(*keep, "at", F.explode(F.array(*hashed)).alias("seed")).where(F.col("seed").isNotNull())


def items(benchmark: DataFrame) -> DataFrame:
    """Distinct items as words, with the smallest id and the number of equal items."""
    b = benchmark.select("item_id", hashes(F.col("text")).alias("words"))
    return b.groupBy("words").agg(F.min("item_id").alias("item"), F.count("*").alias("n_items"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For rows of (``row``, ``words``): the rows and the items (``item``, ``n_items``) that overlap around some hit,
    ``first`` and ``last`` word of the row's text in such a window, and ``n_equal``, the most equal words in one."""
    tests = items(benchmark)
    keep = ["item", "n_items", "words"]
    size = F.size("words")
    of_tests = [seeds(tests.where(size >= SHORT[0]), keep, MASKS), seeds(tests.where(size.between(*SHORT)), keep, SHORT_MASKS)]
    of_tests += [seeds(tests.where(size == len(mask)), keep, (mask,)) for mask in WHOLE_MASKS]
    of_tests = reduce(DataFrame.unionAll, of_tests)
    of_tests = of_tests.select(
        "item", "n_items", "seed", F.least(F.size("words"), F.lit(WINDOW)).alias("n_window"),
        *[F.get("words", F.col("at") + o).alias(f"test{o}") for o in AROUND])
    of_tests = staged(of_tests.dropDuplicates(), "seeds")
    n_blocks = max(1, -(-of_tests.count() // BLOCK))
    # masks that no item of this benchmark has are not tried on the documents
    lengths = {r["n_window"] for r in of_tests.select("n_window").distinct().collect()}  # at most twelve
    masks = [*MASKS, *(SHORT_MASKS if any(SHORT[0] <= n <= SHORT[1] for n in lengths) else ()),
             *[mask for mask in WHOLE_MASKS if len(mask) in lengths]]
    if n_blocks > 1:  # words are taken from the texts once, not for each block
        docs = staged(docs, "words")
    of_docs = seeds(docs, ["row", "words"], tuple(masks))
    found = []
    for block in range(n_blocks):  # a seed of many items goes into all blocks
        part = of_tests if n_blocks == 1 else of_tests.where(F.pmod(F.xxhash64("seed", "item"), F.lit(n_blocks)) == block)
        found.append(of_docs.join(F.broadcast(part), "seed"))
    hits = reduce(DataFrame.unionAll, found)
    # which of the words around are equal, one bit for each
    equal = reduce(Column.bitwiseOR, [
        F.when(F.get("words", F.col("at") + o) == F.col(f"test{o}"), 1 << (o + WINDOW)).otherwise(0) for o in AROUND])
    hits = tx.computed(hits.select("row", "item", "n_items", "n_window", "at", equal.alias("equal")), bits=F.col("equal"))
    # the windows that hold the first word of the hit: of those with the most equal words, the last
    best = F.greatest(*[
        F.bit_count(F.shiftright("bits", i).bitwiseAND((1 << WINDOW) - 1)) * 16 + i for i in range(1, WINDOW + 1)])
    hits = tx.computed(hits, best=best)
    n_equal, start = F.shiftright("best", 4), F.col("at") + F.col("best").bitwiseAND(15) - WINDOW
    return hits.where(100 * n_equal >= MIN_EQUAL_PERCENT * F.col("n_window")).select(
        "row", "item", "n_items", F.greatest(start, F.lit(0)).alias("first"),
        (start + WINDOW - 1).alias("last"), n_equal.alias("n_equal"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of document and item that overlap: (doc_id, item_id, n_items, n_equal, first_word, last_word)."""
    d = tx.computed(docs.select(F.struct("doc_id").alias("row"), F.col("text").alias("text")),
                    words=hashes(F.col("text")))
    found = overlaps(d.drop("text"), benchmark)
    return found.groupBy(F.col("row.doc_id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n_items").alias("n_items"), F.max("n_equal").cast("long").alias("n_equal"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row")
    d = tx.computed(docs.select(key, F.col("text").alias("text")), words=hashes(F.col("text")))
    bad = overlaps(d.drop("text"), benchmark).groupBy("row").agg(F.count("*").alias("n_hits"))
    kept = tx.rows(docs).join(
        bad.select(F.col("row").alias("bad")),
        F.col("row.doc_id").eqNullSafe(F.col("bad.doc_id"))
        & (F.xxhash64("row.text") == F.col("bad.text_hash")), "left_anti")
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).drop("first_word", "last_word")


# all alignments of a document and an item that share a word, whatever the masks
_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
tests AS (SELECT min(item_id) AS item_id, count(*) AS n_items, words
          FROM (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL) GROUP BY words),
in_docs AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
in_tests AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM tests),
lines AS (
    SELECT doc_id, item_id, d.pos - t.pos AS shift, list(t.pos) AS places
    FROM in_docs d JOIN in_tests t ON d.word = t.word AND t.word <> '' GROUP BY ALL),
likely AS (SELECT l.*, t.n_items, len(t.words) AS n FROM lines l JOIN tests t USING (item_id)
           WHERE 100 * len(places) >= 75 * least(12, len(t.words))),
windows AS (SELECT doc_id, item_id, n_items, n, list_max(list_transform(places, lambda p: len(list_filter(
                places, lambda q: q BETWEEN p AND p + 11)))) AS n_equal FROM likely)
SELECT doc_id, item_id, n_items, CAST(max(n_equal) AS BIGINT) AS n_equal
FROM windows WHERE CASE WHEN n < 6 THEN n_equal = n ELSE 100 * n_equal >= 75 * least(12, n) END GROUP BY ALL"""
