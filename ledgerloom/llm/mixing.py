"""Mixing sources to target weights.

Each document gets a random key from a hash. Within its source it is placed by the sum of the sizes before it in the
order of the keys, and a source is cut at its exact budget: whole epochs first, then the documents before the cut, then
the part of one document that fills the rest.

The order of a source is range-sorted: its keys are uniform, so equal ranges of the key hold about ``PER_RANGE``
documents each, however large the source is; sums run inside a range, and the sums of ranges are added up before them.

Defined results: documents without a source are a source of their own, the last one. A null text has size 0 and is never
taken. Rows that are equal in id and text share a key; which of them holds the cut is open, their taken words together
are not. An empty table gives an empty result; columns of the input never clash with computed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm import text as tx
from ledgerloom.llm.sums import running
from ledgerloom.workspace import staged

SEED = "mix-1"
CYCLE = (5, 2, 1)  # weights of the sources in their order, repeated
MAX_EPOCHS = 3
PER_RANGE = 2_000
BROADCAST_SOURCES = 100_000  # a longer list of sources is joined by shuffling it


def hash_key(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits, uniform and the same at each run."""
    parts = [F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))]
    return F.md5(F.concat_ws(":", *parts))


def sized(docs: DataFrame) -> DataFrame:
    """Id, source, size and key of each document, written: the text is not needed to plan the mix."""
    d = docs.select("doc_id", "source", tx.n_words(F.col("text")).alias("size"),
                    hash_key(F.col("doc_id"), F.col("text")).alias("key"))
    return staged(d, "mix-sizes")


def targets(sources: DataFrame) -> DataFrame:
    """``target`` for rows of ``source`` and ``source_size``: the share of the total by weight, at most three times the
    size, with the excess shared out again by weight until no source is above.

    All sources take the same amount by weight, ``share``, but for those whose limit is lower. Sources in the order of
    limit by weight, ``level``, leave so much by weight if all before them are at their limit; those it would lift
    above their level are at their limit too, and the first that it would not gives the share. After it the
    amount only falls, so the share is the largest.
    """
    by_name = F.col("source").asc_nulls_last()
    s = running(sources, [by_name], place=F.lit(1), everything=F.col("source_size"))
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("place_before") % len(CYCLE) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("long")).withColumn("limit", MAX_EPOCHS * F.col("source_size"))
    s = s.withColumn("level", F.col("limit") / F.col("weight"))
    s = running(s, [F.col("level"), by_name], limits=F.col("limit"), weights=F.col("weight"))
    s = s.withColumn("left", (F.col("everything_total") - F.col("limits_before"))
                     / (F.col("weights_total") - F.col("weights_before")))
    share = s.where(F.col("left") < F.col("level")).agg(F.max("left")).first()[0]  # one number
    share = F.lit(share).cast("double")
    full = share.isNull() | (F.col("level") <= share)
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * share)
    return s.select("source", "source_size", target.alias("target"))


def cut(d: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of (source, size, key, ...) with ``source_size``, ``target`` and ``taken``, the words of the row in the mix.

    ``sizes`` has the size and key of the same rows.
    """
    per_source = staged(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.ceil(F.count("*") / PER_RANGE).alias("ranges")), "mix-sources")
    goals = targets(per_source.drop("ranges")).select(F.col("source").alias("of"), "source_size", "target")
    goals = goals.join(per_source.select(F.col("source").alias("of2"), "ranges"),
                       F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    goals = staged(goals, "mix-targets")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    uniform = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))

    def with_goals(x: DataFrame) -> DataFrame:
        return x.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn(
            "range", F.floor(uniform * F.col("ranges")))

    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = with_goals(sizes).groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    sums = sums.select(F.col("source").alias("of"), F.col("range").alias("range_of"),
                       F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range"))
    placed = with_goals(d).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("range_of")))
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_range") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.withColumn("taken", taken.cast("long")).drop("of", "range", "range_of", "before_range", "ranges")


def copies(taken: Column, size: Column) -> Column:
    """The words of each copy of a document in the mix: whole ones, and the part that the cut leaves."""
    n = F.ceil(taken / size).cast("int")
    return F.when((size > 0) & (taken > 0), F.transform(
        F.sequence(F.lit(1), n), lambda i: F.least(size, taken - (i - 1) * size))).otherwise(
            F.array().cast("array<bigint>"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row for each copy, a cut copy as its first words joined by spaces."""
    d = tx.rows(docs).select(
        "row", F.col("row.source").alias("source"), tx.n_words(F.col("row.text")).alias("size"),
        hash_key(F.col("row.doc_id"), F.col("row.text")).alias("key"))
    mix = cut(d, sized(docs)).select("row", "size", F.explode(copies(F.col("taken"), F.col("size"))).alias("part"))
    first_words = F.array_join(F.slice(tx.words(F.col("row.text")), 1, F.col("part").cast("int")), " ")
    text = F.when(F.col("part") == F.col("size"), F.col("row.text")).otherwise(first_words)
    mix = mix.withColumn("new_text", text)
    new = {"text": F.col("new_text").alias("text"), "n_chars": F.length("new_text").cast("long").alias("n_chars")}
    return mix.select(*[new[c] if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    sizes = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))) AS key
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
    FROM d GROUP BY source),
levels AS (
    SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS level, sum(source_size) OVER () AS total FROM sources),
amounts AS (
    SELECT *, CAST(total - coalesce(sum(cap) OVER before, 0) AS BIGINT)
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS remaining
    FROM levels
    WINDOW before AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
    SELECT source, source_size, CASE WHEN share IS NULL OR level <= share THEN CAST(cap AS DOUBLE)
                                     ELSE weight * share END AS target
    FROM amounts, (SELECT max(remaining) AS share FROM amounts WHERE remaining < level)),
placed AS (
    SELECT d.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
           CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, source,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM epochs"""
