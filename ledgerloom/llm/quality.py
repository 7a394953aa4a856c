"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much with them.

A line fails if it is navigation (separators between short labels), noise (many symbols), shouting
(capital letters), unfinished (no closing punctuation) or boilerplate (fixed phrases).

Defined results: a null or blank text has no words, no lines and no repeats, and fails the base rules. Rows are
judged one by one, so repeated rows and null ids change nothing; an empty table gives an empty result; columns of the
input never clash with computed ones. A text of any length is judged whole, in n log n steps.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import text as tx

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»·•"
CLOSING = (".", "!", "?", ":", ";", '"', "'", ")", "]", "}", "”", "’", "»", "…", "。", "！", "？")
PHRASES = (
    "cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "click here",
    "sign in", "log in", "sign up", "subscribe", "lorem ipsum",
)
BOILERPLATE = "(?i)" + "|".join(PHRASES)
# holds of every line with enough capitals: of its letters, two that follow each other are capitals, or its only one is
MAYBE_SHOUTING = r"\p{Lu}\P{L}*+(\p{Lu}|\z)"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(F.lit(p)) for p in parts])


def line_fails(bare: Column, with_separators: Column, with_symbols: Column, with_phrases: Column) -> Column:
    """Whether a line that has a word, without the space around it, fails one of the line rules.

    The flags say of the whole text whether it may hold what a rule looks for; a line is searched only where it may.
    """
    n_words = F.size(F.split(bare, tx.SPACES))
    characters = F.length(F.translate(bare, tx.SPACE, ""))
    separators = tx.count_of(bare, SEPARATORS)
    capitals = F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Lu}+", ""))
    letters = F.length(bare) - F.length(F.regexp_replace(bare, r"\p{L}+", ""))
    return (
        ~F.right(bare, F.lit(1)).isin(*CLOSING)
        | (with_separators & (separators > 0) & (3 * separators >= n_words))
        | (with_symbols & (10 * tx.count_of(bare, SYMBOLS) >= characters))
        | (bare.rlike(MAYBE_SHOUTING) & (n_words >= 3) & (letters > 0) & (10 * capitals >= 7 * letters))
        | (with_phrases & bare.rlike(BOILERPLATE))
    )


def repeated_words(hashes: Column, n: Column) -> Column:
    """How many of ``n`` words lie in windows of eight that occur twice or more; words come as 64-bit hashes.

    Windows are compared by 64-bit hashes within one text.
    """

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return tx.let(placed, lambda p: tx.let(
            F.sort_array(F.transform(
                F.filter(p, lambda e, j: (F.get(p, j - 1)["h"] == e["h"]) | (F.get(p, j + 1)["h"] == e["h"])),
                lambda e: e["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)))),
                F.lit(0), lambda total, x: total + x)))

    def repeats(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    of_two = tx.pairs_apart(hashes, 1, n - 1)
    of_four = tx.let(of_two, lambda h: tx.pairs_apart(h, 2, n - 3))
    of_eight = tx.let(of_four, lambda h: tx.pairs_apart(h, 4, n - 7))
    return F.when(n < WINDOW, 0).otherwise(tx.let(of_eight, repeats)).cast("long")


def judged(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``row``, with the base figures, both verdicts and ``cleaned``, the text without failed
    lines (null for a null text)."""
    d = tx.computed(tx.rows(docs), text=F.coalesce(F.col("row.text"), F.lit("")))
    d = tx.computed(
        d,
        words=tx.words(F.col("text")),
        lines=F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(tx.SPACE)) != ""),
        lowered=F.lower("text"),
        with_separators=holds_any(F.col("text"), SEPARATORS),
        with_symbols=holds_any(F.col("text"), SYMBOLS),
    )
    d = tx.computed(
        d,
        bare=F.transform("lines", lambda line: F.btrim(line, F.lit(tx.SPACE))),
        with_phrases=holds_any(F.col("lowered"), PHRASES),
    )
    flags = [F.col(c) for c in ("with_separators", "with_symbols", "with_phrases")]
    d = tx.computed(
        d,
        n_words=F.size("words"),
        hashes=F.transform("words", lambda w: F.xxhash64(w)),
        failed=F.transform("bare", lambda line: line_fails(line, *flags)),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.when(F.col("with_symbols"), tx.count_of(F.col("text"), SYMBOLS)).otherwise(0).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    )
    lost = F.aggregate(
        F.zip_with("lines", "failed", lambda line, bad: F.when(bad, F.size(tx.words(line))).otherwise(0)),
        F.lit(0), lambda total, x: total + x)
    kept_lines = F.transform(
        F.filter(F.arrays_zip("lines", "failed"), lambda x: ~x["failed"]), lambda x: x["lines"])
    cleaned = F.when(F.exists("failed", lambda bad: bad), F.array_join(kept_lines, "\n")).otherwise(F.col("row.text"))
    d = tx.computed(d, n_repeat_words=repeated_words(F.col("hashes"), F.col("n_words")), n_lost=lost, cleaned=cleaned)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (100 * F.col("n_lost") <= MAX_LOST_PERCENT * F.col("n_words"))
    return d.select(
        "row", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", F.col("n_lost").cast("long").alias("n_lost"), "base_failed", kept.alias("kept"), "cleaned")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, without their failed lines."""
    text, n = F.col("cleaned").alias("text"), F.length("cleaned").cast("long").alias("n_chars")
    return judged(docs).where("kept").select(
        *[{"text": text, "n_chars": n}.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lost")


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS of_eight
    FROM d, unnest(range(1, len(words) - 6)) t(i)),
repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, of_eight) > 1),
covered AS (
    SELECT doc_id, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM repeated) GROUP BY doc_id),
lines AS (
    SELECT doc_id, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
    FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
lost AS (
    SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n FROM lines
    WHERE NOT regexp_matches(line, '[.!?:;"'')\]}”’»…。！？]$')
       OR (regexp_matches(line, '[|›»·•]') AND 3 * len(regexp_extract_all(line, '[|›»·•]'))
                                               >= len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))
       OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))
       OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 AND regexp_matches(line, '\p{L}')
           AND 10 * len(regexp_extract_all(line, '\p{Lu}')) >= 7 * len(regexp_extract_all(line, '\p{L}')))
       OR regexp_matches(line, '(?i)cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|click here|(sign|log) in|sign up|subscribe|lorem ipsum')
    GROUP BY doc_id),
figures AS (
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost <= 50 * n_words AS kept
FROM figures"""
