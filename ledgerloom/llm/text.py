"""Words, lines and intermediate columns as built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null or blank one."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def rows(df: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that columns computed beside it clash with none of its own."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` beside those of ``df``, each computed once for a row.

    They come out of a generator, below which no later expression is inlined; a column used inside
    a lambda would otherwise be computed again for each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def pairs_apart(hashes: Column, step: int, n: Column) -> Column:
    """The hash of each of the first ``n`` entries with the one ``step`` after it."""
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def plain_words(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text."""
    bare = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))
