"""Constraint checks as jobs: each reports violations, none drops rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def count_checks(df: DataFrame, source: str, checks: Mapping[str, Column]) -> DataFrame:
    """Rows failing each check, in one pass: (source, check, violations)."""
    names = list(checks)
    counts = df.agg(*[F.count(F.when(checks[n], 1)).alias(f"c{i}") for i, n in enumerate(names)])
    results = F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(names)
    ])
    return counts.select(F.lit(source).alias("source"), F.explode(results).alias("r")).select("source", "r.*")


def not_null(df: DataFrame, source: str, columns: Iterable[str]) -> DataFrame:
    return count_checks(df, source, {c: F.col(c).isNull() for c in columns})


def orphans(child: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose parent does not exist; a NULL reference is allowed."""
    ids = parents.select(F.col(key).alias(column))
    return child.where(F.col(column).isNotNull()).join(ids, column, "left_anti")


def foreign_key(child: DataFrame, column: str, parents: DataFrame, source: str, key: str = "id") -> DataFrame:
    """References checked and references broken; counted per key before the join."""
    refs = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ids = parents.select(F.col(key).alias(column)).distinct().withColumn("found", F.lit(True))
    broken = F.when(F.col("found").isNull(), F.col("n"))
    return refs.join(ids, column, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(broken), F.lit(0)).alias("broken")
    ).select(F.lit(source).alias("source"), F.lit(column).alias("column"), "checked", "broken")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def outside(df: DataFrame, source: str, column: str, allowed: Iterable[str]) -> DataFrame:
    """Values not in the allowed set and how many rows have them; NULL is not judged."""
    bad = df.where(~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(
        F.lit(source).alias("source"), F.lit(column).alias("column"), "value", "n"
    )


def missing_fields(payloads: DataFrame, source: str, schema: str, paths: Iterable[str]) -> DataFrame:
    """Records whose required field is absent or not of its declared type; each record is parsed once."""
    records = payloads.select(F.inline(F.array(F.from_json("payload", schema))))
    return count_checks(records, source, {p: F.col(p).isNull() for p in paths})


def outside_range(df: DataFrame, source: str, column: str, low: float, high: float) -> DataFrame:
    return count_checks(df, source, {column: ~F.col(column).between(low, high)})
