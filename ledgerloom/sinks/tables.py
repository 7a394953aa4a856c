"""Writing rows to stored tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession, functions as F, types as T

from ledgerloom.schemas import ALLOWED, BY_DAY, CLUSTERING, DAY, LOOKUPS, NOT_NULL, TABLES, conform, with_defaults
from ledgerloom.workspace import staged

PART = "part"


def _writer(rows: DataFrame, table: str, mode: str) -> DataFrameWriter:
    """With bloom filters on the columns that rows are looked up by, so that a lookup skips row groups without its keys."""
    out = rows.write.mode(mode)
    for c in LOOKUPS.get(table, ()):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return out


def _write(rows: DataFrame, root: str, table: str, mode: str) -> None:
    """Write rows that are in their final order; a table of ``BY_DAY`` into a folder per day."""
    if table in BY_DAY:
        rows = rows.withColumn(DAY, F.to_date(BY_DAY[table]))
        _writer(rows, table, mode).partitionBy(DAY).parquet(f"{root}/{table}")
    else:
        _writer(rows, table, mode).parquet(f"{root}/{table}")


def violations(table: str, allowed: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """What a row can break, by name: a column that must not be NULL, or a value outside the allowed ones."""
    allowed = ALLOWED.get(table, {}) if allowed is None else allowed
    return {f"{c} is null": F.col(c).isNull() for c in NOT_NULL.get(table, ())} | {
        f"{c} not allowed": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in allowed.items()}


def append(
    df: DataFrame, root: str, table: str, as_of: str, allowed: Mapping[str, Sequence[str]] | None = None, refuse: bool = False,
) -> dict[str, int]:
    """Append ``df`` to ``table`` under ``root``, filling column defaults; the number of violations of each kind.

    They are counted as the rows are written, without a second pass. With ``refuse``, the first violation ends the job, and nothing of
    the batch is stored. Rows of a table by day are dealt by time and id first, so that a batch adds few files to a day,
    and a day of any size is spread over several tasks.
    """
    rows = with_defaults(df, table, as_of)
    broken = violations(table, allowed)
    if table in BY_DAY:
        rows = rows.repartitionByRange(BY_DAY[table], "id").sortWithinPartitions(BY_DAY[table])
    if refuse:
        for name, is_broken in broken.items():
            first = rows.columns[0]
            fault = F.raise_error(F.lit(f"{table}: {name}")).cast(rows.schema[first].dataType)
            rows = rows.withColumn(first, F.when(is_broken, fault).otherwise(F.col(first)))
    if not broken:
        _write(rows, root, table, "append")
        return {}
    seen = Observation()
    rows = rows.observe(seen, *[F.count(F.when(is_broken, 1)).alias(name) for name, is_broken in broken.items()])
    _write(rows, root, table, "append")
    return dict(seen.get)


def rewrite(df: DataFrame, root: str, table: str) -> None:
    """Write all of ``df`` as ``table`` under a new ``root``, clustered by the columns it is filtered on.

    Each file then covers a narrow range of them, so scans skip files and row groups by their
    statistics. The order ends in the row's key, so a frequent value is spread over several files.
    """
    order = CLUSTERING[table]
    rows = conform(df, TABLES[table]).repartitionByRange(*order).sortWithinPartitions(*order)
    _write(rows, root, table, "error")


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table written to ``path``: computed once, and of known size."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# tables in parts, of which a change rewrites those that it touches


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, root: str, table: str, parts: int, key: str = "id") -> None:
    """``df`` as ``table`` in a folder for each of ``parts`` parts, by the hash of ``key``."""
    rows = conform(df, TABLES[table]).withColumn(PART, _part(key, parts)).repartition(parts, PART)
    _writer(rows, table, "error").partitionBy(PART).parquet(f"{root}/{table}")


def load_parts(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = T.StructType([*TABLES[table], T.StructField(PART, T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def change_parts(
    spark: SparkSession, root: str, table: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], parts: int,
    key: str = "id",
) -> int:
    """Replace the rows of the parts that hold ``keys`` by ``change`` of them; the number of parts rewritten.

    ``change`` gets whole rows of the table and returns rows of it. The other parts are neither read nor written. The new
    rows are staged before the old ones are replaced.
    """
    touched = [r[0] for r in keys.where(F.col(key).isNotNull()).select(_part(key, parts)).distinct().collect()]  # numbers below ``parts``
    if touched:
        old = load_parts(spark, root, table).where(F.col(PART).isin(touched))
        new = conform(change(old.drop(PART)), TABLES[table]).withColumn(PART, _part(key, parts))
        new = staged(new, "changed-parts").repartition(len(touched), PART)
        _writer(new, table, "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{root}/{table}")
    return len(touched)
