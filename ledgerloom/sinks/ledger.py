"""The ledger stored in buckets of ``transaction_id``, for syncs that look up their orders in it.

Rows of a bucket lie in files of its number, so a join or a grouping by ``transaction_id`` reads the ledger as it lies and
shuffles the orders only, into as many partitions. Within a file rows are in order of time, so a recent window skips row groups
by their statistics. Buckets are a property of a catalog table; the files lie under a given path and can be
registered again in a catalog that does not know them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.schemas import TABLES, with_defaults

KEY = "transaction_id"
BUCKETS = 64  # about (bytes of the ledger) / (128 MB) of a large one


def register(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The ledger whose files lie under ``path``, or will, as table ``name`` of the catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES["transactions"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) "
              f"SORTED BY (occurred_at) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def append(df: DataFrame, name: str, as_of: str, buckets: int = BUCKETS) -> DataFrame:
    """Append ``df`` to the ledger ``name``, filling defaults: one file for each bucket that gets rows."""
    rows = with_defaults(df, "transactions", as_of).repartition(buckets, KEY)
    rows.write.mode("append").format("parquet").bucketBy(buckets, KEY).sortBy("occurred_at").saveAsTable(name)
    spark = df.sparkSession
    spark.catalog.refreshTable(name)
    return spark.table(name)
