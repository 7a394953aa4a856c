"""Scans with fixed schemas: the domain tables, and the driver tables they are derived from."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.schemas import BY_DAY, DAY, INT, LONG, STRING, TABLES, conform, table
from ledgerloom.sources.views import VIEWS


DOUBLE, LOCAL_TIME = T.DoubleType(), T.TimestampNTZType()

DRIVER_TABLES: dict[str, T.StructType] = {
    "customer": table(c_custkey=LONG, c_name=STRING, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=STRING),
    "supplier": table(s_suppkey=LONG, s_name=STRING, s_nationkey=INT, s_acctbal=DOUBLE),
    "part": table(
        p_partkey=LONG, p_name=STRING, p_brand=STRING, p_type=STRING, p_size=INT, p_retailprice=DOUBLE,
    ),
    "orders": table(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=STRING, o_totalprice=DOUBLE, o_orderdate=LOCAL_TIME,
        o_orderpriority=STRING,
    ),
    "lineitem": table(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DOUBLE,
        l_extendedprice=DOUBLE, l_discount=DOUBLE, l_tax=DOUBLE, l_returnflag=STRING, l_linestatus=STRING,
        l_shipdate=LOCAL_TIME,
    ),
    "events": table(
        event_id=LONG, ts=LOCAL_TIME, user_id=LONG, event_type=STRING, value=DOUBLE, props=STRING,
    ),
    "documents": table(doc_id=LONG, text=STRING, lang=STRING, source=STRING, n_chars=LONG),
    "pages": table(page_id=LONG, url=STRING, html=STRING),
}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan domain table ``name`` stored as Parquet under ``root``, with its declared schema.

    A table kept by day has its day as a further column, for filters to find the folders by.
    """
    schema = TABLES[name]
    if name in BY_DAY:
        schema = T.StructType([*schema, T.StructField(DAY, T.DateType())])
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def lookup(spark: SparkSession, root: str, name: str, column: str, keys: list) -> DataFrame:
    """The rows of a stored table that have one of a few ``keys``. Equalities reach the scan, which skips row groups by
    their bloom filters and statistics."""
    same = [F.col(column) == F.lit(k) for k in keys if k is not None]
    return load(spark, root, name).where(reduce(or_, same) if same else F.lit(False))


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a driver table."""
    return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{root}/{name}.parquet")


def scan_stream(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream a driver table, stored as one Parquet file or as a folder of them, in any file system.

    The path ends in a pattern that only it fits: Spark takes a pattern for what it finds there, a file or a folder,
    and a plain path for a folder. ``files_per_batch`` cuts a backlog into batches; results don't depend on it.
    """
    reader = spark.readStream.schema(DRIVER_TABLES[name])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/{name}.parque[t]")


def derive(df: DataFrame, view: str) -> DataFrame:
    """Apply the projection of a domain view to its driver table, batch or stream."""
    rows = df.selectExpr(*VIEWS[view].columns)
    return conform(rows, TABLES[view]) if view in TABLES else rows


class Shop:
    """The domain views over one folder of driver tables, as attributes: ``shop.transactions``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return derive(scan(self.spark, self.root, VIEWS[name].table), name)
        if name in DRIVER_TABLES:
            return scan(self.spark, self.root, name)
        raise AttributeError(name)

    def stream(self, view: str, files_per_batch: int | None = None) -> DataFrame:
        return derive(scan_stream(self.spark, self.root, VIEWS[view].table, files_per_batch), view)
