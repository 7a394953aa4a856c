"""Hot keys: joins that keep a hot side whole are split by adaptive execution, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, joins, quality
from ledgerloom.schemas import TABLES, conform

N = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture()
def small_partitions(spark):
    """Thresholds at which this much data counts as skewed."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k in SETTINGS:
        spark.conf.unset(k)


def stored(spark, df, path, table):
    """``df`` as a stored table of several files."""
    conform(df, TABLES[table]).repartition(8).write.parquet(path)
    return spark.read.schema(TABLES[table]).parquet(path)


def hot(key):
    """A key that a third of the rows share."""
    return F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % key)


def split_and_rows(df):
    rows = df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString(), rows


def test_orders_against_the_ledger(spark, folder, small_partitions):
    orders = spark.range(N).withColumn("n", F.col("id")).withColumn("id", hot(20_000).cast("string"))
    orders.withColumn("pad", F.sha2(F.col("n").cast("string"), 256)).repartition(8).write.parquet(f"{folder}/orders")
    orders = spark.read.parquet(f"{folder}/orders")
    ledger = stored(
        spark, spark.range(1000, 11_000).withColumn("transaction_id", F.col("id").cast("string")),
        f"{folder}/ledger", "transactions",
    )
    split, rows = split_and_rows(joins.not_in_ledger(orders, ledger))
    assert split
    keys = [7 if i % 3 == 0 else i % 20_000 for i in range(N)]
    assert sorted(r.n for r in rows) == [i for i, k in enumerate(keys) if not 1000 <= k < 11_000]


def test_products_of_no_or_one_opportunity(spark, folder, small_partitions):
    base = spark.range(N).withColumn("title", F.sha2(F.col("id").cast("string"), 256))
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 500)
    products = stored(spark, base.withColumn("opportunity_id", key), f"{folder}/p", "products")
    opps = stored(spark, spark.range(500).withColumn("type", F.lit("t")), f"{folder}/o", "opportunities")
    split, rows = split_and_rows(joins.product_opportunity(products, opps))
    assert split
    assert len(rows) == N and sum(r.opp_type is None for r in rows) == N // 3


def test_messages_about_one_opportunity(spark, folder, small_partitions):
    body = F.concat(F.lit('{"task":"create_product","opportunityId":'), hot(500).cast("string"), F.lit("}"))
    box = stored(spark, spark.range(3 * N).withColumns({"type": F.lit("task"), "payload": body}), f"{folder}/m", "agent_messages")
    opps = stored(spark, spark.range(500).withColumn("status", F.lit("pending")), f"{folder}/o", "opportunities")
    split, rows = split_and_rows(joins.requested_opportunities(box, opps))
    assert split
    want = sum(1 for i in range(3 * N) if i % 3 == 0 or i % 500 != 0)
    assert len({r.message_id for r in rows}) == len(rows) == want


def test_ledger_rows_of_one_missing_product(spark, folder, small_partitions):
    tx = stored(
        spark, spark.range(N).withColumns({"product_id": hot(900), "description": F.sha2(F.col("id").cast("string"), 256)}),
        f"{folder}/t", "transactions",
    )
    products = stored(spark, spark.range(100, 900), f"{folder}/p", "products")
    split, rows = split_and_rows(quality.orphans(tx, "product_id", products))
    assert split
    assert len(rows) == sum(1 for i in range(N) if i % 3 == 0 or i % 900 < 100)


def test_sales_of_one_product(spark, folder, small_partitions):
    tx = stored(
        spark, spark.range(N).withColumns({"product_id": hot(900), "type": F.lit("sale"), "net": F.lit(1)}),
        f"{folder}/t", "transactions",
    )
    products = stored(spark, spark.range(900), f"{folder}/p", "products")
    top = aggregates.product_rollup(products, tx).orderBy(F.desc("sales")).first()
    assert (top.id, top.sales) == (7, sum(1 for i in range(N) if i % 3 == 0 or i % 900 == 7))
