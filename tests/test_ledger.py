"""The ledger in buckets: its side of a sync is not shuffled, and results are those of a plain table."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins, mutations
from ledgerloom.sinks import ledger
from ledgerloom.sources.payloads import order_rows
from ledgerloom.sources.tables import Shop

ROOT = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture()
def stored(spark, folder):
    """A function that stores orders as a ledger; large tables, as far as Spark knows."""
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    names = []

    def store(orders, buckets=8):
        names.append(f"ledger_{uuid.uuid4().hex}")
        ledger.register(spark, names[-1], f"{folder}/{names[-1]}", buckets)
        return names[-1], ledger.append(mutations.sale_rows(orders), names[-1], AS_OF, buckets)

    yield store
    for n in names:
        spark.sql(f"DROP TABLE {n}")
    for k in NO_BROADCAST:
        spark.conf.unset(k)


def shuffled_tables(df):
    """For each exchange by a key, whether the ledger's files lie below it."""
    def nodes(p):
        yield p
        name = p.nodeName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else []
        children = p.children()
        for c in [*inner, *[children.apply(i) for i in range(children.size())]]:
            yield from nodes(c)

    plan = df._jdf.queryExecution().executedPlan()
    return [any("ledger_" in n.toString().split("\n")[0] and "Scan" in n.nodeName() for n in nodes(e))
            for e in nodes(plan) if e.nodeName() == "Exchange" and "hashpartitioning" in e.outputPartitioning().toString()]


@pytest.mark.parametrize("change", ["sync", "summary", "anti"])
def test_the_ledger_is_not_shuffled(spark, stored, change):
    shop = Shop(spark, ROOT)
    orders = order_rows(shop.raw_orders)
    _, table = stored(shop.known_orders.where("id IS NOT NULL").dropDuplicates(["id"]).limit(2000))
    if change == "sync":
        df = mutations.ledger_sync(orders, table)
    elif change == "summary":
        df = mutations.sync_summary(orders, table)
    else:
        df = joins.distinct_keys(orders, "id", "id").join(
            table.select(F.col("transaction_id").alias("id")), "id", "left_semi")
    df.collect()
    found = shuffled_tables(df)
    assert found and not any(found)


def test_results_are_those_of_a_plain_ledger(spark, stored):
    shop = Shop(spark, ROOT)
    orders = order_rows(shop.raw_orders)
    _, table = stored(shop.known_orders.where("id IS NOT NULL").dropDuplicates(["id"]).limit(2000))
    plain = spark.createDataFrame(table.collect(), table.schema)
    for change in (mutations.ledger_sync, mutations.sync_summary):
        assert sorted(map(str, change(orders, table).collect())) == sorted(map(str, change(orders, plain).collect()))
    got, want = joins.not_in_buckets(orders, table), joins.not_in_ledger(orders, plain)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_appending_twice_and_registering_again(spark, stored, folder):
    shop = Shop(spark, ROOT)
    orders = order_rows(shop.raw_orders)
    name, table = stored(shop.known_orders.where("id IS NOT NULL").dropDuplicates(["id"]).limit(500))
    added = mutations.ledger_sync(orders, table)
    table = ledger.append(added, name, AS_OF, 8)
    assert mutations.ledger_sync(orders, table).count() == 0
    n, again = table.count(), f"ledger_{uuid.uuid4().hex}"
    assert n == table.select("transaction_id").distinct().count()
    copy = ledger.register(spark, again, f"{folder}/{name}", 8)
    assert copy.count() == n and mutations.ledger_sync(orders, copy).count() == 0
    df = mutations.ledger_sync(orders, copy)
    df.collect()
    assert not any(shuffled_tables(df))
    spark.sql(f"DROP TABLE {again}")


def test_an_empty_ledger(spark, stored):
    orders = order_rows(Shop(spark, ROOT).raw_orders)
    _, table = stored(Shop(spark, ROOT).known_orders.where("false"))
    assert table.count() == 0
    assert mutations.ledger_sync(orders, table).count() > 0
