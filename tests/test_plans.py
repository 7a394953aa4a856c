"""Physical plans: nothing row-at-a-time, no nested loops, and pruned, filtered scans."""

import datetime

import pytest

import __spark_entry__ as entry_points
from ledgerloom.plans import PLANS
from ledgerloom.operators import aggregates, filters, joins, mutations
from ledgerloom.schemas import TABLES, conform
from ledgerloom.sinks import tables
from ledgerloom.sources import payloads
from ledgerloom.sources.tables import Shop, load

ROOT = "/root/testdata/sf0.001"
BATCH = sorted(k for k in PLANS if not k.startswith("st_"))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_plan_has_no_python_and_no_nested_loop(spark, key):
    text = physical(entry_points.queries()[key](spark, ROOT))
    for operator in ("Python", "NestedLoop", "Cartesian", "ExistingRDD"):
        assert operator not in text


def test_order_payload_is_parsed_once_below_a_filter(spark):
    orders = filters.paid_orders(payloads.order_rows(Shop(spark, ROOT).raw_orders))
    assert physical(orders).count("from_json") == 1


@pytest.fixture()
def stored(spark, folder):
    shop = Shop(spark, ROOT)
    for name in ("transactions", "products", "agent_messages", "opportunities"):
        getattr(shop, name).write.parquet(f"{folder}/{name}")
    return folder


def test_filters_and_columns_reach_the_scan(spark, stored):
    tx = load(spark, stored, "transactions")
    recent = physical(filters.recent_transactions(tx, "2001-08-01 00:00:00").select("id", "net"))
    assert "GreaterThan(occurred" in recent
    assert "ReadSchema: struct<id:bigint,net:decimal(18,4),occurred_at:timestamp" in recent

    sold = physical(aggregates.sales_total(tx))
    assert "EqualTo(type,sale)" in sold
    assert "ReadSchema: struct<net:decimal(18,4),type:string>" in sold

    unread = physical(filters.mailbox_unread(load(spark, stored, "agent_messages"), "content"))
    assert "Or(EqualTo(to_agent,content),IsNull(to_agent))" in unread


def test_a_small_batch_does_not_shuffle_the_ledger(spark, stored):
    ledger = load(spark, stored, "transactions")
    orders = payloads.order_rows(spark.range(1).selectExpr(
        """'{"id":"a","status":"paid","amount":5,"created_at":"2024-01-01 00:00:00"}' AS payload"""))
    text = physical(mutations.ledger_sync_batch(orders, ledger, f"{stored}/staged"))
    assert "Exchange hashpartitioning" not in text and "ReadSchema: struct<transaction_id:string>" in text


def test_top_lists_do_not_sort_everything(spark, stored):
    queue = joins.draft_queue(load(spark, stored, "products"), load(spark, stored, "opportunities"))
    assert "TakeOrderedAndProject" in physical(queue)


def test_hot_keys_are_aggregated_before_the_shuffle(spark, stored):
    products, tx = load(spark, stored, "products"), load(spark, stored, "transactions")
    text = physical(aggregates.product_rollup(products, tx))
    assert "partial_sum" in text


def test_tables_load_with_their_declared_schema(spark, stored):
    for name in ("transactions", "products", "agent_messages", "opportunities"):
        assert conform(load(spark, stored, name), TABLES[name]).schema == TABLES[name]


def test_a_recent_window_reads_recent_days_only(spark, folder):
    tables.append(Shop(spark, ROOT).transactions, folder, "transactions", "2001-08-01 00:00:00")
    recent = filters.recent_transactions(load(spark, folder, "transactions"), "2001-08-01 00:00:00")
    scan = next(line for line in recent._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("\n") if "PartitionFilters" in line)
    assert "day" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(r.day >= datetime.date(2001, 7, 25) for r in recent.select("day").distinct().collect())
