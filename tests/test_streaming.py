"""Streams against the batch result: split over files, restarted, and retried."""

import os

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, filters, mutations, windows
from ledgerloom.schemas import TABLES, conform
from ledgerloom.sources.payloads import order_rows
from ledgerloom.sources.tables import DRIVER_TABLES, Shop, derive
from ledgerloom.streaming import jobs

ROOT = "/root/testdata/sf0.001"


def as_set(df):
    return {tuple(r) for r in df.collect()}


def split_files(df, path, n=3):
    """``df`` as ``n`` files that arrive one after the other."""
    for i in range(n):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, table, view):
    raw = spark.readStream.schema(DRIVER_TABLES[table]).option("maxFilesPerTrigger", 1).parquet(path)
    return derive(raw, view)


def test_mailbox_delivers_once(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.events, f"{folder}/in")
    want = as_set(filters.mailbox_unread(shop.agent_messages, "sales").select("id"))

    def read():
        return jobs.mailbox(stream(spark, f"{folder}/in", "events", "agent_messages"), "sales", f"{folder}/sales")

    got = read()
    assert as_set(got.select("id")) == want and got.count() == len(want)
    assert read().count() == len(want)


def test_each_recipient_gets_the_broadcasts(spark, folder):
    for agent in ("sales", "content"):
        got = jobs.mailbox(Shop(spark, ROOT).stream("agent_messages"), agent, f"{folder}/{agent}")
        want = filters.mailbox_unread(Shop(spark, ROOT).agent_messages, agent)
        assert as_set(got.select("id")) == as_set(want.select("id"))


def test_order_sync_over_files_keeps_each_id_once(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.lineitem, f"{folder}/in")
    paid = filters.paid_orders(order_rows(shop.raw_orders))
    got = jobs.order_sync(stream(spark, f"{folder}/in", "lineitem", "raw_orders"), f"{folder}/sync")
    ids = [r.transaction_id for r in got.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r.id for r in paid.select("id").distinct().collect()} - {None}

    # the same orders again, late, in a new file
    split_files(shop.lineitem, f"{folder}/in", 1)
    again = jobs.order_sync(stream(spark, f"{folder}/in", "lineitem", "raw_orders"), f"{folder}/sync")
    assert sorted(r.transaction_id for r in again.collect()) == sorted(ids)


def test_order_sync_in_one_batch_equals_batch_sync(spark, folder):
    shop = Shop(spark, ROOT)
    got = jobs.order_sync(shop.stream("raw_orders"), folder)
    want = mutations.ledger_sync(order_rows(shop.raw_orders), spark.createDataFrame([], TABLES["transactions"]))
    assert as_set(got) == as_set(want)


def test_order_sync_does_not_depend_on_the_split(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.lineitem, f"{folder}/in", 3)
    got = jobs.order_sync(stream(spark, f"{folder}/in", "lineitem", "raw_orders"), f"{folder}/sync")
    want = mutations.ledger_sync(order_rows(shop.raw_orders), spark.createDataFrame([], TABLES["transactions"]))
    assert as_set(got) == as_set(want) and got.count() == want.count()


def test_an_earlier_order_of_a_later_batch_wins(spark, folder):
    def texts(*orders):
        rows = [(f'{{"id":"{k}","status":"paid","amount":{n},"created_at":"{t}"}}',) for k, n, t in orders]
        spark.createDataFrame(rows, "payload string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        given = spark.readStream.schema("payload string").parquet(f"{folder}/in")
        return {(r.transaction_id, float(r.amount)) for r in jobs.order_sync(given, f"{folder}/sync").collect()}

    assert texts(("a", 500, "2024-01-02 00:00:00"), ("b", 100, "2024-01-01 00:00:00")) == {("a", 5.0), ("b", 1.0)}
    assert texts(("a", 300, "2024-01-01 00:00:00"), ("b", 900, "2024-01-05 00:00:00")) == {("a", 3.0), ("b", 1.0)}


def test_a_batch_reads_no_earlier_output(spark, folder):
    schema = Shop(spark, ROOT).leads.schema
    seen = []
    read, jobs._output = jobs._output, lambda *a: seen.append(a) or read(*a)
    try:
        split_files(Shop(spark, ROOT).customer, f"{folder}/in", 6)
        jobs.lead_capture(stream(spark, f"{folder}/in", "customer", "leads"), f"{folder}/leads").collect()
    finally:
        jobs._output = read
    assert len(seen) == 1 and "email" in schema.names  # the result alone, not once for each batch


def test_one_file_is_streamed_without_asking_the_local_disk(spark, folder):
    shop = Shop(spark, ROOT)
    shop.events.coalesce(1).write.parquet(f"{folder}/x")
    part = next(p for p in os.listdir(f"{folder}/x") if p.endswith(".parquet"))
    os.makedirs(f"{folder}/root")
    os.link(f"{folder}/x/{part}", f"{folder}/root/events.parquet")
    got = jobs.agent_state(Shop(spark, f"file://{folder}/root").stream("agent_runs"), f"{folder}/state")
    assert as_set(got) == as_set(aggregates.agent_state(shop.agent_runs))


def test_agent_state_over_files(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.events, f"{folder}/in")
    got = jobs.agent_state(stream(spark, f"{folder}/in", "events", "agent_runs"), f"{folder}/state")
    assert as_set(got) == as_set(aggregates.agent_state(shop.agent_runs))


def test_lead_capture_over_files(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.customer, f"{folder}/in")
    got = jobs.lead_capture(stream(spark, f"{folder}/in", "customer", "leads"), f"{folder}/leads")
    emails = [r.email for r in got.collect()]
    assert len(emails) == len(set(emails))
    assert set(emails) == {r.email for r in shop.leads.collect() if r.email and "@" in r.email}


def test_streams_of_nothing(spark, folder):
    split_files(Shop(spark, ROOT).events.where("false"), f"{folder}/in", 1)
    assert jobs.agent_state(stream(spark, f"{folder}/in", "events", "agent_runs"), f"{folder}/state").count() == 0
    assert jobs.mailbox(stream(spark, f"{folder}/in", "events", "agent_messages"), "sales", f"{folder}/box").count() == 0


def test_a_table_may_be_a_folder_of_files(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.events, f"{folder}/events.parquet")
    copy = Shop(spark, folder)
    assert as_set(copy.agent_messages) == as_set(shop.agent_messages)
    got = jobs.agent_state(copy.stream("agent_runs", files_per_batch=2), f"{folder}/state")
    assert as_set(got) == as_set(aggregates.agent_state(shop.agent_runs))


def test_late_sales_count(spark, folder):
    def sales(*given):
        rows = spark.createDataFrame(list(given), "at string, value string")
        return rows.select(F.col("at").cast("timestamp"), F.col("value").cast("decimal(18,2)"))

    schema = sales(("2024-01-01", "1")).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        return {str(r.date): (r.sales_count, r.revenue) for r in jobs.daily_sales(stream, f"{folder}/days").collect()}

    sales(("2024-01-20 10:00:00", "2.50"), ("2024-01-20 23:59:59", "1")).write.parquet(f"{folder}/in")
    assert run() == {"2024-01-20": (2, 3.5)}
    sales(("2024-01-01 00:00:00", "4"), ("2024-01-20 00:00:00", "1")).write.mode("append").parquet(f"{folder}/in")
    assert run() == {"2024-01-01": (1, 4.0), "2024-01-20": (3, 4.5)}


def test_daily_metrics_over_files_equal_the_batch(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.orders, f"{folder}/orders")
    split_files(shop.part, f"{folder}/part", 4)
    inputs = {"transactions": "orders", "opportunities": "part", "products": "part"}
    want = as_set(aggregates.daily_metrics(*[getattr(shop, v) for v in inputs]))

    def run():
        streams = [stream(spark, f"{folder}/{t}", t, v) for v, t in inputs.items()]
        return as_set(jobs.daily_metrics(*streams, f"{folder}/daily"))

    assert None in {r[0] for r in want}  # what has no time
    assert run() == want and run() == want


def test_a_batch_replaces_only_its_days(spark, folder):
    schema = TABLES["transactions"]

    def sale(day, net):
        row = spark.createDataFrame([(net, day)], "net string, day string").select(
            F.lit(1).alias("id"), F.lit("sale").alias("type"), F.col("net").cast("decimal(18,4)").alias("net"),
            F.col("day").cast("timestamp").alias("occurred_at"))
        conform(row, schema).write.mode("append").parquet(f"{folder}/in")

    def run():
        nothing = {t: spark.createDataFrame([], TABLES[t]) for t in ("opportunities", "products")}
        for t, df in nothing.items():
            df.write.mode("overwrite").parquet(f"{folder}/{t}")
        streams = [spark.readStream.schema(TABLES[t]).parquet(f"{folder}/{p}") for t, p in
                   (("transactions", "in"), ("opportunities", "opportunities"), ("products", "products"))]
        got = {str(r["date"]): (float(r["revenue"]), r["sales_count"]) for r in
               jobs.daily_metrics(*streams, f"{folder}/daily").collect()}
        files = {d: sorted(f for f in os.listdir(f"{folder}/daily/table/{d}") if f.endswith(".parquet"))
                 for d in os.listdir(f"{folder}/daily/table") if d.startswith("date=")}
        return got, files

    sale("2024-01-01 10:00:00", "2.5")
    sale("2024-01-02 10:00:00", "1")
    got, files = run()
    assert got == {"2024-01-01": (2.5, 1), "2024-01-02": (1.0, 1)}
    sale("2024-01-02 23:00:00", "4")
    sale("2023-12-01 00:00:00", "8")  # late
    later, after = run()
    assert later == {"2024-01-01": (2.5, 1), "2024-01-02": (5.0, 2), "2023-12-01": (8.0, 1)}
    assert after["date=2024-01-01"] == files["date=2024-01-01"] and after["date=2024-01-02"] != files["date=2024-01-02"]


def test_one_stream_fills_all_mailboxes(spark, folder):
    shop = Shop(spark, ROOT)
    split_files(shop.events, f"{folder}/in")
    agents = spark.createDataFrame([("sales",), ("content",), ("nobody",), ("sales",), (None,)], "agent string")

    def run():
        mail = jobs.mailboxes(stream(spark, f"{folder}/in", "events", "agent_messages"), agents, f"{folder}/boxes")
        return sorted((r.recipient, r.id) for r in mail.collect())

    want = sorted((a, r.id) for a in ("sales", "content", "nobody") for r in filters.mailbox_unread(shop.agent_messages, a).collect())
    assert run() == want
    assert run() == want  # started again, nothing is delivered twice
    one_read = [p for p in os.listdir(f"{folder}/boxes") if p == "checkpoint"]
    assert one_read == ["checkpoint"]
    box = jobs.mailboxes(stream(spark, f"{folder}/in", "events", "agent_messages"), agents, f"{folder}/boxes").where("recipient = 'sales'")
    assert all("recipient=sales" in f for f in box.inputFiles() if "recipient" in f) or box.count() == sum(a == "sales" for a, _ in want)


def test_mailboxes_of_nothing(spark, folder):
    split_files(Shop(spark, ROOT).events.where("false"), f"{folder}/in", 1)
    agents = spark.createDataFrame([("sales",)], "agent string")
    assert jobs.mailboxes(stream(spark, f"{folder}/in", "events", "agent_messages"), agents, f"{folder}/boxes").count() == 0


BAD = ['{"id":"a","amount":1', "<html>", "", "[1, 2]", '"text"', None]
GOOD = ['{"id":"a","amount":1}', "{}", '{"id":"b","amount":"no number","status":"paid"}', '{"id":null}']


def test_every_order_payload_is_read_or_rejected_in_a_stream(spark, folder):
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(BAD + GOOD)], "payload string, n int")
    rows.repartition(3).write.parquet(f"{folder}/in")
    given = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = jobs.rejected_payloads(given, "orders", f"{folder}/bad")
    assert sorted(r.n for r in got.collect()) == list(range(len(BAD)))
    assert jobs.rejected_payloads(given, "orders", f"{folder}/bad").count() == len(BAD)
    assert order_rows(rows).count() == len(GOOD)


def test_positions_over_files_in_order_equal_the_batch(spark, folder):
    shop = Shop(spark, ROOT)
    cuts = shop.events.approxQuantile("event_id", [0.3, 0.31, 0.8], 0.0)
    ordered = shop.events.selectExpr("*", "row_number() OVER (ORDER BY ts, event_id) AS at").cache()
    bounds = [0, *[int(c) + 1 for c in cuts], ordered.count() + 1]
    for a, b in zip(bounds, bounds[1:]):
        ordered.where(F.col("at").between(a, b - 1)).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        return as_set(jobs.drain_order(stream(spark, f"{folder}/in", "events", "agent_messages"), f"{folder}/out-of-order"))

    want = as_set(windows.drain_positions(shop.agent_messages, f"{folder}/batch"))
    assert run() == want and run() == want
    # late mail takes the next numbers and leaves the others as they are
    first = ordered.where("at <= 40").drop("at").withColumn("event_id", F.col("event_id") + 10**6)
    first.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    later = run()
    assert want < later and len(later) > len(want)
    for box in {r[1] for r in later}:
        assert sorted(r[-1] for r in later if r[1] == box) == list(range(1, 1 + sum(r[1] == box for r in later)))
