"""Edge rows and rules that the generated tables do not hold."""

import json
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.functions import money, pace, text
from ledgerloom.operators import aggregates, feeds, filters, joins, mutations, quality, reports, sets, windows
from ledgerloom.schemas import DEFAULTS, TABLES, conform, moment, row_id, with_defaults
from ledgerloom.sinks import outbox, snapshot, tables
from ledgerloom.sources import payloads
from ledgerloom.sources.tables import load

AS_OF = "2024-01-31 00:00:00"


def empty(spark, name):
    return spark.createDataFrame([], TABLES[name])


def rows(spark, name, *records):
    """Rows of a domain table, given as dicts."""
    columns = list(dict.fromkeys(c for r in records for c in r))
    ddl = ", ".join(f"{c} {TABLES[name][c].dataType.simpleString()}" if c in TABLES[name].names else f"{c} string"
                    for c in columns)
    given = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in records], ddl.replace("timestamp", "string"))
    return conform(given, TABLES[name])


def one(df, expr):
    return df.select(expr).first()[0]


# empty tables show zeros


def test_totals_of_nothing_are_zero(spark):
    tx, products = empty(spark, "transactions"), empty(spark, "products")
    t = aggregates.totals(tx).first()
    assert (t.revenue, t.expenses, t.net, t.sales) == (0, 0, 0, 0)
    s = aggregates.sales_total(tx).first()
    assert (s.revenue, s.sales, s.avg_order) == (0, 0, 0.0)
    c = aggregates.catalog_counts(products).first()
    assert (c.total_listed, c.total_draft, c.potential_gmv) == (0, 0, 0)
    assert tuple(aggregates.days_running(products, AS_OF).first()) == (None, 1)


def test_summaries_of_nothing_are_zero(spark):
    orders = payloads.order_rows(spark.createDataFrame([], "payload string"))
    m = aggregates.marketplace_summary(filters.paid_orders(orders)).first()
    assert tuple(m) == (0, 0.0, 0.0)
    s = mutations.sync_summary(orders, empty(spark, "transactions")).first()
    assert tuple(s) == (0, 0, 0, 0.0, 0.0)


def test_snapshot_of_nothing(spark):
    row = snapshot.snapshot(*[empty(spark, t) for t in (
        "transactions", "products", "opportunities", "market_insights", "agent_messages", "daily_metrics", "agent_state",
    )], goal=20000, as_of=AS_OF)
    assert json.loads(snapshot.snapshot_json(row).first().body) == dict(
        revenue=0.0, sales=0, goal=20000.0, pct=0.0, run_rate=0.0, days_running=1, total_listed=0, total_draft=0,
        potential_gmv=0.0, opp_open=0, opp_completed=0, opp_by_status={}, agents=[], recent_products=[], recent_insights=[], activity=[],
        daily=[],
    )


def test_topic_context_of_nothing_is_empty(spark):
    assert feeds.topic_context(empty(spark, "market_insights")).first().context == ""


def test_topic_context_puts_unscored_last(spark):
    insights = rows(
        spark, "market_insights",
        dict(id=1, category="trend", title="none", score=None, created_at="2024-01-03"),
        dict(id=2, category="niche", title="low", score=Decimal(1), created_at="2024-01-01"),
        dict(id=3, category="trend", title="high", score=Decimal(9), created_at="2024-01-01"),
        dict(id=4, category="trend", title="high, newer", score=Decimal(9), created_at="2024-01-02"),
    )
    lines = feeds.topic_context(insights).first().context.strip().split("\n")
    assert lines[1:] == ["- high, newer", "- high", "- low", "- none"]


# money and pace


@pytest.mark.parametrize("cents,net", [(0, -40), (999, 999 - 39 - 40), (1700, 1700 - 68 - 40), (25, 25 - 1 - 40)])
def test_net_cents_cuts_the_percentage(spark, cents, net):
    assert one(spark.range(1), money.net_cents(F.lit(cents).cast("bigint"))) == net


def test_fee_is_exact(spark):
    amount = F.lit(Decimal("17.33")).cast("decimal(18,2)")
    assert one(spark.range(1), money.order_fee(amount)) == Decimal("1.0932")


def test_a_loss_shows_as_zero(spark):
    orders = payloads.order_rows(spark.createDataFrame(
        [('{"id":"a","status":"paid","amount":10,"created_at":"2024-01-01 00:00:00"}',)], "payload string"))
    m = aggregates.marketplace_summary(filters.paid_orders(orders)).first()
    assert (m.total_orders, m.gross_revenue_usd, m.net_revenue_usd) == (1, 0.1, 0.0)


def test_net_amount_by_kind(spark):
    df = spark.createDataFrame([("sale", 10), ("refund", -10), ("expense", 10), ("expense", -10)], "k string, a int")
    net = money.net_amount(F.col("k"), F.col("a").cast("decimal(18,2)"), F.lit(1))
    assert [float(r[0]) for r in df.select(net).collect()] == [9.0, -11.0, -10.0, -10.0]


def earned(spark, net):
    return rows(spark, "transactions", dict(id=1, type="sale", net=Decimal(net)))


def test_status_line(spark):
    line = reports.status_line(earned(spark, -12345678), empty(spark, "products"), 20).first().line
    assert line == "[STATUS] Revenue: $-12345678.00 / $20 (-61728390.0%) | Products: 0 | Sales: 1"


@pytest.mark.parametrize("as_of,elapsed,left", [
    ("2001-06-29 12:00:00", -2, 62), ("2001-07-01 00:00:00", 0, 60), ("2001-07-31 23:59:59", 30, 30),
    ("2001-10-01 00:00:00", 92, 0),
])
def test_finance_pace_keeps_the_days(spark, as_of, elapsed, left):
    r = reports.finance_pace(earned(spark, 1000), "2001-07-01 00:00:00", as_of, 20000, 60).first()
    assert (r.days_elapsed, r.days_remaining) == (elapsed, left)
    assert r.required_daily_rate == pytest.approx(19000 / left if left else 0)
    assert r.on_track == (1000 / max(1, elapsed) >= 20000 / 60)


def test_analytics_pace_counts_at_least_a_day(spark):
    r = reports.analytics_pace(earned(spark, 1000), "2001-07-01 00:00:00", "2001-06-29 00:00:00", 20000, 60).first()
    assert (r.days_elapsed, r.days_remaining, r.actual_daily_rate, r.pct_complete) == (1, 59, 1000.0, 5.0)


def test_run_rate_of_no_days_is_zero(spark):
    assert one(spark.range(1), pace.monthly_run_rate(F.lit(5.0), F.lit(0))) == 0.0


# text


@pytest.mark.parametrize("value,shown", [
    (None, "$0"), (0, "$0.00"), (1234.5, "$1,234.50"), (9999.99, "$9,999.99"), (10000, "$10,000"),
    (1234567.8, "$1,234,568"), (-20000.5, "$-20,000.50"),
])
def test_fmt_money(spark, value, shown):
    df = spark.createDataFrame([(None if value is None else float(value),)], "v double")
    assert one(df, text.fmt_money(F.col("v"))) == shown


@pytest.mark.parametrize("then,shown", [
    ("2024-01-30 23:59:01", "59s ago"), ("2024-01-30 23:59:00", "1m ago"), ("2024-01-30 23:00:01", "59m ago"),
    ("2024-01-30 01:00:00", "23h ago"), ("2024-01-29 00:00:00", "2d ago"), (None, "—"), ("2024-01-31 00:00:05", "-5s ago"),
])
def test_fmt_age(spark, then, shown):
    df = spark.createDataFrame([(then,)], "t string")
    assert one(df, text.fmt_age(F.col("t").cast("timestamp"), moment(AS_OF))) == shown


def test_shorten_counts_characters(spark):
    df = spark.createDataFrame([("é" * 52,), ("é" * 53,), (None,)], "t string")
    assert [r[0] for r in df.select(text.shorten(F.col("t"), 52)).collect()] == ["é" * 52, "é" * 52 + "…", None]


def test_html_text_is_whole_and_excerpt_is_cut(spark):
    df = spark.createDataFrame([("<p>" + "word " * 5000 + "</p>\n\n<b>end</b>",)], "h string")
    body, excerpt = df.select(text.html_to_text(F.col("h")), text.page_excerpt(F.col("h"))).first()
    assert body.endswith("word end") and len(body) == 25003 and excerpt == body[:10000]


@pytest.mark.parametrize("answer,titles", [
    ('[{"title":"a","prompt":"p"}]', ["a"]), ('Sure!\n[{"title":"a","prompt":"p"},\n{"title":"b"}]\nBye', ["a", "b"]),
    ("no list", []), ("[broken", []), ("a ] b [ c", []), ('x [1] é [{"title":"a"}] y', []), ('é [{"title":"é"}] ü', ["é"]), ("text [not json] text", []), (None, []),
])
def test_prompt_list(spark, answer, titles):
    df = spark.createDataFrame([(answer,)], "t string")
    assert [i.title for i in one(df, text.prompt_list(F.col("t")))] == titles


def test_safe_filename(spark):
    df = spark.createDataFrame([("a b/ç:1.md",)], "t string")
    assert one(df, text.safe_filename(F.col("t"))) == "a_b___1.md"


# payloads


def payload(spark, *texts, **keys):
    return spark.createDataFrame([(1, t) for t in texts], "query_id int, payload string")


def test_order_fields_default(spark):
    given = payload(
        spark, '{"id":"a","status":"paid","amount":5,"created_at":"2024-01-01 10:00:00"}', "not json",
        '{"id":"b","customer":{},"created_at":"never"}', None,
    )
    got = payloads.order_rows(given).collect()
    assert [(r.id, r.customer_email, r.product_name) for r in got] == [("a", "", ""), ("b", "", "")]
    assert [r.created_at is None for r in got] == [False, True]
    # what is no order is kept aside as it came, instead of a row of nulls
    assert [r.payload for r in payloads.rejected(given, "orders").collect()] == ["not json", None]


def test_paid_is_a_substring_unless_strict(spark):
    orders = payloads.order_rows(payload(spark, *[
        f'{{"id":"{s}","status":"{s}"}}' for s in ("paid", "unpaid", "OrderStatus.PAID", "succeeded", "pending")
    ]))
    assert {r.id for r in filters.paid_orders(orders).collect()} == {"paid", "unpaid", "OrderStatus.PAID", "succeeded"}
    assert {r.id for r in filters.paid_orders(orders, strict=True).collect()} == {"paid", "OrderStatus.PAID", "succeeded"}


def test_search_results_are_all_there_unless_limited(spark):
    results = ",".join(f'{{"title":"t{i}","url":"u"}}' for i in range(12))
    df = payload(spark, f'{{"web":{{"results":[{results}]}}}}', "{}")
    assert [r.title for r in payloads.search_results(df).collect()] == [f"t{i}" for i in range(12)]
    assert [r.title for r in payloads.search_results(df, 10).collect()] == [f"t{i}" for i in range(10)]
    assert {r.snippet for r in payloads.search_results(df, 8, None).collect()} == {None}


def test_posts_page(spark):
    posts = ",".join(f'{{"id":"{i}","title":"t","status":"published","published_at":"2024-01-0{i}"}}' for i in range(1, 6))
    df = payload(spark, f'{{"posts":[{posts},{{"id":"d","status":"draft"}}]}}')
    assert [r.id for r in payloads.posts(df, "published", 2).collect()] == ["5", "4"]
    assert payloads.posts(df).count() == 6


def test_feed_skips_the_channel(spark):
    titles = "".join(f"<title><![CDATA[\n t{i}\u00a0]]></title>" for i in range(15))
    df = spark.createDataFrame([(1, titles), (2, "<title>plain</title>")], "feed_id int, body string")
    assert [r.title for r in payloads.feed_titles(df).collect()] == [f"t{i}" for i in range(1, 15)]
    assert [r.title for r in payloads.feed_titles(df, 9).collect()] == [f"t{i}" for i in range(1, 10)]


def test_jsonapi_refund_defaults_to_false(spark):
    df = payload(spark, '{"data":[{"id":"1","attributes":{"status":"paid","total":5}},'
                        '{"id":"2","attributes":{"status":"paid","total":7,"refunded":true}}]}', '{"data":[]}')
    orders = payloads.store_orders(df)
    assert [(r.id, r.refunded, r.customer_email) for r in orders.collect()] == [("1", False, ""), ("2", True, "")]
    assert [r.id for r in filters.paid_store_orders(orders).collect()] == ["1"]


# mailbox


def messages(spark, *given):
    return rows(spark, "agent_messages", *[
        dict(id=i, from_agent="x", to_agent=to, type="task", payload=body, read=read, created_at="2024-01-01")
        for i, (to, body, read) in enumerate(given)
    ])


CREATE = '{"task":"create_product","opportunityId":%s}'


def test_first_reader_takes_the_broadcasts(spark):
    box = messages(spark, (None, "{}", 0), ("sales", "{}", 0), ("content", "{}", 1), ("blog", "{}", 0), (None, "{}", 1))
    got = mutations.drain_mailbox(box, ["content", "sales"]).orderBy("id").collect()
    assert [(r.delivered_to, r.read) for r in got] == [("content", 1), ("sales", 1), (None, 1), (None, 0), (None, 1)]


def test_creation_tasks_need_an_opportunity(spark):
    box = messages(spark, ("content", CREATE % 7, 0), ("content", CREATE % 0, 0), ("content", CREATE % '"x"', 0),
                   ("content", '{"task":"create_product"}', 0), ("content", '{"task":"list_product"}', 0))
    assert [r.opportunity_id for r in filters.creation_tasks(box).collect()] == [7]


def test_work_list_prefers_messages(spark):
    opps = rows(spark, "opportunities", *[
        dict(id=i, type="t", title=f"o{i}", status="pending" if i < 6 else "sold", estimated_revenue=Decimal(i))
        for i in range(1, 9)
    ])
    box = messages(spark, ("content", CREATE % 2, 0), (None, CREATE % 2, 0), ("content", CREATE % 7, 0))
    assert [(r.id, r.origin) for r in sets.work_list(box, opps, "content").collect()] == [(2, "message")]
    only_sold = messages(spark, ("content", CREATE % 7, 0))
    got = {(r.id, r.origin) for r in sets.work_list(only_sold, opps, "content").collect()}
    assert got == {(5, "fallback"), (4, "fallback"), (3, "fallback")}


def test_positions_split_a_hot_mailbox(spark, folder):
    rng = random.Random(7)
    given = [(i, rng.choice([None, None, "content", "content", "content", "sales"]), rng.randint(0, 40), i % 5 == 0)
             for i in range(3000)]
    box = spark.createDataFrame(
        [(i, "x", to, "task", "{}", int(read), f"2024-01-01 00:00:{at:02d}") for i, to, at, read in given],
        "id long, from_agent string, to_agent string, type string, payload string, read int, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    # Small partitions would be merged into one; keep them apart as large ones would be.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.to_agent, r.position) for r in windows.drain_positions(box, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, boxes = {}, defaultdict(list)
    for i, to, at, read in given:
        if not read:
            boxes[to].append((at, i))
    for to, held in boxes.items():
        want |= {i: (to, n) for n, (_, i) in enumerate(sorted(held), 1)}
    assert got == want
    parts = spark.read.parquet(f"{folder}/rows").where("to_agent = 'content'")
    assert parts.select(F.shiftright("slot", windows.ROW_BITS)).distinct().count() > 1


def test_activity_defaults(spark):
    box = messages(spark, (None, '{"task":"","title":"hello"}', 0), ("", "not json", 0), ("a", '{"task":"%s"}' % ("x" * 50), 0))
    got = feeds.activity_lines(box, AS_OF).orderBy("id").collect()
    assert [(r.recipient, r.subject) for r in got] == [("broadcast", "hello"), ("broadcast", ""), ("a", "x" * 40)]


# orders and ledger


def order_texts(n=400):
    """Repeated ids, one of them a third of all orders."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"o{rng.randint(0, n // 2)}"
        status = rng.choice(["paid", "unpaid", "pending", "succeeded"])
        out.append((key, status, rng.randint(100, 9000), f"2024-01-{rng.randint(1, 28):02d} 00:00:00"))
    return out


def order_frame(spark, orders):
    return payloads.order_rows(payload(spark, *[
        f'{{"id":"{k}","status":"{s}","amount":{a},"created_at":"{t}"}}' for k, s, a, t in orders
    ]))


def test_first_order_wins(spark):
    given = order_texts()
    best = {}
    for k, s, a, t in given:
        best[k] = min(best.get(k, (t, a, s)), (t, a, s))
    got = {r.id: (str(r.created_at), r.amount, r.status) for r in windows.first_orders(order_frame(spark, given)).collect()}
    assert got == best


def test_an_order_without_a_time_comes_last(spark):
    orders = payloads.order_rows(payload(
        spark, '{"id":"a","amount":1}', '{"id":"a","amount":2,"created_at":"2024-01-01 00:00:00"}', '{"id":"b","amount":3}'))
    assert {r.id: r.amount for r in windows.first_orders(orders).collect()} == {"a": 2, "b": 3}


def test_second_sync_adds_nothing(spark, folder):
    orders = order_frame(spark, order_texts())
    tables.append(mutations.ledger_sync(orders, empty(spark, "transactions")), folder, "transactions", AS_OF)
    ledger = load(spark, folder, "transactions")
    paid = {k for k, s, _, _ in order_texts() if "paid" in s or "succeeded" in s}
    assert {r.transaction_id for r in ledger.collect()} == paid and ledger.count() == len(paid)
    assert mutations.ledger_sync(orders, ledger).count() == 0
    assert mutations.ledger_sync_batch(orders, ledger, f"{folder}/staged").count() == 0
    summary = mutations.sync_summary(orders, ledger).first()
    assert summary.inserted == 0 and summary.fetched == sum("paid" in s or "succeeded" in s for _, s, _, _ in order_texts())


def test_ledger_rows_without_id_do_not_hide_orders(spark):
    orders = order_frame(spark, [("a", "paid", 100, "2024-01-01 00:00:00")])
    ledger = rows(spark, "transactions", dict(id=1, transaction_id=None, type="expense"))
    assert joins.not_in_ledger(orders, ledger).count() == 1


def test_rollup_counts_sales_only(spark):
    products = rows(spark, "products", dict(id=1, title="a"), dict(id=2, title="b"))
    tx = rows(spark, "transactions", *[
        dict(id=i, product_id=p, type=k, net=Decimal(n))
        for i, (p, k, n) in enumerate([(1, "sale", 5), (1, "sale", 6), (1, "refund", -5), (2, "expense", -3), (None, "sale", 9)])
    ])
    got = {r.id: (r.sales, float(r.revenue)) for r in aggregates.product_rollup(products, tx).collect()}
    assert got == {1: (2, 11.0), 2: (0, 0.0)}


def test_agent_state_takes_a_null_task(spark):
    runs = spark.createDataFrame(
        [(1, "a", "running", "t", "2024-01-01"), (2, "a", "idle", None, "2024-01-01"), (3, "b", "error", "x", "2024-01-02")],
        "seq long, agent_id string, status string, current_task string, run_at string",
    ).withColumn("run_at", F.to_timestamp("run_at"))
    got = {r.agent_id: (r.status, r.current_task, r.run_count, r.runs_started) for r in aggregates.agent_state(runs).collect()}
    assert got == {"a": ("idle", None, 2, 1), "b": ("error", "x", 1, 0)}


def test_expenses_take_away(spark):
    given = spark.createDataFrame([(12.5, "api", None), (-3.0, "host", "ops")], "amount double, description string, category string")
    got = [(float(r.net), r.platform, r.type) for r in mutations.expense_rows(given).collect()]
    assert got == [(-12.5, "general", "expense"), (-3.0, "ops", "expense")]


# products and opportunities


def test_publishing_changes_only_the_published(spark):
    products = rows(spark, "products", dict(id=1, opportunity_id=10, title="a", price=Decimal(5), status="draft", created_at="2024-01-01"),
                    dict(id=2, opportunity_id=None, title="b", price=Decimal(6), status="draft", created_at="2024-01-01"),
                    dict(id=3, opportunity_id=11, title="c", price=Decimal(7), status="draft", created_at="2024-01-01"))
    opps = rows(spark, "opportunities", *[dict(id=i, status="in_progress", created_at="2024-01-01") for i in (10, 11)])
    published = spark.createDataFrame([(8, 1, "A", "d", 990, "pl", "u"), (7, 1, "early", "d", 5, "pl", "u"),
                                       (9, 2, "B", "d", 100, "pl2", "u2")],
                                      "request_id long, product_id long, title string, description string, price_cents long, platform_id string, platform_url string")
    got = mutations.products_listed(products, published, AS_OF).orderBy("id").collect()
    assert [(r.title, float(r.price), r.status, str(r.updated_at)) for r in got] == [
        ("A", 9.9, "listed", AS_OF), ("B", 1.0, "listed", AS_OF), ("c", 7.0, "draft", "2024-01-01 00:00:00")]
    parents = mutations.parents_listed(opps, products, published, AS_OF).orderBy("id").collect()
    assert [(r.status, str(r.updated_at)) for r in parents] == [("listed", AS_OF), ("in_progress", "2024-01-01 00:00:00")]


def found(spark, *records):
    return spark.createDataFrame(
        list(records), "id long, type string, title string, estimated_revenue decimal(18,2), difficulty string, "
                       "target_audience string, keywords array<string>")


def test_ingest_keeps_the_first_of_a_new_title(spark):
    batch = found(spark, (3, "t", "new", None, None, None, None), (2, "t", "new", Decimal(2000), "easy", "devs", ["k"]),
                  (4, "t", "old", Decimal(1), None, None, None), (5, "u", "other", None, None, None, None))
    known = rows(spark, "opportunities", dict(id=1, title="old"), dict(id=9, title=None))
    got = sorted((r.id, r.kind, r.value, r.body) for r in mutations.ingest_opportunities(batch, known).collect())
    assert [(i, k, v) for i, k, v, _ in got] == [
        (2, "insight", 2.0), (2, "message", None), (2, "opportunity", 2000.0),
        (5, "insight", 0.5), (5, "message", None), (5, "opportunity", 500.0)]
    assert got[2][3] == '{"keywords":["k"],"difficulty":"easy","target_audience":"devs"}'
    assert got[5][3] == '{"keywords":[],"difficulty":"medium","target_audience":""}'


def test_default_topics_stand_in_for_none(spark):
    none = spark.createDataFrame([("",), (None,)], "title string")
    some = spark.createDataFrame([("a",), ("a",), ("b",)], "title string")
    feed = spark.createDataFrame([("b",), ("c",)], "title string")
    assert {r.topic for r in sets.topics(none, None).collect()} == set(sets.DEFAULT_TOPICS)
    assert {(r.topic, r.source) for r in sets.topics(some, None).collect()} == {("a", 0), ("b", 0)}
    assert {(r.topic, r.source) for r in sets.topics(some, feed).collect()} == {("a", 0), ("b", 0), ("c", 1)}
    assert sets.topics(none, feed.where("false")).count() == 0


def test_leads_need_a_niche(spark):
    leads = spark.createDataFrame([(1, "", "a@b"), (2, None, "a@b"), (3, "x", None), (4, "x", "a@b"), (5, "x", "ab")],
                                  "id int, niche string, email string")
    assert [(r.id, r.has_email) for r in filters.valid_leads(leads).orderBy("id").collect()] == [(3, False), (4, True), (5, False)]


# sinks


@pytest.mark.parametrize("name", sorted(DEFAULTS))
def test_append_fills_defaults(spark, folder, name):
    given = spark.createDataFrame([(1,), (2,)], "id long")
    tables.append(given, folder, name, AS_OF)
    tables.append(given.where("id = 1").withColumn("id", F.lit(3)), folder, name, AS_OF)
    stored = load(spark, folder, name)
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    for column, value in DEFAULTS[name].items():
        assert {r[column] for r in stored.collect()} == {value}


def test_rewritten_files_cover_narrow_ranges(spark, folder):
    box = messages(spark, *[(("a", "b", None)[i % 3], "{}", i % 2) for i in range(900)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.rewrite(box, folder, "agent_messages")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = load(spark, folder, "agent_messages")
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in box.collect()}
    files = stored.groupBy(F.input_file_name().alias("f")).agg(F.collect_set("to_agent").alias("boxes"))
    assert files.count() > 1 and max(len(r.boxes) for r in files.collect()) <= 2


@pytest.mark.parametrize("name", sorted(TABLES))
def test_rewritten_tables_read_back(spark, folder, name):
    tables.rewrite(empty(spark, name), folder, name)
    stored = load(spark, folder, name)
    assert stored.count() == 0 and conform(stored, TABLES[name]).schema == TABLES[name]
    assert set(stored.columns) - set(TABLES[name].names) == ({"day"} if name == "transactions" else set())


def test_given_values_beat_defaults(spark):
    given = spark.createDataFrame([(1, "listed"), (2, None)], "id long, status string")
    got = with_defaults(given, "products", AS_OF).orderBy("id").collect()
    assert [(r.status, str(r.created_at)) for r in got] == [("listed", AS_OF), ("draft", AS_OF)]


def test_listing_without_file_has_no_note(spark):
    requests = spark.createDataFrame([(1, "t" * 70, "d", 0, None), (2, "t", "d", 500, "a/b/c.pdf")],
                                     "product_id int, title string, description string, price_cents long, file_path string")
    a, b = outbox.listing_batch(requests).orderBy("product_id").collect()
    assert (len(a.name), a.description, a.is_free) == (64, "d", True)
    assert "**c.pdf" not in b.description and "c.pdf\n" in b.description and not b.is_free


def test_post_body_leaves_out_what_is_missing(spark):
    articles = spark.createDataFrame([(1, "t", "<p>", "draft", None, None), (2, "t", "<p>", "published", ["a", "b"], "m")],
                                     "id int, title string, html string, status string, tags array<string>, meta_description string")
    a, b = [r.body for r in outbox.post_batch(articles, AS_OF).orderBy("id").collect()]
    assert a == '{"posts":[{"title":"t","html":"<p>","status":"draft"}]}'
    assert b == ('{"posts":[{"title":"t","html":"<p>","status":"published","tags":[{"name":"a"},{"name":"b"}],'
                 '"meta_description":"m","og_description":"m","published_at":"2024-01-31T00:00:00+00:00"}]}')


# quality


def test_orphans_and_broken_references(spark):
    products = rows(spark, "products", dict(id=1), dict(id=2))
    tx = rows(spark, "transactions", *[dict(id=i, product_id=p) for i, p in enumerate([1, 1, 7, 7, None])])
    assert [r.id for r in quality.orphans(tx, "product_id", products).orderBy("id").collect()] == [2, 3]
    r = quality.foreign_key(tx, "product_id", products, "transactions").first()
    assert (r.checked, r.broken) == (4, 2)


def test_counts_of_violations(spark):
    insights = rows(spark, "market_insights", dict(id=1, category="trend", score=Decimal(11)), dict(id=2, category=None, score=None))
    assert [tuple(r) for r in quality.not_null(insights, "market_insights", ("category", "title")).collect()] == [
        ("market_insights", "category", 1), ("market_insights", "title", 2)]
    assert quality.outside_range(insights, "market_insights", "score", 0, 10).first().violations == 1
    assert quality.outside(insights, "market_insights", "category", ("niche",)).collect()[0].n == 1


def test_required_fields_are_present_and_readable(spark):
    df = payload(spark, '{"id":"a","amount":5}', '{"id":"b","amount":"x"}', '{"amount":5}', "not json")
    got = {r.check: r.violations for r in quality.missing_fields(df, "o", payloads.ORDER, ("id", "amount")).collect()}
    assert got == {"id": 2, "amount": 2}


# workspace


def test_folders_are_under_the_shared_folder(spark):
    made = {workspace.new_folder(spark, "job") for _ in range(3)}
    shared = spark.conf.get("spark.checkpoint.dir")
    assert len(made) == 3 and all(m.startswith(f"{shared}/ledgerloom-") and "/job-" in m for m in made)


def test_staged_rows_read_back_with_their_schema(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a long, b string")
    for given in (df, df.limit(0)):
        back = workspace.staged(given, "x")
        assert back.schema == df.schema and {tuple(r) for r in back.collect()} == {tuple(r) for r in given.collect()}


# rows that lack what others have


def test_undated_money_is_in_the_daily_figures(spark):
    tx = rows(spark, "transactions", dict(id=1, type="sale", net=Decimal("4.40"), occurred_at="2024-01-01"),
              dict(id=2, type="sale", net=Decimal("8.24")))
    daily = aggregates.daily_metrics(tx, empty(spark, "opportunities"), empty(spark, "products")).collect()
    assert {r.date is None: float(r.revenue) for r in daily} == {False: 4.40, True: 8.24}
    assert sum(r.revenue for r in daily) == aggregates.totals(tx).first().revenue


def test_orders_without_id_are_rejected_and_never_synced(spark, folder):
    orders = payloads.order_rows(payload(
        spark, '{"status":"paid","amount":500}', '{"status":"paid","amount":700}', '{"id":"a","status":"paid","amount":900}'))
    assert [r.amount for r in windows.first_orders(orders).collect()] == [900]
    assert sorted(r.amount for r in windows.rejected_orders(orders).collect()) == [500, 700]
    tables.append(mutations.ledger_sync(orders, empty(spark, "transactions")), folder, "transactions", AS_OF)
    ledger = load(spark, folder, "transactions")
    assert [(r.transaction_id, r.id is not None) for r in ledger.collect()] == [("a", True)]
    assert mutations.ledger_sync(orders, ledger).count() == 0
    s = mutations.sync_summary(orders, ledger).first()
    assert (s.fetched, s.inserted, s.rejected, s.gross) == (3, 0, 2, 21.0)


@pytest.mark.parametrize("name", sorted(DEFAULTS))
def test_rows_appended_without_an_id_get_one(spark, folder, name):
    first = {"transactions": "transaction_id", "agent_messages": "payload"}.get(name, "title")
    tables.append(spark.createDataFrame([("x",), ("y",), (None,)], f"{first} string"), folder, name, AS_OF)
    ids = [r.id for r in load(spark, folder, name).collect()]
    assert None not in ids and len(set(ids)) == 3


def test_snapshot_has_every_agent_and_status(spark):
    tables_given = {t: empty(spark, t) for t in (
        "transactions", "products", "market_insights", "agent_messages", "daily_metrics")}
    agents = spark.createDataFrame([("critic", 1), ("scanner", 2)], "agent_id string, run_count long")
    opps = rows(spark, "opportunities", *[dict(id=i, status=k) for i, k in enumerate(["sold", "failed", "sold", "pending"])])
    row = snapshot.snapshot(
        tables_given["transactions"], tables_given["products"], opps, tables_given["market_insights"],
        tables_given["agent_messages"], tables_given["daily_metrics"], conform(agents, TABLES["agent_state"]), 1, AS_OF).first()
    assert [a.agent_id for a in row.agents] == ["critic", "scanner"]
    assert row.opp_by_status == {"sold": 2, "failed": 1, "pending": 1} and row.opp_open == 1


def test_empty_links_are_left_out_of_a_post(spark):
    articles = spark.createDataFrame(
        [(1, "t", "h", "draft", None, None, "", "c")], "id int, title string, html string, status string, "
        "tags array<string>, meta_description string, feature_image string, canonical_url string")
    assert outbox.post_batch(articles, AS_OF).first().body == \
        '{"posts":[{"title":"t","html":"h","status":"draft","canonical_url":"c"}]}'


def test_ingested_rows_can_be_appended(spark, folder):
    batch = found(spark, (2, "t", "new", Decimal(2000), "easy", "devs", ["k"])).withColumn("description", F.lit("long text"))
    for table, df in mutations.ingested(batch, empty(spark, "opportunities")).items():
        tables.append(df, folder, table, AS_OF)
    assert load(spark, folder, "opportunities").first().description == "long text"
    assert load(spark, folder, "agent_messages").first().read == 0
    assert float(load(spark, folder, "market_insights").first().score) == 2.0


def described(spark, *records):
    return found(spark, *records).withColumn("description", F.concat(F.lit("about "), "title"))


def ids_by_table(tables_given):
    return (sorted((r.id, r.title, r.description) for r in tables_given["opportunities"].collect()),
            sorted(json.loads(r.payload)["opportunityId"] for r in tables_given["agent_messages"].collect()),
            sorted(r.title for r in tables_given["market_insights"].collect()))


def test_found_opportunities_without_ids_get_one_id_in_all_tables(spark):
    batch = described(spark, (None, "t", "a", None, None, None, None), (None, "t", "b", None, None, None, None),
                      (None, "u", "a", Decimal(3), None, None, None), (7, "t", "c", None, None, None, None))
    opportunities, tasks, insights = ids_by_table(mutations.ingested(batch, empty(spark, "opportunities")))
    assert [t for _, t, _ in sorted(opportunities, key=lambda r: r[1])] == ["a", "b", "c"] == insights
    assert len({i for i, _, _ in opportunities}) == 3 and 7 in {i for i, _, _ in opportunities}
    assert tasks == [i for i, _, _ in opportunities] and None not in tasks
    assert all(d == f"about {t}" for _, t, d in opportunities)
    again, _, _ = ids_by_table(mutations.ingested(batch, empty(spark, "opportunities")))
    assert again == opportunities


def test_a_shared_or_known_id_gives_no_extra_rows(spark):
    batch = described(spark, (5, "t", "a", None, None, None, None), (5, "t", "b", None, None, None, None),
                      (1, "t", "c", None, None, None, None), (6, "t", "d", None, None, None, None))
    known = rows(spark, "opportunities", dict(id=1, title="old"), dict(id=9, title="d"))
    opportunities, tasks, insights = ids_by_table(mutations.ingested(batch, known))
    assert sorted(t for _, t, _ in opportunities) == ["a", "b", "c"] == insights
    by_title = {t: i for i, t, _ in opportunities}
    assert by_title["a"] == 5 and len(set(by_title.values()) | {1}) == 4
    assert tasks == sorted(by_title.values())


def test_hashed_ids_that_meet_are_hashed_anew(spark):
    batch = found(spark, *[(None, "t", f"title {i}", None, None, None, None) for i in range(40)])
    known = rows(spark, "opportunities", *[dict(id=i, title=f"old {i}") for i in range(20)])
    got = [r.id for r in mutations.identified(batch, known, bits=7).collect()]
    assert len(set(got)) == 40 and min(got) >= 20 and max(got) < 128
    got = mutations.identified(batch, spark.createDataFrame([], "title string"), bits=6).collect()
    assert len({r.id for r in got}) == 40 and {r.title for r in got} == {f"title {i}" for i in range(40)}


def test_parts_of_an_id_do_not_run_together(spark):
    parts = spark.createDataFrame([("a|b", "", 1), ("a", "b|", 1), ("", None, 1), (None, "", 1), ("1:", "x", 1), ("", "1:x", 1)],
                                  "a string, b string, n int")
    assert parts.select(row_id(F.col("a"), F.col("b"))).distinct().count() == 6


@pytest.mark.parametrize("kind, good, read", [
    ("store_orders", '{"data":[{"id":"1","attributes":{"status":"paid"}},{"id":"2"}]}', payloads.store_orders),
    ("stores", '{"data":[{"id":"1","attributes":{"name":"x"}},{"id":"2"}]}', payloads.stores),
    ("marketplace_products", '{"items":[{"id":"1"},{"id":"2"}]}', payloads.marketplace_products),
    ("posts", '{"posts":[{"id":"1"},{"id":"2"}]}', payloads.posts),
])
def test_unreadable_payloads_are_kept_aside(spark, kind, good, read):
    given = [good, good[:-4], "not json", None, good]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(given)], "payload string, status int")
    assert [tuple(r) for r in payloads.rejected(df, kind).orderBy("status").collect()] == [(given[i], i) for i in (1, 2, 3)]
    assert read(df).count() == 4


def test_orders_without_readable_payload_are_no_orders(spark):
    df = spark.createDataFrame([('{"id":"a","amount":1}',), ('{"id":"a","amo',), ("x",), (None,), ("{}",)], "payload string")
    assert sorted((r.id or "", r.amount) for r in payloads.order_rows(df).collect()) == [("", None), ("a", 1)]
    assert payloads.order_rows(df, "id").count() == 2 and payloads.rejected(df, "orders").count() == 3
