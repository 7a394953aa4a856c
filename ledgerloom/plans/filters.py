"""Filters and projections."""

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, filters
from ledgerloom.plans.registry import AS_OF_TXN, as_double, plan
from ledgerloom.sources import payloads


@plan("flt_mailbox_unread", """
    SELECT id, from_agent, type, payload->>'$.task' AS task, payload->>'$.title' AS title,
           payload->>'$.opportunityId' AS opportunity_id, created_at FROM unread_for_content""")
def mailbox_unread(s):
    p = F.col("payload")
    return filters.mailbox_unread(s.agent_messages, "content").select(
        "id", "from_agent", "type", p["task"].alias("task"), p["title"].alias("title"),
        p["opportunityId"].alias("opportunity_id"), "created_at",
    )


@plan("flt_status_count", "SELECT count(*) AS n_listed FROM products WHERE status = 'listed'")
def status_count(s):
    return filters.listed(s.products).agg(F.count("*").alias("n_listed"))


@plan("flt_catalog", """
    SELECT title, platform_url, CAST(price AS DOUBLE) AS price, description FROM products WHERE status = 'listed'""")
def catalog(s):
    return as_double(filters.catalog(s.products), "price")


@plan("flt_insight_category", """
    SELECT id, category, title, CAST(score AS DOUBLE) AS score FROM market_insights
    WHERE category IN ('alert', 'recommendation', 'trend')""")
def insight_category(s):
    chosen = filters.insights_in(s.market_insights, "alert", "recommendation", "trend")
    return as_double(chosen.select("id", "category", "title", "score"), "score")


@plan("flt_recent_window", """
    SELECT id, product_id, CAST(net AS DOUBLE) AS net, type, occurred_at FROM transactions
    WHERE occurred_at > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 7 DAY""")
def recent_window(s):
    recent = filters.recent_transactions(s.transactions, AS_OF_TXN)
    return as_double(recent.select("id", "product_id", "net", "type", "occurred_at"), "net")


@plan("flt_paid_substring", "SELECT id, status, amount, created_at FROM marketplace_paid")
def paid_substring(s):
    return filters.paid_orders(payloads.order_rows(s.raw_orders, "id", "status", "amount", "created_at"))


@plan("flt_paid_strict", """
    SELECT id, status, amount, created_at FROM flat_orders WHERE status IN ('OrderStatus.PAID', 'succeeded')""")
def paid_strict(s):
    orders = payloads.order_rows(s.raw_orders, "id", "status", "amount", "created_at")
    return filters.paid_orders(orders, strict=True)


@plan("flt_paid_exact", """
    SELECT id, total, customer_email, created_at FROM flat_store_orders WHERE status = 'paid' AND NOT refunded""")
def paid_exact(s):
    orders = filters.paid_store_orders(payloads.store_orders(s.raw_orders_jsonapi))
    return orders.select("id", "total", "customer_email", "created_at")


@plan("flt_positive_revenue", """
    SELECT id, title, sales, CAST(revenue AS DOUBLE) AS revenue FROM rollup_products WHERE revenue > 0""")
def positive_revenue(s):
    earning = filters.earning(aggregates.product_rollup(s.products, s.transactions))
    return as_double(earning.select("id", "title", "sales", "revenue"), "revenue")


@plan("flt_task_messages", "SELECT id, to_agent, opportunity_id FROM creation_requests")
def task_messages(s):
    return filters.creation_tasks(s.agent_messages).select("id", "to_agent", "opportunity_id")


@plan("flt_lead_valid", """
    SELECT id, niche, email, coalesce(email LIKE '%@%', FALSE) AS has_email FROM leads WHERE niche <> ''""")
def lead_valid(s):
    return filters.valid_leads(s.leads)


@plan("flt_payload_fields", """
    SELECT id, CAST(json_array_length(metadata, '$.keywords') AS INT) AS n_keywords,
           array_to_string(json_extract_string(metadata, '$.keywords[*]'), '|') AS keywords FROM opportunities""")
def payload_fields(s):
    return filters.with_keywords(s.opportunities).select(
        "id", F.size("keywords").alias("n_keywords"), F.array_join("keywords", "|").alias("keywords")
    )
