"""Sources."""

from pyspark.sql import functions as F

from ledgerloom.plans.registry import as_double, plan
from ledgerloom.sources import payloads


@plan("src_tables", """
    SELECT id, product_id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, CAST(net AS DOUBLE) AS net,
           platform, transaction_id, type, description, occurred_at
    FROM transactions""")
def tables(s):
    return as_double(s.transactions, "amount", "fee", "net")


@plan("src_tables_opportunities", """
    SELECT id, type, title, description, CAST(estimated_revenue AS DOUBLE) AS estimated_revenue,
           CAST(effort_hours AS DOUBLE) AS effort_hours, status, platform, created_at, metadata
    FROM opportunities""")
def all_opportunities(s):
    opportunities = s.opportunities.drop("platform_id", "platform_url", "updated_at")
    return as_double(opportunities, "estimated_revenue", "effort_hours")


@plan("src_tables_products", """
    SELECT id, opportunity_id, title, description, CAST(price AS DOUBLE) AS price, platform,
           platform_url, file_path, status, created_at FROM products""")
def products(s):
    return as_double(s.products, "price").drop("platform_id", "views", "sales", "revenue", "updated_at")


@plan("src_tables_messages", "SELECT id, from_agent, to_agent, type, payload, read, created_at FROM agent_messages")
def messages(s):
    return s.agent_messages


@plan("src_tables_insights", """
    SELECT id, category, title, data, CAST(score AS DOUBLE) AS score, source, created_at FROM market_insights""")
def insights(s):
    return as_double(s.market_insights, "score").drop("expires_at")


@plan("src_order_payload", "SELECT * FROM flat_orders")
def order_payload(s):
    return payloads.order_rows(s.raw_orders)


def damaged(payloads):
    """Payloads of which some were cut off, replaced by a message, or lost."""
    p, fault = F.col("payload"), F.length("payload") % 9
    return payloads.withColumn("payload", F.when(fault == 0, F.left(p, F.length(p) - 3)).when(fault == 1, F.lit("<html>502"))
                               .when(fault == 2, F.lit(None)).otherwise(p))


DAMAGED = """WITH damaged AS (
        SELECT * REPLACE (CASE length(payload) % 9 WHEN 0 THEN left(payload, length(payload) - 3) WHEN 1 THEN '<html>502'
                               WHEN 2 THEN NULL ELSE payload END AS payload) FROM {})"""
DAMAGED_ORDERS = DAMAGED.format("raw_orders")


@plan("src_order_payload_damaged", f"""
    {DAMAGED_ORDERS}
    SELECT payload->>'$.id' AS id, payload->>'$.status' AS status, CAST(payload->>'$.amount' AS BIGINT) AS amount
    FROM damaged WHERE json_valid(payload)""")
def order_payload_damaged(s):
    return payloads.order_rows(damaged(s.raw_orders), "id", "status", "amount")


@plan("src_order_payload_rejected", f"""
    {DAMAGED_ORDERS} SELECT payload FROM damaged WHERE payload IS NULL OR NOT json_valid(payload)""")
def order_payload_rejected(s):
    return payloads.rejected(damaged(s.raw_orders), "orders")


@plan("src_jsonapi_damaged", f"""
    {DAMAGED.format("raw_orders_jsonapi")}
    SELECT r->>'$.id' AS id, r->>'$.attributes.status' AS status
    FROM (SELECT unnest(json_extract(payload, '$.data[*]')) AS r FROM damaged WHERE json_valid(payload))""")
def jsonapi_damaged(s):
    return payloads.store_orders(damaged(s.raw_orders_jsonapi)).select("id", "status")


@plan("src_jsonapi_rejected", f"""
    {DAMAGED.format("raw_orders_jsonapi")} SELECT payload FROM damaged WHERE payload IS NULL OR NOT json_valid(payload)""")
def jsonapi_rejected(s):
    return payloads.rejected(damaged(s.raw_orders_jsonapi), "store_orders")


@plan("src_search_results_rejected", f"""
    {DAMAGED.format("search_payload")}
    SELECT query_id, payload FROM damaged WHERE payload IS NULL OR NOT json_valid(payload)""")
def search_results_rejected(s):
    return payloads.rejected(damaged(s.search_payload), "search_results")


@plan("src_jsonapi", "SELECT * FROM flat_store_orders")
def jsonapi(s):
    return payloads.store_orders(s.raw_orders_jsonapi)


@plan("src_jsonapi_stores", """
    SELECT r->>'$.id' AS id, r->>'$.attributes.name' AS name, r->>'$.attributes.slug' AS slug,
           r->>'$.attributes.url' AS url, r->>'$.attributes.currency' AS currency
    FROM (SELECT unnest(json_extract(payload, '$.data[*]')) AS r FROM raw_stores_jsonapi)""")
def jsonapi_stores(s):
    return payloads.stores(s.raw_stores_jsonapi)


@plan("src_jsonapi_products", """
    SELECT r->>'$.id' AS id, r->>'$.attributes.name' AS name, r->>'$.attributes.status' AS status,
           coalesce(r->>'$.attributes.buy_now_url', '') AS buy_now_url
    FROM (SELECT unnest(json_extract(payload, '$.data[*]')) AS r FROM raw_products_jsonapi)""")
def jsonapi_products(s):
    return payloads.store_products(s.raw_products_jsonapi)


@plan("src_marketplace_products", """
    SELECT r->>'$.id' AS id, r->>'$.name' AS name, CAST(r->>'$.is_archived' AS BOOLEAN) AS is_archived
    FROM (SELECT unnest(json_extract(payload, '$.items[*]')) AS r FROM raw_marketplace_products)""")
def marketplace_products(s):
    return payloads.marketplace_products(s.raw_marketplace_products)


@plan("src_search_results", """
    SELECT query_id, pos, title, url, coalesce(snippet, '') AS snippet FROM flat_results""")
def search_results(s):
    return payloads.search_results(s.search_payload)


@plan("src_search_results_nulls", "SELECT query_id, pos, title, url, snippet FROM flat_results WHERE pos < 8")
def search_results_nulls(s):
    return payloads.search_results(s.search_payload, n=8, missing_snippet=None)


@plan("src_posts", "SELECT title, url FROM flat_posts WHERE status = 'published'")
def posts(s):
    return payloads.posts(s.posts_payload, status="published").select("title", "url")


@plan("src_posts_page", """
    SELECT id, title, status, url, published_at FROM flat_posts WHERE status = 'published'
    ORDER BY published_at DESC NULLS LAST, id LIMIT 20""")
def posts_page(s):
    return payloads.posts(s.posts_payload, status="published", limit=20)


@plan("src_posts_total", """
    SELECT batch_id, coalesce(CAST(payload->>'$.meta.pagination.total' AS BIGINT), 0) AS total FROM posts_payload""")
def posts_total(s):
    return payloads.posts_total(s.posts_payload)


@plan("src_feed_titles", "SELECT feed_id, pos, title FROM flat_feed")
def feed_titles(s):
    return payloads.feed_titles(s.feed_xml)


@plan("src_feed_titles_first", "SELECT feed_id, pos, title FROM flat_feed WHERE pos < 9")
def feed_titles_first(s):
    return payloads.feed_titles(s.feed_xml, n=9)
