"""Table changes."""

from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.operators import filters, mutations, windows
from ledgerloom.plans.ledger import stored_ledger
from ledgerloom.plans.registry import AS_OF_EVENT, AS_OF_TXN, as_double, id_sql, plan
from ledgerloom.schemas import with_defaults
from ledgerloom.sinks import tables
from ledgerloom.sources import payloads


@plan("mut_mailbox_drain", """
    SELECT id, from_agent, to_agent, type, payload, created_at, delivered_to,
           CAST(CASE WHEN delivered_to IS NULL THEN read ELSE 1 END AS INT) AS read
    FROM (SELECT *, CASE WHEN read = 0 AND to_agent IN ('content', 'sales') THEN to_agent
                         WHEN read = 0 AND to_agent IS NULL THEN 'content' END AS delivered_to FROM agent_messages)""")
def mailbox_drain(s):
    return mutations.drain_mailbox(s.agent_messages, ["content", "sales"])


def _drafts(s):
    return s.products.where(F.col("status") == "draft")


def _publishing(s):
    """The requests to publish that concern drafts."""
    ids = _drafts(s).select(F.col("id").alias("product_id"))
    return s.publish_requests.join(ids, "product_id", "left_semi")


@plan("mut_product_created", """
    SELECT id, title, CASE WHEN hit THEN 'in_progress' ELSE status END AS status,
           CASE WHEN hit THEN TIMESTAMP '2024-01-31 00:00:00' ELSE created_at END AS updated_at
    FROM (SELECT *, id IN (SELECT opportunity_id FROM products
                           WHERE status = 'draft' AND opportunity_id IS NOT NULL) AS hit FROM opportunities)""")
def product_created(s):
    state = mutations.products_created(s.opportunities, _drafts(s), AS_OF_EVENT)
    return state.select("id", "title", "status", "updated_at")


@plan("mut_product_listed", """
    SELECT p.id, CASE WHEN hit THEN r.title ELSE p.title END AS title,
           CASE WHEN hit THEN r.description ELSE p.description END AS description,
           CAST(CASE WHEN hit THEN r.price_cents * 0.01 ELSE p.price END AS DOUBLE) AS price,
           CASE WHEN hit THEN r.platform_id END AS platform_id,
           CASE WHEN hit THEN r.platform_url ELSE p.platform_url END AS platform_url,
           CASE WHEN hit THEN 'listed' ELSE p.status END AS status,
           CASE WHEN hit THEN TIMESTAMP '2024-01-31 00:00:00' ELSE p.created_at END AS updated_at
    FROM (SELECT *, status = 'draft' AS hit FROM products) p LEFT JOIN last_requests r ON r.product_id = p.id""")
def product_listed(s):
    state = mutations.products_listed(s.products, _publishing(s), AS_OF_EVENT)
    return as_double(
        state.select("id", "title", "description", "price", "platform_id", "platform_url", "status", "updated_at"),
        "price",
    )


@plan("mut_product_listed_in_parts", """
    SELECT p.id, CASE WHEN hit THEN r.title ELSE p.title END AS title,
           CAST(CASE WHEN hit THEN r.price_cents * 0.01 ELSE p.price END AS DOUBLE) AS price,
           CASE WHEN hit THEN 'listed' ELSE p.status END AS status
    FROM (SELECT *, status = 'draft' AS hit FROM products) p LEFT JOIN last_requests r ON r.product_id = p.id""")
def product_listed_in_parts(s):
    root, published = workspace.new_folder(s.spark, "parts"), _publishing(s)
    tables.write_parts(s.products, root, "products", 8)
    tables.change_parts(
        s.spark, root, "products", published.select(F.col("product_id").alias("id")),
        lambda rows: mutations.products_listed(rows, published, AS_OF_EVENT), 8)
    return as_double(tables.load_parts(s.spark, root, "products").select("id", "title", "price", "status"), "price")


@plan("mut_product_listed_parents", """
    SELECT id, title, CASE WHEN hit THEN 'listed' ELSE status END AS status,
           CASE WHEN hit THEN TIMESTAMP '2024-01-31 00:00:00' ELSE created_at END AS updated_at
    FROM (SELECT *, id IN (SELECT opportunity_id FROM products
                           WHERE status = 'draft' AND opportunity_id IS NOT NULL) AS hit FROM opportunities)""")
def product_listed_parents(s):
    state = mutations.parents_listed(s.opportunities, s.products, _publishing(s), AS_OF_EVENT)
    return state.select("id", "title", "status", "updated_at")


@plan("mut_updated_at", """
    SELECT id, status, CASE WHEN status = 'unlisted' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE created_at END
               AS updated_at FROM products""")
def updated_at(s):
    changed = F.col("status") == "unlisted"
    return s.products.select("id", "status", mutations.touch(changed, AS_OF_EVENT).alias("updated_at"))


SYNCED = f"""
    SELECT {id_sql("id")} AS id, id AS transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee,
           CAST(net AS DOUBLE) AS net, 'polar' AS platform, 'sale' AS type, product_name AS description, created_at AS occurred_at
    FROM sale_rows WHERE id NOT IN (SELECT transaction_id FROM paid_ledger)"""


@plan("mut_ledger_sync", SYNCED)
def ledger_sync(s):
    orders = payloads.order_rows(s.raw_orders)
    ledger = stored_ledger(s, filters.paid_orders(s.known_orders))
    added = mutations.ledger_sync(orders, ledger).drop("product_id")
    return as_double(added, "amount", "fee", "net")


@plan("mut_ledger_sync_batch", SYNCED)
def ledger_sync_batch(s):
    orders = payloads.order_rows(s.raw_orders)
    ledger = stored_ledger(s, filters.paid_orders(s.known_orders))
    added = mutations.ledger_sync_batch(orders, ledger, workspace.new_folder(s.spark, "batch"))
    return as_double(added.drop("product_id"), "amount", "fee", "net")


@plan("mut_ledger_rejected", "SELECT * FROM flat_orders WHERE id IS NULL")
def ledger_rejected(s):
    return windows.rejected_orders(payloads.order_rows(s.raw_orders))


@plan("mut_log_transaction", """
    SELECT id, product_id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee,
           CAST(CASE WHEN type = 'expense' THEN -abs(amount) ELSE amount - fee END AS DOUBLE) AS net, platform, type,
           description, TIMESTAMP '2001-08-01 00:00:00' AS occurred_at
    FROM transactions""")
def log_transaction(s):
    entries = s.transactions.select("id", "product_id", "amount", "fee", "type", "description", "platform")
    rows = with_defaults(mutations.logged_rows(entries), "transactions", AS_OF_TXN)
    return as_double(rows.drop("transaction_id"), "amount", "fee", "net")


@plan("mut_log_expense", """
    SELECT CAST(p_retailprice AS DOUBLE) AS amount, 0.0::DOUBLE AS fee, -CAST(p_retailprice AS DOUBLE) AS net,
           CASE WHEN p_size > 25 THEN p_type ELSE 'general' END AS platform, 'expense' AS type, p_name AS description
    FROM part""")
def log_expense(s):
    expenses = s.part.select(
        F.col("p_retailprice").cast("decimal(18,2)").alias("amount"),
        F.col("p_name").alias("description"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"),
    )
    rows = mutations.expense_rows(expenses)
    return as_double(rows.select("amount", "fee", "net", "platform", "type", "description"), "amount", "fee", "net")


def _found(s):
    """The pending opportunities as if just found, and the others as those known."""
    pending = F.col("status") == "pending"
    found = filters.with_keywords(s.opportunities).where(pending).select(
        "id", "type", "title", "description", "estimated_revenue", "keywords",
        F.when(F.col("id") % 2 == 0, "easy").alias("difficulty"), F.when(F.col("id") % 3 == 0, "makers").alias("target_audience"),
    )
    return found, s.opportunities.where(~pending)


INGEST_TIME = f"TIMESTAMP '{AS_OF_EVENT}'"


@plan("mut_opportunity_ingest", f"""
    SELECT id, type, title, description, est AS estimated_revenue, 'pending' AS status, {INGEST_TIME} AS created_at,
           CAST(to_json({{'keywords': json_extract(metadata, '$.keywords'), 'difficulty': difficulty,
                         'target_audience': audience}}) AS STRING) AS metadata
    FROM fresh_titles""")
def opportunity_ingest(s):
    rows = with_defaults(mutations.ingested(*_found(s))["opportunities"], "opportunities", AS_OF_EVENT)
    return as_double(rows.select("id", "type", "title", "description", "estimated_revenue", "status", "created_at", "metadata"),
                     "estimated_revenue")


@plan("mut_opportunity_ingest_messages", f"""
    SELECT {id_sql("'scanner'", "'content'", "'task'", "payload", f"'{AS_OF_EVENT}'")} AS id, 'scanner' AS from_agent, 'content' AS to_agent, 'task' AS type, payload, CAST(0 AS INT) AS read,
           {INGEST_TIME} AS created_at
    FROM (SELECT CAST(to_json({{'task': 'create_product', 'opportunityId': id, 'title': title, 'type': type}}) AS STRING)
                 AS payload FROM fresh_titles)""")
def opportunity_ingest_messages(s):
    return with_defaults(mutations.ingested(*_found(s))["agent_messages"], "agent_messages", AS_OF_EVENT)


@plan("mut_opportunity_ingest_insights", f"""
    SELECT {id_sql("'opportunity'", "title", "'scanner'", f"'{AS_OF_EVENT}'")} AS id,
           'opportunity' AS category, title, CAST(to_json({{'type': type, 'audience': audience}}) AS STRING) AS data,
           CAST(CAST(est / 1000 AS DECIMAL(18,2)) AS DOUBLE) AS score, 'scanner' AS source, {INGEST_TIME} AS created_at
    FROM fresh_titles""")
def opportunity_ingest_insights(s):
    rows = with_defaults(mutations.ingested(*_found(s))["market_insights"], "market_insights", AS_OF_EVENT)
    return as_double(rows.drop("expires_at"), "score")


@plan("mut_opportunity_ingest_records", """
    SELECT id, title, type, 'opportunity' AS kind, NULL AS source, est AS value,
           CAST(to_json({'keywords': json_extract(metadata, '$.keywords'), 'difficulty': difficulty,
                         'target_audience': audience}) AS STRING) AS body FROM fresh_titles
    UNION ALL
    SELECT id, title, type, 'message', 'scanner', NULL,
           CAST(to_json({'task': 'create_product', 'opportunityId': id, 'title': title, 'type': type}) AS STRING)
    FROM fresh_titles
    UNION ALL
    SELECT id, title, type, 'insight', 'scanner', est / 1000,
           CAST(to_json({'type': type, 'audience': audience}) AS STRING)
    FROM fresh_titles""")
def opportunity_ingest_records(s):
    return mutations.ingest_opportunities(*_found(s))


def _unnumbered(s):
    """The pending opportunities as a scanner finds them, without ids, and the others as those known."""
    found, known = _found(s)
    nothing = F.lit(None).cast("string")
    return found.withColumns({"id": F.lit(None).cast("bigint"), "difficulty": nothing, "target_audience": nothing}), known


@plan("mut_opportunity_ingest_unnumbered", f"""
    SELECT {id_sql("title")} AS id, type, title, description, est AS estimated_revenue,
           CAST(to_json({{'keywords': json_extract(metadata, '$.keywords'), 'difficulty': 'medium',
                         'target_audience': ''}}) AS STRING) AS metadata
    FROM unnumbered_titles""")
def opportunity_ingest_unnumbered(s):
    rows = mutations.ingested(*_unnumbered(s))["opportunities"]
    return as_double(rows, "estimated_revenue")


@plan("mut_opportunity_ingest_unnumbered_messages", f"""
    SELECT 'scanner' AS from_agent, 'content' AS to_agent, 'task' AS type,
           CAST(to_json({{'task': 'create_product', 'opportunityId': {id_sql("title")}, 'title': title, 'type': type}})
                AS STRING) AS payload
    FROM unnumbered_titles""")
def opportunity_ingest_unnumbered_messages(s):
    return mutations.ingested(*_unnumbered(s))["agent_messages"]


@plan("mut_event_messages", """
    SELECT 'sales' AS from_agent, 'finance' AS to_agent, 'event' AS type,
           CAST(to_json({'event': 'product_listed', 'productId': id, 'url': platform_url,
                    'price': CAST(price AS DOUBLE),
                    'platform': platform}) AS STRING) AS payload FROM products WHERE status = 'listed'
    UNION ALL
    SELECT 'content', 'sales', 'task',
           CAST(to_json({'task': 'list_product', 'productId': id, 'title': title, 'description': description,
                    'price': CAST(price * 100 AS BIGINT), 'filePath': file_path}) AS STRING)
    FROM products WHERE status = 'draft'
    UNION ALL
    SELECT 'blog', NULL, 'published', CAST(to_json({'title': title, 'url': url, 'tags': ['guide']}) AS STRING)
    FROM flat_posts WHERE status = 'published'
    UNION ALL
    SELECT 'analytics', 'orchestrator', 'recommendation',
           CAST(to_json({'action': title, 'reason': data, 'priority': 'medium'}) AS STRING)
    FROM market_insights WHERE category = 'recommendation'""")
def event_messages(s):
    posts = payloads.posts(s.posts_payload).withColumn("tags", F.array(F.lit("guide")))
    recommendations = filters.insights_in(s.market_insights, "recommendation").select(
        F.col("title").alias("action"), F.col("data").alias("reason"), F.lit("medium").alias("priority")
    )
    return mutations.event_messages(s.products, posts, recommendations)
