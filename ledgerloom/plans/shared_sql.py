"""Checking SQL shared by several queries, as views over the domain views."""

VIEWS: dict[str, str] = {
    "flat_orders": """
        SELECT payload->>'$.id' AS id, payload->>'$.status' AS status,
               CAST(payload->>'$.amount' AS BIGINT) AS amount, payload->>'$.currency' AS currency,
               coalesce(payload->>'$.customer.email', '') AS customer_email,
               coalesce(payload->>'$.product.name', '') AS product_name,
               CAST(payload->>'$.created_at' AS TIMESTAMP) AS created_at
        FROM raw_orders""",
    "marketplace_paid": """
        SELECT * FROM flat_orders WHERE lower(status) LIKE '%paid%' OR lower(status) LIKE '%succeeded%'""",
    "first_paid": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, amount, customer_email, status,
                                         currency, product_name) AS rn
            FROM marketplace_paid WHERE id IS NOT NULL) WHERE rn = 1""",
    "paid_ledger": """
        SELECT DISTINCT id AS transaction_id FROM marketplace_paid
        WHERE id IS NOT NULL AND created_at < TIMESTAMP '1998-06-01 00:00:00'""",
    "sale_rows": """
        SELECT amount, fee, CAST(amount - fee AS DECIMAL(18,4)) AS net, id, product_name, created_at
        FROM (SELECT *, CAST(amount * 0.04 + 0.40 AS DECIMAL(18,4)) AS fee
              FROM (SELECT * REPLACE (CAST(CAST(amount AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS amount)
                    FROM first_paid))""",
    "flat_store_orders": """
        SELECT r->>'$.id' AS id, r->>'$.attributes.status' AS status,
               CAST(r->>'$.attributes.total' AS BIGINT) AS total,
               CAST(r->>'$.attributes.subtotal' AS BIGINT) AS subtotal,
               CAST(r->>'$.attributes.tax' AS BIGINT) AS tax, r->>'$.attributes.currency' AS currency,
               coalesce(r->>'$.attributes.user_email', '') AS customer_email,
               coalesce(r->>'$.attributes.first_order_item.product_name', '') AS product_name,
               CAST(r->>'$.attributes.created_at' AS TIMESTAMP) AS created_at,
               coalesce(CAST(r->>'$.attributes.refunded' AS BOOLEAN), FALSE) AS refunded
        FROM (SELECT unnest(json_extract(payload, '$.data[*]')) AS r FROM raw_orders_jsonapi)""",
    "flat_posts": """
        SELECT r->>'$.id' AS id, r->>'$.title' AS title, r->>'$.status' AS status,
               coalesce(r->>'$.url', '') AS url, r->>'$.published_at' AS published_at
        FROM (SELECT unnest(json_extract(payload, '$.posts[*]')) AS r FROM posts_payload)""",
    "flat_results": """
        SELECT query_id, CAST(pos - 1 AS INT) AS pos, r->>'$.title' AS title, r->>'$.url' AS url,
               r->>'$.description' AS snippet
        FROM (SELECT query_id, unnest(json_extract(payload, '$.web.results[*]')) AS r,
                     generate_subscripts(json_extract(payload, '$.web.results[*]'), 1) AS pos
              FROM search_payload)""",
    "flat_feed": """
        SELECT feed_id, CAST(pos - 2 AS INT) AS pos, trim(title) AS title
        FROM (SELECT feed_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos
              FROM (SELECT feed_id, regexp_extract_all(body,
                        '<title><!\\[CDATA\\[([^\\]]+)\\]\\]></title>', 1) AS t FROM feed_xml))
        WHERE pos >= 2""",
    "rollup_products": """
        SELECT p.*, coalesce(t.sales, 0) AS sales, coalesce(t.revenue, 0) AS revenue
        FROM products p
        LEFT JOIN (SELECT product_id, count(*) AS sales, sum(net) AS revenue
                   FROM transactions WHERE type = 'sale' GROUP BY product_id) t ON t.product_id = p.id""",
    "metrics_by_day": """
        SELECT date, coalesce(sum(revenue), 0) AS revenue, coalesce(sum(expenses), 0) AS expenses,
               coalesce(sum(net), 0) AS net, CAST(sum(found) AS BIGINT) AS opportunities_found,
               CAST(sum(created) AS BIGINT) AS products_created, CAST(sum(listed) AS BIGINT) AS products_listed,
               CAST(sum(sale) AS BIGINT) AS sales_count
        FROM (SELECT CAST(occurred_at AS DATE) AS date, CASE WHEN type = 'sale' THEN net END AS revenue,
                     CASE WHEN type = 'expense' THEN abs(net) END AS expenses, net, 0 AS found, 0 AS created,
                     0 AS listed, CASE WHEN type = 'sale' THEN 1 ELSE 0 END AS sale FROM transactions
              UNION ALL
              SELECT CAST(created_at AS DATE), NULL, NULL, NULL, 1, 0, 0, 0 FROM opportunities
              UNION ALL
              SELECT CAST(created_at AS DATE), NULL, NULL, NULL, 0, 1,
                     CASE WHEN status = 'listed' THEN 1 ELSE 0 END, 0 FROM products) GROUP BY date""",
    "state_by_agent": """
        SELECT s.agent_id, s.last_run, s.run_count, r.status, r.current_task, r.metadata, s.runs_started
        FROM (SELECT agent_id, max(run_at) AS last_run, count(*) AS run_count,
                     count(*) FILTER (status = 'running') AS runs_started
              FROM agent_runs GROUP BY agent_id) s
        JOIN (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY run_at DESC, seq DESC) AS rn
              FROM agent_runs) r ON r.agent_id = s.agent_id AND r.rn = 1""",
    "last_requests": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY request_id DESC) AS rn
            FROM publish_requests) WHERE rn = 1""",
    "fresh_titles": """
        SELECT id, title, type, description, CAST(estimated_revenue AS DOUBLE) AS est, metadata,
               CASE WHEN id % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty,
               CASE WHEN id % 3 = 0 THEN 'makers' ELSE '' END AS audience
        FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM opportunities
              WHERE status = 'pending')
        WHERE rn = 1 AND title NOT IN (SELECT title FROM opportunities WHERE status <> 'pending')""",
    "unnumbered_titles": """
        SELECT title, type, description, CAST(estimated_revenue AS DOUBLE) AS est, metadata
        FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY type, description, estimated_revenue, metadata) AS rn
              FROM opportunities WHERE status = 'pending')
        WHERE rn = 1 AND title NOT IN (SELECT title FROM opportunities WHERE status <> 'pending')""",
    "unread_for_content": """
        SELECT * FROM agent_messages WHERE (to_agent = 'content' OR to_agent IS NULL) AND read = 0""",
    "creation_requests": """
        SELECT id, to_agent, read, CAST(payload->>'$.opportunityId' AS BIGINT) AS opportunity_id
        FROM agent_messages
        WHERE type = 'task' AND (payload->>'$.task') = 'create_product'
          AND CAST(payload->>'$.opportunityId' AS BIGINT) <> 0""",
    "ledger_totals": """
        SELECT coalesce(sum(net) FILTER (type = 'sale'), 0) AS revenue,
               coalesce(sum(abs(net)) FILTER (type = 'expense'), 0) AS expenses,
               coalesce(sum(net), 0) AS net, count(*) FILTER (type = 'sale') AS sales
        FROM transactions""",
}
