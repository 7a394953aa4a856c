"""Joins, first-wins windows and set operations.

Fixed values: the result names ``opp_type`` and ``opp_desc``.
"""

from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.operators import aggregates, joins, sets, windows
from ledgerloom.plans.ledger import stored_ledger
from ledgerloom.plans.registry import as_double, plan
from ledgerloom.sources import payloads


@plan("join_product_opportunity", """
    SELECT p.id, p.opportunity_id, p.title, CAST(p.price AS DOUBLE) AS price, p.sales,
           CAST(p.revenue AS DOUBLE) AS revenue, p.status, p.platform, p.created_at, o.type AS opp_type,
           CAST(o.effort_hours AS DOUBLE) AS effort_hours
    FROM rollup_products p LEFT JOIN opportunities o ON p.opportunity_id = o.id""")
def product_opportunity(s):
    rollup = aggregates.product_rollup(s.products, s.transactions)
    return as_double(joins.product_opportunity(rollup, s.opportunities), "price", "revenue", "effort_hours")


@plan("join_draft_queue", """
    SELECT p.id, p.title, p.description, CAST(p.price AS DOUBLE) AS price, p.file_path, o.type AS opp_type,
           o.description AS opp_desc, p.created_at
    FROM products p JOIN opportunities o ON p.opportunity_id = o.id
    WHERE p.status = 'draft' ORDER BY p.created_at, p.id LIMIT 10""")
def draft_queue(s):
    return as_double(joins.draft_queue(s.products, s.opportunities), "price")


@plan("join_opportunity_lookup", """
    SELECT m.id AS message_id, m.opportunity_id, o.title, o.type AS opp_type,
           CAST(o.estimated_revenue AS DOUBLE) AS estimated_revenue
    FROM creation_requests m JOIN opportunities o ON o.id = m.opportunity_id WHERE o.status = 'pending'""")
def opportunity_lookup(s):
    found = joins.requested_opportunities(s.agent_messages, s.opportunities)
    return as_double(found, "estimated_revenue")


@plan("join_semi_listed", """
    SELECT id, type, title, status FROM opportunities
    WHERE id IN (SELECT opportunity_id FROM products WHERE status = 'listed')""")
def semi_listed(s):
    return joins.listed_parents(s.opportunities, s.products).select("id", "type", "title", "status")


@plan("join_anti_new_orders", """
    SELECT * FROM flat_orders
    WHERE id NOT IN (SELECT id FROM flat_orders
                     WHERE id IS NOT NULL AND created_at < TIMESTAMP '1998-06-01 00:00:00')""")
def anti_new_orders(s):
    return joins.not_in_buckets(payloads.order_rows(s.raw_orders), stored_ledger(s, s.known_orders))


@plan("join_anti_new_titles", """
    SELECT min(id) AS id, title FROM opportunities
    WHERE status = 'pending' AND title NOT IN (SELECT title FROM opportunities WHERE status <> 'pending')
    GROUP BY title""")
def anti_new_titles(s):
    pending = F.col("status") == "pending"
    found = s.opportunities.where(pending).select("id", "title")
    return joins.new_titles(found, s.opportunities.where(~pending))


@plan("join_file_fallback", """
    SELECT r.product_id, coalesce(nullif(r.file_path, ''), p.file_path) AS file_path
    FROM publish_requests r LEFT JOIN products p ON p.id = r.product_id""")
def file_fallback(s):
    return joins.with_file(s.publish_requests.select("product_id", "file_path"), s.products)


@plan("win_keep_first_order", """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, amount, customer_email, status,
                                     currency, product_name) AS rn FROM flat_orders WHERE id IS NOT NULL)
    WHERE rn = 1""")
def keep_first_order(s):
    return windows.first_orders(payloads.order_rows(s.raw_orders))


@plan("win_drain_order", """
    SELECT id, to_agent, from_agent, type, created_at,
           row_number() OVER (PARTITION BY to_agent ORDER BY created_at, id) AS position
    FROM agent_messages WHERE read = 0""")
def drain_order(s):
    return windows.drain_positions(s.agent_messages, workspace.new_folder(s.spark, "drain"))


@plan("set_topics_union", """
    SELECT topic, CAST(min(source) AS INT) AS source
    FROM (SELECT title AS topic, 0 AS source FROM flat_results WHERE title <> ''
          UNION ALL SELECT title, 1 FROM flat_feed) GROUP BY topic""")
def topics_union(s):
    searched = payloads.search_results(s.search_payload)
    return sets.topics(searched, payloads.feed_titles(s.feed_xml))


@plan("set_topics_no_feed", """
    SELECT title AS topic, CAST(0 AS INT) AS source FROM flat_results WHERE title <> '' GROUP BY title""")
def topics_no_feed(s):
    return sets.topics(payloads.search_results(s.search_payload), None)


@plan("work_select", """
    SELECT id, title, type, CAST(estimated_revenue AS DOUBLE) AS estimated_revenue, 'message' AS origin
    FROM opportunities
    WHERE status = 'pending' AND id IN (SELECT opportunity_id FROM creation_requests
                                        WHERE (to_agent = 'content' OR to_agent IS NULL) AND read = 0)""")
def work_select(s):
    return as_double(sets.work_list(s.agent_messages, s.opportunities, "content"), "estimated_revenue")


@plan("work_select_fallback", """
    SELECT id, title, type, CAST(estimated_revenue AS DOUBLE) AS estimated_revenue, 'fallback' AS origin
    FROM opportunities WHERE status = 'pending' ORDER BY estimated_revenue DESC NULLS LAST, id LIMIT 3""")
def work_select_fallback(s):
    addressed = s.agent_messages.where(F.col("to_agent").isNotNull())
    return as_double(sets.work_list(addressed, s.opportunities, "designer"), "estimated_revenue")
