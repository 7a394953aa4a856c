"""Aggregates."""

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as agg, filters, mutations
from ledgerloom.plans.ledger import stored_ledger
from ledgerloom.plans.registry import AS_OF_EVENT, as_double, by_status_text, plan
from ledgerloom.sources import payloads


@plan("agg_totals", """
    SELECT CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net, sales
    FROM ledger_totals""")
def totals(s):
    return as_double(agg.totals(s.transactions), "revenue", "expenses", "net")


@plan("agg_sales_total", """
    SELECT CAST(coalesce(sum(net), 0) AS DOUBLE) AS revenue, count(*) AS sales,
           CASE WHEN count(*) > 0 THEN CAST(sum(net) AS DOUBLE) / count(*) ELSE 0 END AS avg_order
    FROM transactions WHERE type = 'sale'""")
def sales_total(s):
    return as_double(agg.sales_total(s.transactions), "revenue")


@plan("agg_opp_by_type", """
    SELECT type, count(*) AS n, CAST(sum(estimated_revenue) AS DOUBLE) / count(estimated_revenue) AS avg_est
    FROM opportunities GROUP BY type""")
def opp_by_type(s):
    return agg.opportunities_by(s.opportunities, "type")


@plan("agg_opp_by_type_status", """
    SELECT type, status, count(*) AS n, CAST(sum(estimated_revenue) AS DOUBLE) / count(estimated_revenue) AS avg_est
    FROM opportunities GROUP BY type, status""")
def opp_by_type_status(s):
    return agg.opportunities_by(s.opportunities, "type", "status")


@plan("agg_product_status", "SELECT status, count(*) AS n FROM products GROUP BY status")
def product_status(s):
    return agg.products_by_status(s.products)


@plan("agg_product_gmv", """
    SELECT status, count(*) AS n, CAST(sum(price) AS DOUBLE) AS gmv FROM products GROUP BY status""")
def product_gmv(s):
    return as_double(agg.product_gmv(s.products), "gmv")


@plan("agg_status_pivot", """
    SELECT count(*) FILTER (status = 'listed') AS total_listed, count(*) FILTER (status = 'draft') AS total_draft,
           CAST(coalesce(sum(price) FILTER (status = 'listed'), 0) AS DOUBLE) AS potential_gmv FROM products""")
def status_pivot(s):
    return as_double(agg.catalog_counts(s.products), "potential_gmv")


@plan("agg_opp_status_counts", """
    SELECT count(*) FILTER (status IN ('pending', 'in_progress')) AS open,
           count(*) FILTER (status = 'listed') AS completed FROM opportunities""")
def opp_status_counts(s):
    return agg.opportunity_counts(s.opportunities)


@plan("agg_pipeline", """
    SELECT CAST(sum(n) FILTER (status IN ('pending', 'in_progress')) AS BIGINT) AS open,
           CAST(sum(n) FILTER (status = 'listed') AS BIGINT) AS completed,
           string_agg(concat(status, ':', n), '|' ORDER BY status) AS by_status
    FROM (SELECT status, count(*) AS n FROM opportunities GROUP BY status)""")
def pipeline(s):
    counts = agg.opportunity_pipeline(s.opportunities)
    return counts.withColumn("by_status", by_status_text(F.col("by_status")))


@plan("agg_ledger_summary", """
    SELECT CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net, sales,
           (SELECT count(*) FROM products WHERE status = 'listed') AS listed
    FROM ledger_totals""")
def ledger_summary(s):
    return as_double(agg.ledger_summary(s.transactions, s.products), "revenue", "expenses", "net")


@plan("agg_first_created", """
    SELECT min(created_at) AS first_created,
           coalesce(CAST(date_sub('second', min(created_at), TIMESTAMP '2024-01-31 00:00:00') // 86400 + 1 AS BIGINT), 1)
               AS days_running FROM products""")
def first_created(s):
    return agg.days_running(s.products, AS_OF_EVENT)


@plan("agg_marketplace_summary", """
    SELECT count(*) AS total_orders, CAST(coalesce(sum(amount), 0) AS DOUBLE) / 100 AS gross_revenue_usd,
           greatest(0, CAST(coalesce(sum(amount - (amount * 4) // 100 - 40), 0) AS DOUBLE) / 100) AS net_revenue_usd
    FROM marketplace_paid""")
def marketplace_summary(s):
    return agg.marketplace_summary(filters.paid_orders(payloads.order_rows(s.raw_orders, "status", "amount")))


@plan("agg_store_summary", """
    SELECT count(*) AS total_orders, CAST(coalesce(sum(total), 0) AS DOUBLE) / 100 AS gross_revenue_usd,
           CAST(coalesce(sum(total), 0) * 95 AS DOUBLE) / 10000 AS net_revenue_usd
    FROM flat_store_orders WHERE status = 'paid' AND NOT refunded""")
def store_summary(s):
    return agg.store_summary(filters.paid_store_orders(payloads.store_orders(s.raw_orders_jsonapi)))


@plan("agg_sync_summary", """
    SELECT count(*) AS fetched,
           (SELECT count(*) FROM first_paid WHERE id NOT IN (SELECT transaction_id FROM paid_ledger)) AS inserted,
           count(*) FILTER (id IS NULL) AS rejected,
           CAST(sum(amount) AS DOUBLE) / 100 AS gross,
           greatest(0, CAST(sum(amount - (amount * 4) // 100 - 40) AS DOUBLE) / 100) AS net
    FROM marketplace_paid""")
def sync_summary(s):
    ledger = stored_ledger(s, filters.paid_orders(s.known_orders))
    return mutations.sync_summary(payloads.order_rows(s.raw_orders, "id", "status", "amount"), ledger)


@plan("agg_agent_state", "SELECT * FROM state_by_agent")
def agent_state(s):
    return agg.agent_state(s.agent_runs)


@plan("agg_product_rollup", """
    SELECT id, title, platform, sales, CAST(revenue AS DOUBLE) AS revenue FROM rollup_products""")
def product_rollup(s):
    rollup = agg.product_rollup(s.products, s.transactions)
    return as_double(rollup.select("id", "title", "platform", "sales", "revenue"), "revenue")


@plan("agg_daily_metrics", """
    SELECT date, CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net,
           opportunities_found, products_created, products_listed, sales_count FROM metrics_by_day""")
def daily_metrics(s):
    daily = agg.daily_metrics(s.transactions, s.opportunities, s.products)
    return as_double(daily, "revenue", "expenses", "net")
