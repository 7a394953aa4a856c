"""Streaming jobs, checked against the batch result on the same rows."""

from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.plans.registry import as_double, id_sql, plan
from ledgerloom.plans.sources import DAMAGED_ORDERS, damaged
from ledgerloom.sources.tables import scan_stream
from ledgerloom.streaming import jobs


@plan("st_mailbox", "SELECT id, from_agent, type, payload, created_at FROM unread_for_content")
def mailbox(s):
    return jobs.mailbox(s.stream("agent_messages"), "content", workspace.new_folder(s.spark, "mailbox"))


@plan("st_order_sync", f"""
    SELECT {id_sql("id")} AS id, id AS transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee,
           CAST(net AS DOUBLE) AS net, 'polar' AS platform, 'sale' AS type, product_name AS description,
           created_at AS occurred_at
    FROM sale_rows""")
def order_sync(s):
    added = jobs.order_sync(s.stream("raw_orders"), workspace.new_folder(s.spark, "orders"))
    return as_double(added.drop("product_id"), "amount", "fee", "net")


@plan("st_agent_state", "SELECT * FROM state_by_agent")
def agent_state(s):
    return jobs.agent_state(s.stream("agent_runs"), workspace.new_folder(s.spark, "state"))


@plan("st_mailbox_all", """
    SELECT m.id, m.from_agent, m.type, m.payload, m.created_at, a.agent AS recipient
    FROM agent_messages m JOIN (SELECT DISTINCT agent_id AS agent FROM agent_runs) a
      ON m.to_agent = a.agent OR m.to_agent IS NULL
    WHERE m.read = 0""")
def mailboxes(s):
    recipients = s.agent_runs.select(F.col("agent_id").alias("agent"))
    return jobs.mailboxes(s.stream("agent_messages"), recipients, workspace.new_folder(s.spark, "mailboxes"))


@plan("st_order_rejected", f"""
    {DAMAGED_ORDERS} SELECT payload FROM damaged WHERE payload IS NULL OR NOT json_valid(payload)""")
def order_rejected(s):
    return jobs.rejected_payloads(damaged(s.stream("raw_orders")), "orders", workspace.new_folder(s.spark, "rejected"))


@plan("st_daily_metrics", """
    SELECT date, CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net,
           opportunities_found, products_created, products_listed, sales_count FROM metrics_by_day""")
def daily_metrics(s):
    streams = [s.stream(view) for view in ("transactions", "opportunities", "products")]
    return as_double(jobs.daily_metrics(*streams, workspace.new_folder(s.spark, "metrics")), "revenue", "expenses", "net")


@plan("st_daily_sales", """
    SELECT CAST(ts AS DATE) AS date, count(*) AS sales_count,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def daily_sales(s):
    events = scan_stream(s.spark, s.root, "events").where(F.col("event_type") == "purchase")
    purchases = events.select(
        F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("decimal(18,2)").alias("value")
    )
    return jobs.daily_sales(purchases, workspace.new_folder(s.spark, "daily"))


@plan("st_lead_capture", "SELECT DISTINCT email FROM leads WHERE email LIKE '%@%'")
def lead_capture(s):
    return jobs.lead_capture(s.stream("leads"), workspace.new_folder(s.spark, "leads"))


@plan("st_lead_capture_expiring", "SELECT DISTINCT concat('user', CAST(user_id AS STRING), '@example.com') AS email FROM events")
def lead_capture_expiring(s):
    email = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    leads = scan_stream(s.spark, s.root, "events").select(F.col("ts").cast("timestamp").alias("at"), email.alias("email"))
    return jobs.lead_capture(leads, workspace.new_folder(s.spark, "leads"), "at", "10000 days")


@plan("st_drain_order", """
    SELECT id, to_agent, from_agent, type, created_at,
           row_number() OVER (PARTITION BY to_agent ORDER BY created_at, id) AS position
    FROM agent_messages WHERE read = 0""")
def drain_order(s):
    return jobs.drain_order(s.stream("agent_messages"), workspace.new_folder(s.spark, "drain"))
