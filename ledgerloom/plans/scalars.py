"""Scalar functions as column projections."""

from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import aggregates, filters, mutations, reports
from ledgerloom.plans.registry import AS_OF_EVENT, AS_OF_TXN, GOAL, HORIZON, START, as_double, plan
from ledgerloom.schemas import moment
from ledgerloom.sources import payloads

OFFER_URL = "https://example.com/prompt-pack"


@plan("sc_fee_decimal", """
    SELECT id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, CAST(amount - fee AS DOUBLE) AS net
    FROM (SELECT id, amount, CAST(amount * 0.04 + 0.40 AS DECIMAL(18,4)) AS fee
          FROM (SELECT id, CAST(CAST(amount AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS amount FROM flat_orders))""")
def fee_decimal(s):
    amount = money.cents_to_amount(F.col("amount"))
    fee = money.order_fee(amount)
    orders = payloads.order_rows(s.raw_orders, "id", "amount")
    return as_double(
        orders.select("id", amount.alias("amount"), fee.alias("fee"), (amount - fee).alias("net")),
        "amount", "fee", "net",
    )


@plan("sc_fee_cents", "SELECT id, amount, amount - (amount * 4) // 100 - 40 AS net_cents FROM flat_orders")
def fee_cents(s):
    return payloads.order_rows(s.raw_orders, "id", "amount").select(
        "id", "amount", money.net_cents(F.col("amount")).alias("net_cents")
    )


@plan("sc_net_amount", """
    SELECT id, type, CAST(CASE WHEN type = 'expense' THEN -abs(amount) ELSE amount - fee END AS DOUBLE) AS net
    FROM transactions""")
def net_amount(s):
    net = money.net_amount(F.col("type"), F.col("amount"), F.col("fee"))
    return s.transactions.select("id", "type", money.usd(net).alias("net"))


@plan("sc_price_units", """
    SELECT id, CAST(price * 100 AS BIGINT) AS price_cents,
           CAST(CAST(CAST(price * 100 AS BIGINT) AS DECIMAL(18,0)) * 0.01 AS DOUBLE) AS price FROM products""")
def price_units(s):
    cents = money.amount_to_cents(F.col("price"))
    return s.products.select(
        "id", cents.alias("price_cents"), money.usd(money.cents_to_amount(cents)).alias("price")
    )


@plan("sc_insight_score", """
    SELECT id, coalesce(CAST(estimated_revenue AS DOUBLE), 500) / 1000 AS score FROM opportunities""")
def insight_score(s):
    return s.opportunities.select("id", mutations.insight_score(F.col("estimated_revenue")).alias("score"))


@plan("sc_goal_pace_finance", """
    SELECT e AS days_elapsed, greatest(0, 60 - e) AS days_remaining, net AS earned, 2000000000.0 - net AS remaining,
           CASE WHEN 60 - e > 0 THEN (2000000000.0 - net) / (60 - e) ELSE 0.0 END AS required_daily_rate,
           net / greatest(1, e) >= CAST(2000000000 AS DOUBLE) / 60 AS on_track
    FROM (SELECT CAST(net AS DOUBLE) AS net,
                 CAST(date_sub('second', TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-08-01 00:00:00') // 86400
                      AS BIGINT) AS e FROM ledger_totals)""")
def goal_pace_finance(s):
    return reports.finance_pace(s.transactions, START, AS_OF_TXN, GOAL, HORIZON)


@plan("sc_goal_pace_analytics", """
    SELECT e AS days_elapsed, greatest(0, 60 - e) AS days_remaining, net AS earned_net,
           2000000000.0 - net AS remaining,
           CASE WHEN 60 - e > 0 THEN (2000000000.0 - net) / (60 - e) ELSE 0.0 END AS required_daily_rate,
           net / e AS actual_daily_rate, net / e >= CAST(2000000000 AS DOUBLE) / 60 AS on_track,
           net / CAST(2000000000 AS DOUBLE) * 100 AS pct_complete
    FROM (SELECT CAST(net AS DOUBLE) AS net, greatest(1, CAST(
              date_sub('second', TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-08-01 00:00:00') // 86400
              AS BIGINT)) AS e FROM ledger_totals)""")
def goal_pace_analytics(s):
    return reports.analytics_pace(s.transactions, START, AS_OF_TXN, GOAL, HORIZON)


@plan("sc_run_rate", """
    SELECT revenue, days_running, revenue / days_running * 30 AS run_rate,
           least(100.0, round(revenue / CAST(2000000000 AS DOUBLE) * 100, 1)) AS pct
    FROM (SELECT CAST(sum(net) AS DOUBLE) AS revenue,
                 (SELECT CAST(date_sub('second', min(created_at), TIMESTAMP '2024-01-31 00:00:00') // 86400 + 1
                              AS BIGINT) FROM products) AS days_running
          FROM transactions WHERE type = 'sale')""")
def run_rate(s):
    return reports.run_rate(s.transactions, s.products, GOAL, AS_OF_EVENT)


@plan("sc_status_line", """
    SELECT concat('[STATUS] Revenue: $', CAST(round(net, 2) AS STRING), ' / $2000000000 (',
                  CAST(CAST(round(CAST(net AS DOUBLE) / 2000000000 * 100, 1) AS DECIMAL(38,1)) AS STRING), '%) | Products: ',
                  CAST((SELECT count(*) FROM products WHERE status = 'listed') AS STRING),
                  ' | Sales: ', CAST(sales AS STRING)) AS line
    FROM ledger_totals""")
def status_line(s):
    return reports.status_line(s.transactions, s.products, GOAL)


@plan("sc_fmt_money", """
    SELECT id, CASE WHEN v < 10000 THEN concat('$', format('{:,.2f}', v)) ELSE concat('$', format('{:,.0f}', v)) END
               AS shown
    FROM (SELECT id, CAST(net AS DOUBLE) AS v FROM transactions)""")
def fmt_money(s):
    return s.transactions.select("id", text.fmt_money(F.col("net")).alias("shown"))


@plan("sc_fmt_age", """
    SELECT id, CASE WHEN secs < 60 THEN concat(CAST(secs AS STRING), 's ago')
                    WHEN secs < 3600 THEN concat(CAST(secs // 60 AS STRING), 'm ago')
                    WHEN secs < 86400 THEN concat(CAST(secs // 3600 AS STRING), 'h ago')
                    ELSE concat(CAST(secs // 86400 AS STRING), 'd ago') END AS age
    FROM (SELECT id, date_sub('second', created_at, TIMESTAMP '2024-01-31 00:00:00') AS secs FROM market_insights)""")
def fmt_age(s):
    return s.market_insights.select("id", text.fmt_age(F.col("created_at"), moment(AS_OF_EVENT)).alias("age"))


@plan("sc_truncate", """
    SELECT doc_id, CASE WHEN length(text) > 52 THEN concat(substring(text, 1, 52), '…') ELSE text END AS product_title,
           CASE WHEN length(text) > 60 THEN concat(substring(text, 1, 60), '…') ELSE text END AS insight_title,
           substring(text, 1, 40) AS subject, substring(text, 1, 64) AS listing_name
    FROM documents""")
def truncate(s):
    t = F.col("text")
    return s.documents.select(
        "doc_id", text.shorten(t, 52).alias("product_title"), text.shorten(t, 60).alias("insight_title"),
        text.cut(t, 40).alias("subject"), text.cut(t, 64).alias("listing_name"),
    )


@plan("sc_day_label", """
    SELECT date, strftime(date, '%m-%d') AS label FROM metrics_by_day""")
def day_label(s):
    daily = aggregates.daily_metrics(s.transactions, s.opportunities, s.products)
    return daily.select("date", text.day_label(F.col("date")).alias("label"))


# White space written out here, so that the check does not rest on the pattern it checks.
@plan("sc_html_to_text", r"""
    SELECT page_id, body, substring(body, 1, 10000) AS excerpt
    FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))
              AS body FROM pages)""")
def html_to_text(s):
    html = F.col("html")
    return s.pages.select(
        "page_id", text.html_to_text(html).alias("body"), text.page_excerpt(html).alias("excerpt")
    )


@plan("sc_safe_filename", """
    SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g') AS file_name FROM pages""")
def safe_filename(s):
    return s.pages.select("page_id", text.safe_filename(F.col("url")).alias("file_name"))


@plan("sc_extract_json_array", r"""
    SELECT id, CAST(json_array_length(j) AS INT) AS n, array_to_string(json_extract_string(j, '$[*].title'), '|') AS titles,
           array_to_string(json_extract_string(j, '$[*].prompt'), '|') AS prompts
    FROM (SELECT id, CASE WHEN json_valid(text) THEN text
                          ELSE coalesce(nullif(regexp_extract(text, '\[[\s\S]*\]'), ''), '[]') END AS j FROM model_text)""")
def extract_json_array(s):
    found = s.model_text.select("id", text.prompt_list(F.col("text")).alias("items"))
    return found.select(
        "id", F.size("items").alias("n"), F.array_join("items.title", "|").alias("titles"),
        F.array_join("items.prompt", "|").alias("prompts"),
    )


@plan("sc_json_encode", """
    SELECT 'scanner' AS from_agent, 'content' AS to_agent, 'task' AS type,
           CAST(to_json({'task': 'create_product', 'opportunityId': id, 'title': title, 'description': description,
                    'platform': platform, 'metadata': CAST(metadata AS JSON)}) AS STRING) AS payload
    FROM opportunities""")
def json_encode(s):
    return mutations.opportunity_messages(s.opportunities)


# The texts of the offer, as in ``operators.reports``.
@plan("sc_lead_offer", """
    SELECT id, concat('Get 50 More ', niche, ' Prompts + Templates') AS headline,
           'The full pack includes 50 tested prompts, 5 workflow templates, and a quick-start guide.' AS description,
           '$17' AS price, 'https://example.com/prompt-pack' AS url, 'Get the Full Pack — $17' AS cta,
           concat(niche, ' how to guide best tools') AS search_query
    FROM leads WHERE niche <> ''""")
def lead_offer(s):
    return reports.lead_offers(filters.valid_leads(s.leads), OFFER_URL)
