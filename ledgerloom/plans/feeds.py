"""Ranked and newest-first lists. The result names."""

from ledgerloom.operators import aggregates, feeds
from ledgerloom.plans.registry import AS_OF_EVENT, as_double, plan


def _rollup(s):
    return aggregates.product_rollup(s.products, s.transactions)


def _daily(s):
    return aggregates.daily_metrics(s.transactions, s.opportunities, s.products)


@plan("top_pending", """
    SELECT id, title, type, CAST(estimated_revenue AS DOUBLE) AS estimated_revenue FROM opportunities
    WHERE status = 'pending' ORDER BY estimated_revenue DESC NULLS LAST, id LIMIT 5""")
def top_pending(s):
    top = feeds.top_pending(s.opportunities)
    return as_double(top.select("id", "title", "type", "estimated_revenue"), "estimated_revenue")


@plan("top_earners", """
    SELECT title, CAST(revenue AS DOUBLE) AS revenue, sales FROM (
        SELECT * FROM rollup_products WHERE revenue > 0 ORDER BY revenue DESC, id LIMIT 5)""")
def top_earners(s):
    return as_double(feeds.top_earners(_rollup(s)).select("title", "revenue", "sales"), "revenue")


@plan("sort_by_product", """
    SELECT title, CAST(price AS DOUBLE) AS price, sales, CAST(revenue AS DOUBLE) AS revenue, platform_url
    FROM rollup_products WHERE revenue > 0 ORDER BY rollup_products.revenue DESC, id""")
def sort_by_product(s):
    ranked = feeds.by_revenue(_rollup(s)).select("title", "price", "sales", "revenue", "platform_url")
    return as_double(ranked, "price", "revenue")


@plan("top_recent_transactions", """
    SELECT id, product_id, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, CAST(net AS DOUBLE) AS net,
           platform, transaction_id, type, description, occurred_at
    FROM transactions ORDER BY occurred_at DESC, id LIMIT 20""")
def recent_transactions(s):
    return as_double(feeds.recent_transactions(s.transactions), "amount", "fee", "net")


@plan("top_recent_opportunities", """
    SELECT title, type, status FROM (SELECT * FROM opportunities ORDER BY created_at DESC, id LIMIT 20)""")
def recent_opportunities(s):
    return feeds.recent_opportunities(s.opportunities)


@plan("top_recent_products", """
    SELECT id, title, CAST(price AS DOUBLE) AS price, status, platform, platform_url, created_at
    FROM products ORDER BY created_at DESC, id LIMIT 10""")
def recent_products(s):
    return as_double(feeds.recent_products(s.products), "price")


@plan("top_recent_insights", """
    SELECT id, category, title, CAST(score AS DOUBLE) AS score, created_at FROM market_insights
    WHERE category IN ('alert', 'recommendation', 'trend') ORDER BY created_at DESC, id LIMIT 8""")
def recent_insights(s):
    return as_double(feeds.recent_insights(s.market_insights), "score")


@plan("top_topic_insights", """
    SELECT id, title, data, CAST(score AS DOUBLE) AS score, created_at FROM market_insights
    WHERE category IN ('trend', 'niche')
    ORDER BY market_insights.score DESC NULLS LAST, created_at DESC, id LIMIT 10""")
def topic_insights(s):
    return as_double(feeds.topic_insights(s.market_insights), "score")


@plan("top_activity", """
    SELECT id, from_agent, to_agent, type, payload, created_at FROM agent_messages
    ORDER BY created_at DESC, id LIMIT 12""")
def activity(s):
    return feeds.activity(s.agent_messages)


@plan("top_daily", """
    SELECT date, CAST(revenue AS DOUBLE) AS revenue, products_created, products_listed, sales_count
    FROM metrics_by_day ORDER BY date DESC LIMIT 14""")
def daily(s):
    return as_double(feeds.newest_days(_daily(s)), "revenue")


@plan("top_daily_bars", """
    SELECT date, products_created, right(CAST(date AS STRING), 5) AS label
    FROM metrics_by_day ORDER BY date DESC LIMIT 7""")
def daily_bars(s):
    return feeds.bar_days(_daily(s))


@plan("sc_activity_row", """
    SELECT id, from_agent, coalesce(nullif(to_agent, ''), 'broadcast') AS recipient, type,
           substring(coalesce(nullif(payload->>'$.task', ''), payload->>'$.title', ''), 1, 40) AS subject,
           CASE WHEN secs < 60 THEN concat(CAST(secs AS STRING), 's ago')
                WHEN secs < 3600 THEN concat(CAST(secs // 60 AS STRING), 'm ago')
                WHEN secs < 86400 THEN concat(CAST(secs // 3600 AS STRING), 'h ago')
                ELSE concat(CAST(secs // 86400 AS STRING), 'd ago') END AS age
    FROM (SELECT *, date_sub('second', created_at, TIMESTAMP '2024-01-31 00:00:00') AS secs FROM agent_messages)""")
def activity_row(s):
    return feeds.activity_lines(s.agent_messages, AS_OF_EVENT)


@plan("sc_topic_context", """
    SELECT concat(chr(10), chr(10), 'Market insights to consider:', chr(10),
                  string_agg(concat('- ', title), chr(10) ORDER BY score DESC NULLS LAST, created_at DESC, id)) AS context
    FROM (SELECT * FROM market_insights WHERE category IN ('trend', 'niche')
          ORDER BY score DESC NULLS LAST, created_at DESC, id LIMIT 10)""")
def topic_context(s):
    return feeds.topic_context(s.market_insights)
