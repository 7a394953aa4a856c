"""Data-quality reports."""

from functools import reduce

from pyspark.sql import DataFrame

from ledgerloom.operators import filters, quality
from ledgerloom.plans.registry import plan
from ledgerloom.schemas import INSIGHT_CATEGORIES, NOT_NULL, OPPORTUNITY_TYPES
from ledgerloom.sources import payloads


def _nulls_sql(source, columns):
    return "\nUNION ALL\n".join(
        f"SELECT '{source}' AS source, '{c}' AS \"check\", count(*) FILTER ({c} IS NULL) AS violations FROM {source}"
        for c in columns
    )


CHECKED = NOT_NULL | {"leads": ("niche", "email")}


@plan("dq_not_null", "\nUNION ALL\n".join(_nulls_sql(t, cs) for t, cs in CHECKED.items()))
def not_null(s):
    return reduce(
        DataFrame.unionByName, [quality.not_null(getattr(s, t), t, columns) for t, columns in CHECKED.items()]
    )


@plan("dq_foreign_key", """
    SELECT 'products' AS source, 'opportunity_id' AS "column", count(*) AS checked,
           count(*) FILTER (opportunity_id NOT IN (SELECT id FROM opportunities)) AS broken
    FROM products WHERE opportunity_id IS NOT NULL
    UNION ALL
    SELECT 'transactions', 'product_id', count(*), count(*) FILTER (product_id NOT IN (SELECT id FROM products))
    FROM transactions WHERE product_id IS NOT NULL
    UNION ALL
    SELECT 'agent_messages', 'opportunity_id', count(*),
           count(*) FILTER (opportunity_id NOT IN (SELECT id FROM opportunities))
    FROM creation_requests""")
def foreign_key(s):
    return reduce(DataFrame.unionByName, [
        quality.foreign_key(s.products, "opportunity_id", s.opportunities, "products"),
        quality.foreign_key(s.transactions, "product_id", s.products, "transactions"),
        quality.foreign_key(
            filters.creation_tasks(s.agent_messages), "opportunity_id", s.opportunities, "agent_messages"
        ),
    ])


@plan("dq_orphans", """
    SELECT t.id, t.product_id, t.type FROM transactions t
    WHERE t.product_id IS NOT NULL AND t.product_id NOT IN (SELECT id FROM products WHERE status = 'listed')""")
def orphans(s):
    """Ledger rows of products that are not on sale."""
    return quality.orphans(s.transactions, "product_id", filters.listed(s.products)).select("id", "product_id", "type")


@plan("dq_unique_key", "SELECT id, count(*) AS n FROM flat_orders GROUP BY id HAVING count(*) > 1")
def unique_key(s):
    return quality.repeated_keys(payloads.order_rows(s.raw_orders, "id"), "id")


@plan("dq_enum", """
    SELECT 'opportunities' AS source, 'type' AS "column", type AS value, count(*) AS n FROM opportunities
    WHERE type NOT IN ('digital_product', 'freelance', 'affiliate', 'service') GROUP BY type
    UNION ALL
    SELECT 'market_insights', 'category', category, count(*) FROM market_insights
    WHERE category NOT IN ('trend', 'competitor', 'keyword', 'niche') GROUP BY category""")
def enum(s):
    return quality.outside(s.opportunities, "opportunities", "type", OPPORTUNITY_TYPES).unionByName(
        quality.outside(s.market_insights, "market_insights", "category", INSIGHT_CATEGORIES)
    )


REQUIRED = ("id", "status", "amount", "customer.email", "product.name", "created_at")


@plan("dq_required_fields", "\nUNION ALL\n".join(
    f"SELECT 'raw_orders' AS source, '{p}' AS \"check\", count(*) FILTER ((payload->>'$.{p}') IS NULL) AS violations "
    "FROM raw_orders" for p in REQUIRED
) + """
    UNION ALL
    SELECT 'market_insights', 'score', count(*) FILTER (score NOT BETWEEN 0 AND 10) FROM market_insights""")
def required_fields(s):
    return quality.missing_fields(s.raw_orders, "raw_orders", payloads.ORDER, REQUIRED).unionByName(
        quality.outside_range(s.market_insights, "market_insights", "score", 0, 10)
    )
