"""How the domain tables are derived from the driver tables.

Each view is one projection of one table, in expressions that Spark and DuckDB read alike, so the
library and the checking SQL start from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    table: str
    columns: tuple[str, ...]

    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.table}"


def _cents(column: str) -> str:
    return f"CAST(CAST(CAST({column} AS DECIMAL(18,2)) * 100 AS BIGINT) AS STRING)"


_ORDER_ID = "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))"
_ORDER_STATUS = """CASE WHEN l_returnflag = 'N' THEN 'OrderStatus.PAID' WHEN l_returnflag = 'A' THEN 'succeeded'
                 WHEN l_linestatus = 'F' THEN 'unpaid' ELSE 'pending' END"""
_AMOUNT = "CAST(o_totalprice AS DECIMAL(18,2))"
_FEE = f"CAST({_AMOUNT} * 0.04 + 0.40 AS DECIMAL(18,4))"

VIEWS: dict[str, View] = {
    "opportunities": View("part", (
        "p_partkey AS id",
        """CASE p_type WHEN 'PROMO' THEN 'affiliate' WHEN 'ECONOMY' THEN 'service'
           WHEN 'STANDARD' THEN 'micro_saas' ELSE 'digital_product' END AS type""",
        "concat(p_name, ' ', p_brand) AS title",
        "p_type AS description",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS estimated_revenue",
        "CAST(p_size AS DECIMAL(18,2)) AS effort_hours",
        """CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'listed'
           WHEN 3 THEN 'sold' ELSE 'failed' END AS status""",
        "CASE p_partkey % 3 WHEN 0 THEN 'gumroad' WHEN 1 THEN 'etsy' ELSE 'polar' END AS platform",
        "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * p_partkey AS created_at",
        """concat('{"keywords":["', p_brand, '","', lower(p_type), '"]}') AS metadata""",
    )),
    "products": View("part", (
        "p_partkey AS id",
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey END AS opportunity_id",
        "concat(p_name, ' ', p_brand) AS title",
        "p_type AS description",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS price",
        "CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'listed' ELSE 'unlisted' END AS status",
        "CASE p_partkey % 3 WHEN 1 THEN 'polar' ELSE 'gumroad' END AS platform",
        """CASE WHEN p_partkey % 3 = 1
           THEN concat('https://example.com/p/', CAST(p_partkey AS STRING)) END AS platform_url""",
        "concat('data/products/', CAST(p_partkey AS STRING), '.md') AS file_path",
        "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (p_partkey % 720) AS created_at",
    )),
    "transactions": View("orders", (
        "o_orderkey AS id",
        "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS product_id",
        f"{_AMOUNT} AS amount",
        f"CASE WHEN o_orderstatus = 'F' THEN {_FEE} ELSE CAST(0 AS DECIMAL(18,4)) END AS fee",
        f"""CAST(CASE o_orderstatus WHEN 'F' THEN {_AMOUNT} - {_FEE} ELSE -{_AMOUNT} END
            AS DECIMAL(18,4)) AS net""",
        "CASE o_orderstatus WHEN 'F' THEN 'sale' WHEN 'P' THEN 'refund' ELSE 'expense' END AS type",
        "'polar' AS platform",
        "concat('txn-', CAST(o_orderkey AS STRING)) AS transaction_id",
        "o_orderpriority AS description",
        "CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS occurred_at",
    )),
    "agent_messages": View("events", (
        "event_id AS id",
        """CASE event_type WHEN 'click' THEN 'scanner' WHEN 'view' THEN 'content' WHEN 'signup' THEN 'sales'
           WHEN 'purchase' THEN 'blog' ELSE 'analytics' END AS from_agent""",
        """CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'content' WHEN 2 THEN 'sales'
           WHEN 3 THEN 'finance' ELSE 'orchestrator' END AS to_agent""",
        """CASE event_type WHEN 'click' THEN 'task' WHEN 'view' THEN 'task' WHEN 'signup' THEN 'event'
           WHEN 'purchase' THEN 'published' ELSE 'recommendation' END AS type""",
        """CASE WHEN event_type = 'click'
                THEN concat('{"task":"create_product","opportunityId":', CAST(user_id AS STRING), '}')
                WHEN event_type = 'view'
                THEN concat('{"task":"list_product","productId":', CAST(user_id AS STRING), '}')
                ELSE concat('{"title":"', event_type, ' ', CAST(event_id AS STRING), '"}') END AS payload""",
        "CAST(event_id % 2 AS INT) AS read",
        "CAST(ts AS TIMESTAMP) AS created_at",
    )),
    "agent_runs": View("events", (
        "event_id AS seq",
        """CASE user_id % 7 WHEN 0 THEN 'scanner' WHEN 1 THEN 'content' WHEN 2 THEN 'sales'
           WHEN 3 THEN 'blog' WHEN 4 THEN 'analytics' WHEN 5 THEN 'finance' ELSE 'critic' END AS agent_id""",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'idle' END AS status",
        "CASE WHEN event_type = 'click' THEN props END AS current_task",
        "CASE WHEN event_id % 5 <> 0 THEN props END AS metadata",
        "CAST(ts AS TIMESTAMP) AS run_at",
    )),
    "market_insights": View("events", (
        "event_id AS id",
        """CASE event_type WHEN 'click' THEN 'trend' WHEN 'view' THEN 'niche'
           WHEN 'signup' THEN 'recommendation' WHEN 'purchase' THEN 'opportunity' ELSE 'alert' END AS category""",
        "concat('insight ', CAST(user_id AS STRING), ' ', event_type) AS title",
        "props AS data",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS score",
        "event_type AS source",
        "CAST(ts AS TIMESTAMP) AS created_at",
    )),
    "raw_orders": View("lineitem", (
        f"""concat('{{', CASE WHEN l_orderkey % 61 = 0 THEN '' ELSE concat('"id":"', {_ORDER_ID}, '",') END,
            '"status":"', {_ORDER_STATUS},
            '","amount":', {_cents('l_extendedprice')}, ',"currency":"usd"',
            CASE WHEN l_suppkey % 7 = 0 THEN ''
                 ELSE concat(',"customer":{{"email":"u', CAST(l_suppkey AS STRING), '@example.com"}}') END,
            ',"product":{{"name":"part ', CAST(l_partkey AS STRING), '"}},"created_at":"',
            substring(CAST(l_shipdate AS STRING), 1, 19), '"}}') AS payload""",
    )),
    "known_orders": View("lineitem", (
        f"CASE WHEN l_orderkey % 61 <> 0 THEN {_ORDER_ID} END AS id",
        f"{_ORDER_STATUS} AS status",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount",
        "'usd' AS currency",
        """CASE WHEN l_suppkey % 7 = 0 THEN ''
           ELSE concat('u', CAST(l_suppkey AS STRING), '@example.com') END AS customer_email""",
        "concat('part ', CAST(l_partkey AS STRING)) AS product_name",
        "CAST(l_shipdate AS TIMESTAMP) AS created_at",
    )),
    "raw_orders_jsonapi": View("orders", (
        f"""concat('{{"data":[{{"id":"', CAST(o_orderkey AS STRING), '","attributes":{{"status":"',
            CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'paid' END,
            '","total":', {_cents('o_totalprice')}, ',"subtotal":1,"tax":0,"currency":"USD"',
            CASE WHEN o_custkey % 7 = 0 THEN ''
                 ELSE concat(',"user_email":"u', CAST(o_custkey AS STRING), '@example.com"') END,
            ',"first_order_item":{{"product_name":"', o_orderpriority, '"}},"created_at":"',
            substring(CAST(o_orderdate AS STRING), 1, 19), '"',
            CASE WHEN o_orderstatus = 'P' THEN ',"refunded":true' ELSE '' END, '}}}}]}}') AS payload""",
    )),
    "raw_stores_jsonapi": View("supplier", (
        """concat('{"data":[{"id":"', CAST(s_suppkey AS STRING), '","attributes":{"name":"', s_name,
           '","slug":"s-', CAST(s_suppkey AS STRING), '","url":"https://s', CAST(s_suppkey AS STRING),
           '.example.com","currency":"USD"}}]}') AS payload""",
    )),
    "raw_products_jsonapi": View("part", (
        """concat('{"data":[{"id":"', CAST(p_partkey AS STRING), '","attributes":{"name":"', p_name,
           '","status":"published","buy_now_url":"https://example.com/buy/', CAST(p_partkey AS STRING),
           '"}},{"id":"', CAST(p_partkey AS STRING), '-b","attributes":{"name":"', p_brand,
           '","status":"draft"}}]}') AS payload""",
    )),
    "raw_marketplace_products": View("part", (
        """concat('{"items":[{"id":"pl_', CAST(p_partkey AS STRING), '","name":"', p_name, '","is_archived":',
           CASE WHEN p_size > 40 THEN 'true' ELSE 'false' END, '}]}') AS payload""",
    )),
    "search_payload": View("events", (
        "user_id AS query_id",
        """concat('{"web":{"results":[{"title":"r', CAST(event_id AS STRING), '","url":"https://example.com/',
           event_type, '"',
           CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"description":"d ', event_type, '"') END,
           '},{"title":"s', CAST(event_id AS STRING), '","url":"https://example.com/b"}',
           repeat(concat(',{"title":"more ', CAST(event_id AS STRING), '","url":"https://example.com/c"}'),
                  CASE WHEN event_id % 20 = 0 THEN 12 ELSE 0 END), ']}}') AS payload""",
    )),
    "posts_payload": View("pages", (
        "page_id AS batch_id",
        """concat('{"posts":[{"id":"', CAST(page_id AS STRING), '","title":"post ', CAST(page_id % 40 AS STRING),
           '","status":"', CASE page_id % 3 WHEN 0 THEN 'draft' ELSE 'published' END, '"',
           CASE WHEN page_id % 5 = 0 THEN '' ELSE concat(',"url":"', url, '"') END,
           CASE WHEN page_id % 7 = 0 THEN ''
                ELSE concat(',"published_at":"2024-01-', CAST(10 + page_id % 20 AS STRING), 'T00:00:00Z"') END, '}]',
           CASE WHEN page_id % 4 = 0 THEN ''
                ELSE concat(',"meta":{"pagination":{"total":', CAST(page_id AS STRING), '}}') END, '}') AS payload""",
    )),
    "articles": View("pages", (
        "page_id AS id",
        "concat('post ', CAST(page_id % 40 AS STRING)) AS title",
        "html",
        "CASE page_id % 3 WHEN 0 THEN 'draft' ELSE 'published' END AS status",
        "CASE WHEN page_id % 6 = 0 THEN NULL ELSE concat('tag ', CAST(page_id % 4 AS STRING), ',guide') END AS tag_list",
        "CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('about ', url) END AS meta_description",
        "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat(url, '.png') END AS feature_image",
        "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE url END AS canonical_url",
    )),
    "publish_requests": View("part", (
        "p_partkey AS request_id",
        "CASE WHEN p_partkey % 9 = 8 THEN p_partkey - 2 ELSE p_partkey END AS product_id",
        "upper(concat(p_name, ' ', p_brand)) AS title",
        "concat('now with ', lower(p_type)) AS description",
        "CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) + 100 AS price_cents",
        """CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL
           ELSE concat('uploads/', CAST(p_partkey AS STRING), '.pdf') END AS file_path""",
        "concat('pl_', CAST(p_partkey AS STRING)) AS platform_id",
        "concat('https://example.com/buy/', CAST(p_partkey AS STRING)) AS platform_url",
    )),
    "leads": View("customer", (
        "c_custkey AS id",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lower(c_mktsegment) END AS niche",
        """CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not-an-email'
           ELSE concat('lead', CAST(c_custkey % 200 AS STRING), '@example.com') END AS email""",
    )),
    "feed_xml": View("pages", (
        "page_id AS feed_id",
        """concat('<rss><title><![CDATA[Daily]]></title><item><title><![CDATA[topic ',
           CAST(page_id % 30 AS STRING), ']]></title></item><item><title><![CDATA[topic ',
           CAST(page_id % 7 AS STRING), ']]></title></item>',
           repeat('<item><title><![CDATA[evergreen]]></title></item>', CASE WHEN page_id % 10 = 0 THEN 12 ELSE 0 END),
           '</rss>') AS body""",
    )),
    "model_text": View("events", (
        "event_id AS id",
        """CASE event_type
           WHEN 'click' THEN concat('Here you go: [{"title":"t', CAST(event_id AS STRING), '","prompt":"p"}] enjoy')
           WHEN 'view' THEN concat('[{"title":"t', CAST(event_id AS STRING),
                                   '","prompt":"p"},{"title":"u","prompt":"q"}]')
           ELSE 'sorry, no list' END AS text""",
    )),
}
