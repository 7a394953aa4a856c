"""Sinks: what was written, read back."""

from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.operators import aggregates, joins, mutations
from ledgerloom.plans.registry import AS_OF_EVENT, GOAL, as_double, by_status_text, id_sql, plan
from ledgerloom.sinks import outbox, snapshot, tables
from ledgerloom.sources.tables import load, lookup


@plan("sink_append", """
    SELECT id, opportunity_id, title, description, CAST(price AS DOUBLE) AS price, platform, file_path,
           'draft' AS status, 0::BIGINT AS views, 0::BIGINT AS sales, 0::DOUBLE AS revenue,
           TIMESTAMP '2024-01-31 00:00:00' AS created_at, TIMESTAMP '2024-01-31 00:00:00' AS updated_at
    FROM products""")
def append(s):
    root = workspace.new_folder(s.spark, "append")
    given = ("id", "opportunity_id", "title", "description", "price", "platform", "file_path")
    tables.append(s.products.select(*given), root, "products", AS_OF_EVENT)
    return as_double(load(s.spark, root, "products"), "price", "revenue").drop("platform_id", "platform_url")


@plan("sink_append_messages", f"""
    SELECT {id_sql("'scanner'", "'content'", "'task'", "payload", "'2024-01-31 00:00:00'")} AS id, 'scanner' AS from_agent, 'content' AS to_agent, 'task' AS type, CAST(0 AS INT) AS read, payload,
           TIMESTAMP '2024-01-31 00:00:00' AS created_at
    FROM (SELECT CAST(to_json({{'task': 'create_product', 'opportunityId': id, 'title': title, 'description': description,
                               'platform': platform, 'metadata': {{'keywords': json_extract(metadata, '$.keywords')}}}})
                 AS STRING) AS payload FROM opportunities)""")
def append_messages(s):
    root = workspace.new_folder(s.spark, "append")
    tables.append(mutations.opportunity_messages(s.opportunities), root, "agent_messages", AS_OF_EVENT)
    return load(s.spark, root, "agent_messages")


@plan("sink_rewrite", "SELECT id, from_agent, to_agent, type, payload, read, created_at FROM agent_messages")
def rewrite(s):
    root = workspace.new_folder(s.spark, "rewrite")
    tables.rewrite(s.agent_messages, root, "agent_messages")
    return load(s.spark, root, "agent_messages")


KINDS = ("digital_product", "affiliate", "service")


@plan("sink_append_violations", f"""
    SELECT 'type is null' AS violation, count(*) FILTER (type IS NULL) AS n FROM opportunities
    UNION ALL SELECT 'title is null', count(*) FILTER (title IS NULL) FROM opportunities
    UNION ALL SELECT 'type not allowed', count(*) FILTER (type NOT IN {KINDS}) FROM opportunities""")
def append_violations(s):
    root = workspace.new_folder(s.spark, "append")
    seen = tables.append(s.opportunities, root, "opportunities", AS_OF_EVENT, {"type": KINDS})
    counts = F.array(*[F.struct(F.lit(name).alias("violation"), F.lit(n).cast("bigint").alias("n")) for name, n in seen.items()])
    return s.spark.range(1).select(F.inline(counts))


@plan("src_lookup", """
    SELECT id, title, status FROM opportunities
    WHERE title IN (SELECT title FROM opportunities ORDER BY title LIMIT 3)""")
def lookup_rows(s):
    root = workspace.new_folder(s.spark, "lookup")
    tables.rewrite(s.opportunities, root, "opportunities")
    keys = [r.title for r in load(s.spark, root, "opportunities").orderBy("title").select("title").limit(3).collect()]
    return lookup(s.spark, root, "opportunities", "title", keys).select("id", "title", "status")


LISTS = {
    "agents": ("agent_id", "last_run", "run_count", "status", "current_task"),
    "recent_products": ("title", "price", "status", "platform", "platform_url", "created_at"),
    "recent_insights": ("category", "title", "score", "created_at"),
    "activity": ("from_agent", "to_agent", "type", "payload", "created_at"),
    "daily": ("date", "revenue", "products_created", "products_listed", "sales_count"),
}
NUMBERS = ("price", "score", "revenue")
TIMES = ("last_run", "created_at")  # JSON has them in milliseconds


def _as_text(name):
    """All fields of a list's entries as one text."""
    def text(row):
        shown = [(row[f].cast("decimal(18,4)") if f in NUMBERS else F.date_trunc("second", row[f]) if f in TIMES
                  else row[f]).cast("string") for f in LISTS[name]]
        return F.concat_ws("~", *[F.coalesce(c, F.lit("")) for c in shown])

    return F.array_join(F.transform(name, text), "|").alias(name)


def _as_text_sql(name, order, rows):
    value = dict.fromkeys(NUMBERS, "CAST({} AS DECIMAL(18,4))") | dict.fromkeys(TIMES, "date_trunc('second', {})")
    shown = [f"coalesce(CAST({value.get(f, '{}').format(f)} AS STRING), '')" for f in LISTS[name]]
    return f"(SELECT string_agg(concat_ws('~', {', '.join(shown)}), '|' ORDER BY {order}) FROM ({rows})) AS {name}"


@plan("sink_snapshot", f"""
    SELECT revenue, CAST(2000000000 AS DOUBLE) AS goal, sales, least(100.0, round(revenue / CAST(2000000000 AS DOUBLE) * 100, 1)) AS pct,
           revenue / days_running * 30 AS run_rate, days_running, total_listed, total_draft, potential_gmv,
           opp_open, opp_completed, opp_by_status, agents, recent_products, recent_insights, activity, daily
    FROM (SELECT
        (SELECT CAST(sum(net) AS DOUBLE) FROM transactions WHERE type = 'sale') AS revenue,
        (SELECT count(*) FROM transactions WHERE type = 'sale') AS sales,
        (SELECT CAST(date_sub('second', min(created_at), TIMESTAMP '2024-01-31 00:00:00') // 86400 + 1 AS BIGINT)
         FROM products) AS days_running,
        (SELECT count(*) FROM products WHERE status = 'listed') AS total_listed,
        (SELECT count(*) FROM products WHERE status = 'draft') AS total_draft,
        (SELECT CAST(sum(price) AS DOUBLE) FROM products WHERE status = 'listed') AS potential_gmv,
        (SELECT count(*) FROM opportunities WHERE status IN ('pending', 'in_progress')) AS opp_open,
        (SELECT count(*) FROM opportunities WHERE status = 'listed') AS opp_completed,
        (SELECT string_agg(concat(status, ':', n), '|' ORDER BY status)
         FROM (SELECT status, count(*) AS n FROM opportunities GROUP BY status)) AS opp_by_status,
        {_as_text_sql("agents", "agent_id", "SELECT * FROM state_by_agent")},
        {_as_text_sql("recent_products", "created_at DESC, id", "SELECT * FROM products ORDER BY created_at DESC, id LIMIT 10")},
        {_as_text_sql("recent_insights", "created_at DESC, id", """SELECT * FROM market_insights
               WHERE category IN ('alert', 'recommendation', 'trend') ORDER BY created_at DESC, id LIMIT 8""")},
        {_as_text_sql("activity", "created_at DESC, id", "SELECT * FROM agent_messages ORDER BY created_at DESC, id LIMIT 12")},
        {_as_text_sql("daily", "date DESC", "SELECT * FROM metrics_by_day ORDER BY date DESC LIMIT 14")})""")
def dashboard(s):
    """The JSON record, decoded again: its figures and all fields of its lists."""
    row = snapshot.snapshot(
        s.transactions, s.products, s.opportunities, s.market_insights, s.agent_messages,
        aggregates.daily_metrics(s.transactions, s.opportunities, s.products),
        aggregates.agent_state(s.agent_runs), GOAL, AS_OF_EVENT,
    )
    body = snapshot.snapshot_json(row).select(F.from_json("body", row.schema).alias("d")).select("d.*")
    return body.select(
        "revenue", "goal", "sales", "pct", "run_rate", "days_running", "total_listed", "total_draft", "potential_gmv",
        "opp_open", "opp_completed", by_status_text(F.col("opp_by_status")).alias("opp_by_status"), *map(_as_text, LISTS),
    )


@plan("out_listing_batch", """
    SELECT product_id, name, description, price_cents, price_cents = 0 AS is_free,
           CAST(to_json({'name': name, 'description': description, 'price': price_cents,
                         'is_free': price_cents = 0}) AS STRING) AS body
    FROM (SELECT r.product_id, substring(r.title, 1, 64) AS name, r.price_cents,
                 concat(r.description, chr(10), chr(10), '📎 **File included:** ',
                        list_last(string_split(coalesce(nullif(r.file_path, ''), p.file_path), '/')), chr(10),
                        '*Download link sent automatically after purchase.*') AS description
          FROM publish_requests r LEFT JOIN products p ON p.id = r.product_id)""")
def listing_batch(s):
    return outbox.listing_batch(joins.with_file(s.publish_requests, s.products))


@plan("out_post_batch", """
    SELECT id, title, html, status, tag_list AS tags, meta_description, meta_description AS og_description,
           nullif(feature_image, '') AS feature_image, nullif(canonical_url, '') AS canonical_url,
           CASE WHEN status = 'published' THEN '2024-01-31T00:00:00+00:00' END AS published_at FROM articles""")
def post_batch(s):
    articles = s.articles.withColumn("tags", F.split("tag_list", ","))
    bodies = outbox.post_batch(articles, AS_OF_EVENT)
    post = (
        "title: string, html: string, status: string, tags: array<struct<name: string>>, "
        "meta_description: string, og_description: string, feature_image: string, canonical_url: string, "
        "published_at: string"
    )
    posts = bodies.select("id", F.from_json("body", f"posts array<struct<{post}>>")["posts"][0].alias("p"))
    tags = F.when(F.col("p.tags").isNotNull(), F.array_join("p.tags.name", ",")).alias("tags")
    return posts.select(
        "id", "p.title", "p.html", "p.status", tags, "p.meta_description", "p.og_description", "p.feature_image",
        "p.canonical_url", "p.published_at",
    )
