"""Nested API payloads flattened to rows.

Each payload is parsed once against a declared schema. A field that is missing or null takes its
default; an unreadable number or time becomes NULL and is counted by the quality checks. A payload that is missing, that is no whole
JSON object, or in which no declared field can be read gives no rows; ``rejected`` returns it as it came. So every
payload is either read or rejected, in a batch and in a stream.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import strip

ORDER_FIELDS = {
    "id": "string", "status": "string", "amount": "bigint", "currency": "string",
    "customer": "struct<email: string>", "product": "struct<name: string>", "created_at": "string",
}
ORDER = ", ".join(f"{name} {kind}" for name, kind in ORDER_FIELDS.items())

SEARCH = "web struct<results: array<struct<title: string, url: string, description: string>>>"

POSTS = "posts array<struct<id: string, title: string, status: string, url: string, published_at: string>>"

MARKETPLACE_PRODUCTS = "items array<struct<id: string, name: string, is_archived: boolean>>"

JSONAPI_ORDER = (
    "status: string, total: bigint, subtotal: bigint, tax: bigint, currency: string, user_email: string, "
    "first_order_item: struct<product_name: string>, created_at: string, refunded: boolean"
)
JSONAPI_STORE = "name: string, slug: string, url: string, currency: string"
JSONAPI_PRODUCT = "name: string, status: string, buy_now_url: string"

# Fixed value: a feed title is the text of a CDATA section; group 1 is the text.
FEED_TITLE = r"<title><!\[CDATA\[([^\]]+)\]\]></title>"


# The top-level fields that each kind of payload is read by.
JSONAPI = "data array<struct<id: string, attributes: struct<{}>>>"
KINDS = {
    "orders": ORDER, "store_orders": JSONAPI.format(JSONAPI_ORDER), "stores": JSONAPI.format(JSONAPI_STORE),
    "store_products": JSONAPI.format(JSONAPI_PRODUCT), "marketplace_products": MARKETPLACE_PRODUCTS,
    "search_results": SEARCH, "posts": POSTS,
}
UNREADABLE = "unreadable"


def parsed(payloads: DataFrame, schema: str, *keep: str) -> DataFrame:
    """``keep`` and the fields of ``schema`` for each payload that can be read.

    ``explode`` keeps the parsed record behind a generator: a later filter on its fields is then not
    pushed below it, where it would parse every payload again for each field it names.
    """
    rows = payloads.select(*keep, F.explode(F.array(_record(schema))).alias("r"))
    return rows.where(_is_read(rows)).select(*keep, "r.*").drop(UNREADABLE)


def rejected(payloads: DataFrame, kind: str) -> DataFrame:
    """The rows of ``payloads`` that give no rows as they can't be read, unchanged."""
    rows = payloads.select(F.struct("*").alias("row"), F.explode(F.array(_record(KINDS[kind]))).alias("r"))
    return rows.where(~_is_read(rows)).select("row.*")


def _is_read(rows: DataFrame) -> Column:
    """Whether the record ``r`` is there, and is whole or has a field that could be read."""
    fields = [F.col(f"r.{c}") for c in rows.select("r.*").columns if c != UNREADABLE]
    return F.col("r").isNotNull() & (F.col(f"r.{UNREADABLE}").isNull() | reduce(or_, [c.isNotNull() for c in fields]))


def _record(schema: str) -> Column:
    return F.from_json("payload", f"{schema}, {UNREADABLE} string", {"columnNameOfCorruptRecord": UNREADABLE})


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def order_rows(payloads: DataFrame, *columns: str) -> DataFrame:
    """One row per order payload, all columns or the named ones; ``amount`` is in cents.

    Pruning does not reach below the parsed record, so name the columns where only some are needed.
    """
    values = {c: F.col(c) for c in ("id", "status", "amount", "currency")} | {
        "customer_email": F.coalesce("customer.email", F.lit("")),
        "product_name": F.coalesce("product.name", F.lit("")),
        "created_at": _time(F.col("created_at")),
    }
    columns = columns or tuple(values)
    nested = {"customer_email": "customer", "product_name": "product"}
    schema = ", ".join(f"{name} {ORDER_FIELDS[name]}" for name in (nested.get(c, c) for c in columns))
    o = parsed(payloads, schema)
    return o.select(*[values[c].alias(c) for c in columns])


def flatten_jsonapi(
    payloads: DataFrame, attributes: str, fields: Mapping[str, str], defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Rows of ``data[]``: the record id, and ``fields`` (output name -> attribute path) with defaults."""
    r = parsed(payloads, JSONAPI.format(attributes)).select(F.explode("data").alias("r"))
    defaults = defaults or {}

    def value(name: str, path: str) -> Column:
        c = F.col(f"r.attributes.{path}")
        return (F.coalesce(c, F.lit(defaults[name])) if name in defaults else c).alias(name)

    return r.select("r.id", *[value(n, p) for n, p in fields.items()])


def store_orders(payloads: DataFrame) -> DataFrame:
    fields = {c: c for c in ("status", "total", "subtotal", "tax", "currency")}
    fields |= {
        "customer_email": "user_email", "product_name": "first_order_item.product_name",
        "created_at": "created_at", "refunded": "refunded",
    }
    rows = flatten_jsonapi(
        payloads, JSONAPI_ORDER, fields, {"customer_email": "", "product_name": "", "refunded": False}
    )
    return rows.withColumn("created_at", _time(F.col("created_at")))


def stores(payloads: DataFrame) -> DataFrame:
    return flatten_jsonapi(payloads, JSONAPI_STORE, {c: c for c in ("name", "slug", "url", "currency")})


def store_products(payloads: DataFrame) -> DataFrame:
    fields = {c: c for c in ("name", "status", "buy_now_url")}
    return flatten_jsonapi(payloads, JSONAPI_PRODUCT, fields, {"buy_now_url": ""})


def marketplace_products(payloads: DataFrame) -> DataFrame:
    """The marketplace's own list of products, from ``items[]``."""
    p = parsed(payloads, MARKETPLACE_PRODUCTS).select(F.inline("items"))
    return p.select("id", "name", "is_archived")


def search_results(payloads: DataFrame, n: int | None = None, missing_snippet: str | None = "") -> DataFrame:
    """The results of each search, or its first ``n``; ``missing_snippet=None`` keeps absent snippets NULL."""
    results = F.col("web.results")
    kept = results if n is None else F.slice(results, 1, n)
    r = parsed(payloads, SEARCH, "query_id").select("query_id", F.posexplode(kept).alias("pos", "r"))
    snippet = F.coalesce("r.description", F.lit(missing_snippet).cast("string"))
    return r.select("query_id", "pos", "r.title", "r.url", snippet.alias("snippet"))


def posts(payloads: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Blog posts as rows; newest published first when limited to a page."""
    p = parsed(payloads, POSTS).select(F.explode("posts").alias("p")).select("p.*")
    if status:
        p = p.where(F.col("status") == status)
    if limit is not None:
        p = p.orderBy(F.desc_nulls_last("published_at"), "id").limit(limit)
    return p.select("id", "title", "status", F.coalesce("url", F.lit("")).alias("url"), "published_at")


def posts_total(payloads: DataFrame) -> DataFrame:
    total = F.get_json_object("payload", "$.meta.pagination.total").try_cast("bigint")
    return payloads.select("batch_id", F.coalesce(total, F.lit(0)).alias("total"))


def feed_titles(feeds: DataFrame, n: int | None = None) -> DataFrame:
    """Item titles of each feed, or its first ``n``: the first title names the channel and is skipped."""
    titles = F.regexp_extract_all("body", F.lit(FEED_TITLE), F.lit(1))
    items = F.slice(titles, F.lit(2), F.size(titles) if n is None else F.lit(n))
    t = feeds.select("feed_id", F.posexplode(items).alias("pos", "title"))
    return t.withColumn("title", strip(F.col("title")))
