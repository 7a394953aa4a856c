"""Table schemas, column defaults and constraints of the commerce data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STRING, LONG, INT, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
MONEY = T.DecimalType(18, 2)
FINE_MONEY = T.DecimalType(18, 4)  # fees and net amounts keep sub-cent digits


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Column names, defaults and allowed values of the data model.
TABLES: dict[str, T.StructType] = {
    "opportunities": table(
        id=LONG, type=STRING, title=STRING, description=STRING, estimated_revenue=MONEY, effort_hours=MONEY,
        status=STRING, platform=STRING, platform_id=STRING, platform_url=STRING, created_at=TIME, updated_at=TIME,
        metadata=STRING,
    ),
    "products": table(
        id=LONG, opportunity_id=LONG, title=STRING, description=STRING, price=MONEY, platform=STRING,
        platform_id=STRING, platform_url=STRING, file_path=STRING, status=STRING, views=LONG, sales=LONG,
        revenue=FINE_MONEY, created_at=TIME, updated_at=TIME,
    ),
    "transactions": table(
        id=LONG, product_id=LONG, amount=MONEY, fee=FINE_MONEY, net=FINE_MONEY, platform=STRING,
        transaction_id=STRING, type=STRING, description=STRING, occurred_at=TIME,
    ),
    "agent_messages": table(
        id=LONG, from_agent=STRING, to_agent=STRING, type=STRING, payload=STRING, read=INT, created_at=TIME,
    ),
    "agent_state": table(
        agent_id=STRING, last_run=TIME, run_count=LONG, status=STRING, current_task=STRING, metadata=STRING,
    ),
    "market_insights": table(
        id=LONG, category=STRING, title=STRING, data=STRING, score=MONEY, source=STRING, created_at=TIME,
        expires_at=TIME,
    ),
    "daily_metrics": table(
        date=T.DateType(), revenue=FINE_MONEY, expenses=FINE_MONEY, net=FINE_MONEY, opportunities_found=LONG,
        products_created=LONG, products_listed=LONG, sales_count=LONG,
    ),
}

DEFAULTS: dict[str, dict[str, object]] = {
    "opportunities": {"status": "pending"},
    "products": {"status": "draft", "views": 0, "sales": 0, "revenue": 0},
    "transactions": {"fee": 0, "type": "sale"},
    "agent_messages": {"read": 0},
    "market_insights": {},
}

# Columns that take the time of the insert.
INSERT_TIMES: dict[str, tuple[str, ...]] = {
    "opportunities": ("created_at", "updated_at"),
    "products": ("created_at", "updated_at"),
    "transactions": ("occurred_at",),
    "agent_messages": ("created_at",),
    "market_insights": ("created_at",),
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    "opportunities": ("type", "title"),
    "products": ("title", "price", "platform"),
    "transactions": ("amount", "net"),
    "agent_messages": ("from_agent", "type", "payload"),
    "market_insights": ("category", "title", "data"),
}

# Leading columns are those that lookups and filters use; the rest tells rows of one value apart.
CLUSTERING: dict[str, tuple[str, ...]] = {
    "opportunities": ("status", "id"),
    "products": ("status", "id"),
    "transactions": ("occurred_at", "transaction_id", "id"),
    "agent_messages": ("to_agent", "read", "id"),
    "market_insights": ("category", "score", "id"),
    "agent_state": ("agent_id",),
    "daily_metrics": ("date",),
}

# Columns that single rows are looked up by; stored tables have bloom filters on them.
LOOKUPS: dict[str, tuple[str, ...]] = {
    "opportunities": ("id", "title"),
    "products": ("id", "opportunity_id"),
    "transactions": ("transaction_id", "product_id"),
    "agent_messages": ("id",),
}

# What an id is made of where a row is inserted without one.
IDENTITY: dict[str, tuple[str, ...]] = {
    "opportunities": ("title",),
    "products": ("opportunity_id", "title", "created_at"),
    "transactions": (
        "transaction_id", "type", "product_id", "amount", "fee", "platform", "description", "occurred_at"),
    "agent_messages": ("from_agent", "to_agent", "type", "payload", "created_at"),
    "market_insights": ("category", "title", "source", "created_at"),
}

# Tables kept in one folder per day of a column, so that a recent window reads recent days only.
BY_DAY = {"transactions": "occurred_at"}
DAY = "day"

OPPORTUNITY_TYPES = ("digital_product", "freelance", "affiliate", "service")
ALLOWED: dict[str, dict[str, tuple[str, ...]]] = {
    "opportunities": {"status": ("pending", "in_progress", "listed", "sold", "failed")},
    "products": {"status": ("draft", "listed", "unlisted")},
    "transactions": {"type": ("sale", "refund", "expense")},
    "agent_messages": {},
    "market_insights": {},
}
INSIGHT_CATEGORIES = ("trend", "competitor", "keyword", "niche")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to exactly ``schema``: declared order and types, missing columns as NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def moment(as_of: str) -> Column:
    """A literal point in time; every "now" in this library is an explicit argument."""
    return F.lit(as_of).cast("timestamp")


def row_id(*parts: Column) -> Column:
    """An id from the content of a row: 60 bits of a digest, the same at each run.

    Each part has its length before it, so no two lists of parts read alike.
    """
    texts = [p.cast("string") for p in parts]
    text = F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_defaults(df: DataFrame, table: str, as_of: str) -> DataFrame:
    """Rows ready for insert into ``table``: full schema, NULLs replaced by the column defaults, ids by the content's."""
    fills: dict[str, Column] = {c: F.lit(v) for c, v in DEFAULTS[table].items()}
    fills |= {c: moment(as_of) for c in INSERT_TIMES[table]}
    schema = TABLES[table]
    rows = conform(df, schema).select(*[
        F.coalesce(F.col(f.name), fills[f.name].cast(f.dataType)).alias(f.name)
        if f.name in fills else F.col(f.name)
        for f in schema
    ])
    return rows.withColumn("id", F.coalesce("id", row_id(*map(F.col, IDENTITY[table]))))
