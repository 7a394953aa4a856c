"""Table changes as transforms: each returns the new state, and the job writes it elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import money
from ledgerloom.functions.text import not_empty
from ledgerloom.operators.filters import paid_orders
from ledgerloom.operators.joins import distinct_keys, new_keys, new_titles, not_in_ledger
from ledgerloom.operators.windows import first_orders
from ledgerloom.schemas import FINE_MONEY, MONEY, TABLES, conform, moment, row_id
from ledgerloom.sinks.tables import stage
from ledgerloom.workspace import staged


def touch(changed: Column, as_of: str) -> Column:
    """``updated_at`` of a row after a change; rows never changed show their creation time."""
    return F.when(changed, moment(as_of)).otherwise(F.coalesce("updated_at", "created_at"))


def with_status(df: DataFrame, changed_ids: DataFrame, status: str, as_of: str) -> DataFrame:
    """``status`` set on the rows named by the unique ``id`` of ``changed_ids``."""
    marked = df.join(changed_ids.withColumn("changed", F.lit(True)), "id", "left")
    changed = F.coalesce("changed", F.lit(False))
    return marked.withColumns({
        "status": F.when(changed, F.lit(status)).otherwise(F.col("status")),
        "updated_at": touch(changed, as_of),
    }).drop("changed")


def drain_mailbox(messages: DataFrame, agents: list[str]) -> DataFrame:
    """Mailbox after ``agents`` read it in order: the first of them takes the broadcasts."""
    to = F.col("to_agent")
    reader = F.when(to.isin(*agents), to).when(to.isNull(), F.lit(agents[0]))
    delivered = F.when(F.col("read") == 0, reader)
    return messages.withColumn("delivered_to", delivered).withColumn(
        "read", F.when(F.col("delivered_to").isNotNull(), F.lit(1)).otherwise(F.col("read"))
    )


def products_created(opportunities: DataFrame, new_products: DataFrame, as_of: str) -> DataFrame:
    """Opportunities after products were drafted for them."""
    parents = distinct_keys(new_products, "opportunity_id", "id")
    return with_status(opportunities, parents, "in_progress", as_of)


def products_listed(products: DataFrame, published: DataFrame, as_of: str) -> DataFrame:
    """Products after publishing: ``published`` has the listings, of which the last by ``request_id`` counts."""
    last = published.groupBy(F.col("product_id").alias("id")).agg(F.max(F.struct(
        "request_id", "platform_id", "platform_url", "title", "description", "price_cents")).alias("last"))
    listing = last.select(
        "id", *[F.col(f"last.{c}").alias(f"new_{c}") for c in ("platform_id", "platform_url", "title", "description")],
        money.cents_to_amount(F.col("last.price_cents")).alias("new_price"), F.lit(True).alias("changed"),
    )
    changed = F.coalesce("changed", F.lit(False))
    joined = products.join(listing, "id", "left")
    replaced = ("platform_id", "platform_url", "title", "description", "price")
    return joined.withColumns(
        {c: F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in replaced}
        | {
            "status": F.when(changed, F.lit("listed")).otherwise(F.col("status")),
            "updated_at": touch(changed, as_of),
        }
    ).select(*products.columns)


def parents_listed(opportunities: DataFrame, products: DataFrame, published: DataFrame, as_of: str) -> DataFrame:
    """Opportunities after some of their products were published."""
    ids = published.select(F.col("product_id").alias("id"))
    parents = distinct_keys(products.join(ids, "id", "left_semi"), "opportunity_id", "id")
    return with_status(opportunities, parents, "listed", as_of)


def sale_rows(orders: DataFrame) -> DataFrame:
    """Marketplace orders as ledger rows."""
    amount = money.cents_to_amount(F.col("amount"))
    fee = money.order_fee(amount)
    rows = orders.select(
        row_id(F.col("id")).alias("id"), amount.alias("amount"), fee.alias("fee"), money.net_amount(F.lit("sale"), amount, fee).alias("net"),
        F.lit("polar").alias("platform"), F.col("id").alias("transaction_id"), F.lit("sale").alias("type"),
        F.col("product_name").alias("description"), F.col("created_at").alias("occurred_at"),
    )
    return conform(rows, TABLES["transactions"])


def ledger_sync(orders: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows to append: paid orders, once each, that the ledger does not have.

    Rows are keyed by ``transaction_id``; appending the result and syncing again yields nothing.
    """
    return sale_rows(not_in_ledger(first_orders(paid_orders(orders)), ledger))


def ledger_sync_batch(orders: DataFrame, ledger: DataFrame, folder: str) -> DataFrame:
    """``ledger_sync`` for orders that are few beside the ledger, which is then not shuffled.

    The ledger rows of the orders are staged in ``folder``.
    """
    batch = stage(sale_rows(first_orders(paid_orders(orders))), folder)
    return new_keys(batch, ledger, "transaction_id")


def sync_summary(orders: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a sync fetched, what of it is new or rejected for want of an id, and the totals of the fetched orders."""
    per_id = paid_orders(orders).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("gross"),
        F.sum(money.net_cents(F.col("amount"))).alias("net"),
    )
    known = distinct_keys(ledger, "transaction_id", "id").withColumn("known", F.lit(True))
    sums = per_id.join(known, "id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"),
        F.count(F.when(F.col("known").isNull() & F.col("id").isNotNull(), 1)).alias("inserted"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum("gross"), F.lit(0)).alias("gross"),
        F.coalesce(F.sum("net"), F.lit(0)).alias("net"),
    )
    return sums.select(
        "fetched", "inserted", "rejected", (F.col("gross") / 100).alias("gross"),
        F.greatest(F.lit(0.0), F.col("net") / 100).alias("net"),
    )


def logged_rows(entries: DataFrame) -> DataFrame:
    """Logged entries (product_id, amount, fee, type, description, platform) as ledger rows.

    An entry that brings no id gets one from its content as it is appended.
    """
    amount, fee = F.col("amount").cast(MONEY), F.col("fee").cast(FINE_MONEY)
    net = money.net_amount(F.col("type"), amount, fee)
    return conform(
        entries.withColumns({"net": net, "platform": not_empty(F.col("platform"))}), TABLES["transactions"]
    )


def expense_rows(expenses: DataFrame) -> DataFrame:
    """Logged expenses (amount, description, category) as ledger rows."""
    return logged_rows(expenses.select(
        F.lit(None).alias("product_id"), "amount", F.lit(0).alias("fee"), F.lit("expense").alias("type"),
        "description", F.coalesce(not_empty(F.col("category")), F.lit("general")).alias("platform"),
    ))


# Estimates are per month in dollars, scores per thousand; 500 is the default estimate.
DEFAULT_ESTIMATE = 500


def insight_score(estimate: Column) -> Column:
    return F.coalesce(money.usd(estimate), F.lit(float(DEFAULT_ESTIMATE))) / 1000


def identified(rows: DataFrame, known: DataFrame, bits: int = 60) -> DataFrame:
    """``rows`` of different titles, each with an id that no other of them and no row of ``known`` has.

    A row keeps the id it brings. Without one it gets an id from its title, so a second run gives the same. Where several rows
    have one id, or a known one, the first by title that brought it keeps it and the others are hashed anew with the number of the
    turn, until none meet; the rows that had to change are few, and each turn joins ids only. ``bits`` of the hash are used.
    """
    def hashed(turn: int) -> Column:
        parts = [F.col("title")] if turn == 0 else [F.col("title"), F.lit(turn)]
        return F.pmod(row_id(*parts), F.lit(1 << bits))

    has_id = "id" in known.columns
    taken = distinct_keys(known, "id", "taken_id") if has_id else None
    given = rows.withColumn("made", F.col("id").isNull())
    settled, turn = [], 0
    given = given.withColumn("id", F.coalesce("id", hashed(0)))
    while True:
        given = staged(given, "ids")
        # the ids of this turn, whose they are, and whether an earlier turn or the table has them
        owner = given.groupBy(F.col("id").alias("own_id")).agg(
            F.min(F.struct("made", "title")).alias("owner"), F.count("*").alias("n"))
        earlier = [s.select(F.col("id").alias("taken_id")) for s in settled] + ([taken] if has_id else [])
        if earlier:
            used = reduce(DataFrame.unionAll, earlier)
            owner = owner.join(used.withColumn("used", F.lit(True)), F.col("own_id") == F.col("taken_id"), "left")
        else:
            owner = owner.withColumn("used", F.lit(None).cast("boolean"))
        met = staged(owner.where("n > 1 OR used").select("own_id", "owner", F.coalesce("used", F.lit(False)).alias("used")), "met")
        if met.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, given]).drop("made")
        own = F.col("used").isNull() | (~F.col("used") & (F.struct("made", "title") == F.col("owner")))
        judged = staged(given.join(met, F.col("id") == F.col("own_id"), "left").withColumn("own", own), "judged")
        settled.append(judged.where("own").select(*given.columns))
        turn += 1
        given = judged.where("NOT own").select(*given.columns).withColumns({"id": hashed(turn), "made": F.lit(True)})


def new_opportunities(found: DataFrame, known: DataFrame) -> DataFrame:
    """The found opportunities of unknown title, once each, under the ids that all their records have."""
    return identified(new_titles(found, known), known)


def opportunity_records(fresh: DataFrame) -> DataFrame:
    """Of identified opportunities, the row, the task and the insight that go with each, tagged by ``kind``.

    The three records come from one pass over the rows. A description goes with the opportunity.
    """
    estimate = F.coalesce(money.usd(F.col("estimated_revenue")), F.lit(float(DEFAULT_ESTIMATE)))
    audience = F.coalesce("target_audience", F.lit(""))
    metadata = F.struct(
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        audience.alias("target_audience"),
    )
    task = F.struct(
        F.lit("create_product").alias("task"), F.col("id").alias("opportunityId"), "title", "type"
    )
    insight = F.struct("type", audience.alias("audience"))
    description = F.col("description") if "description" in fresh.columns else F.lit(None).cast("string")

    def record(kind: str, sender: str | None, body: Column, value: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(sender).cast("string").alias("source"),
            F.to_json(body).alias("body"), value.cast("double").alias("value"), text.alias("description"),
        )

    nothing = F.lit(None).cast("string")
    records = F.array(
        record("opportunity", None, metadata, estimate, description),
        record("message", "scanner", task, F.lit(None), nothing),
        record("insight", "scanner", insight, estimate / 1000, nothing),
    )
    return fresh.select("id", "title", "type", F.explode(records).alias("r")).select("id", "title", "type", "r.*")


def ingest_opportunities(found: DataFrame, known: DataFrame) -> DataFrame:
    """New opportunities, and the task and the insight that go with each, tagged by ``kind``.

    ``found`` has id, which may be NULL, type, title, estimated_revenue, difficulty, target_audience and keywords.
    """
    return opportunity_records(new_opportunities(found, known)).drop("description")


def ingested(found: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """The records of ``ingest_opportunities`` as rows to append, by table; ``found`` has a description too.

    The identified rows are written once, so the three tables agree on every id.
    """
    records = opportunity_records(staged(new_opportunities(found, known), "new-opportunities"))
    of_kind = {kind: records.where(F.col("kind") == kind) for kind in ("opportunity", "message", "insight")}
    opportunities = of_kind["opportunity"].select(
        "id", "type", "title", "description", F.col("value").cast(MONEY).alias("estimated_revenue"),
        F.col("body").alias("metadata"))
    messages = of_kind["message"].select(
        F.col("source").alias("from_agent"), F.lit("content").alias("to_agent"), F.lit("task").alias("type"),
        F.col("body").alias("payload"))
    insights = of_kind["insight"].select(
        F.lit("opportunity").alias("category"), "title", F.col("body").alias("data"),
        F.col("value").cast(MONEY).alias("score"), "source")
    return {"opportunities": opportunities, "agent_messages": messages, "market_insights": insights}


# messages that table changes give rise to


def _messages(df: DataFrame, sender: str, to: str | None, kind: str, body: Column) -> DataFrame:
    return df.select(
        F.lit(sender).alias("from_agent"), F.lit(to).cast("string").alias("to_agent"),
        F.lit(kind).alias("type"), F.to_json(body).alias("payload"),
    )


def listed_messages(products: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit("product_listed").alias("event"), F.col("id").alias("productId"), F.col("platform_url").alias("url"),
        money.usd(F.col("price")).alias("price"), "platform",
    )
    return _messages(products.where(F.col("status") == "listed"), "sales", "finance", "event", body)


def created_messages(products: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit("list_product").alias("task"), F.col("id").alias("productId"), "title", "description",
        money.amount_to_cents(F.col("price")).alias("price"), F.col("file_path").alias("filePath"),
    )
    return _messages(products.where(F.col("status") == "draft"), "content", "sales", "task", body)


def published_messages(posts: DataFrame) -> DataFrame:
    """Broadcast of published posts; ``posts`` has title, url, status and tags."""
    return _messages(
        posts.where(F.col("status") == "published"), "blog", None, "published", F.struct("title", "url", "tags")
    )


def recommendation_messages(recommendations: DataFrame) -> DataFrame:
    body = F.struct("action", "reason", "priority")
    return _messages(recommendations, "analytics", "orchestrator", "recommendation", body)


def opportunity_messages(opportunities: DataFrame) -> DataFrame:
    """The creation task of each opportunity, as posted to the mailbox of the maker."""
    body = F.struct(
        F.lit("create_product").alias("task"), F.col("id").alias("opportunityId"), "title", "description",
        "platform", F.from_json("metadata", "keywords array<string>").alias("metadata"),
    )
    return _messages(opportunities, "scanner", "content", "task", body)


def event_messages(products: DataFrame, posts: DataFrame, recommendations: DataFrame) -> DataFrame:
    parts = (
        listed_messages(products), created_messages(products), published_messages(posts),
        recommendation_messages(recommendations),
    )
    return reduce(DataFrame.unionByName, parts)
