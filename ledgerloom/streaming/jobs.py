"""The polls as Structured Streaming jobs.

Each job processes what is available and stops. ``folder`` holds the checkpoint and the output,
must be shared by all executors, and belongs to one job: starting again continues from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import money
from ledgerloom.operators import aggregates, windows
from ledgerloom.operators.filters import has_email, paid_orders
from ledgerloom.operators.mutations import sale_rows
from ledgerloom.operators.windows import ORDER_RANK, ranked
from ledgerloom.schemas import FINE_MONEY
from ledgerloom.sources.payloads import order_rows, rejected

BEFORE_ANY_BATCH = -1
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _output(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/out")


def _drive(
    stream: DataFrame, folder: str, schema: T.StructType,
    write: Callable[[DataFrame, int], None], mode: str = "append",
) -> None:
    # An empty first batch, so that the output can be read before anything arrived.
    empty = stream.sparkSession.createDataFrame([], schema)
    empty.write.mode("overwrite").parquet(f"{folder}/out/batch_id={BEFORE_ANY_BATCH}")
    _run(stream, folder, write, mode)


def _run(
    stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append",
) -> StreamingQuery:
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    return query


def write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    """One folder per batch, replaced when the batch is retried."""
    rows.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")


def mailbox(messages: DataFrame, agent: str, folder: str) -> DataFrame:
    """Messages for ``agent``, broadcasts included, delivered once.

    The checkpoint stands for the read flag: each recipient has its own, so a broadcast reaches
    everyone.
    """
    mine = (F.col("to_agent") == agent) | F.col("to_agent").isNull()
    unread = messages.where(mine & (F.col("read") == 0)).select("id", "from_agent", "type", "payload", "created_at")
    _drive(unread, folder, unread.schema, lambda rows, n: write_batch(rows, folder, n))
    return _output(messages.sparkSession, folder, unread.schema).drop("batch_id")


def mailboxes(messages: DataFrame, recipients: DataFrame, folder: str) -> DataFrame:
    """The mail of all ``recipients`` (agent), each message once for each of them it is for, broadcasts for all.

    One stream reads the messages once and meets the recipients, who are listed twice: under their name, and under none for
    broadcasts. One checkpoint stands for the read flags. A batch is written in a folder for each recipient, so reading a
    mailbox reads its own files. A recipient who joins later gets what arrives from then on; mail for others is left out.
    """
    known = recipients.select(F.col("agent").alias("recipient")).where(F.col("recipient").isNotNull()).distinct()
    boxes = known.withColumn("box", F.col("recipient")).unionAll(known.withColumn("box", F.lit(None).cast("string")))
    mail = messages.where(F.col("read") == 0).join(boxes, F.col("to_agent").eqNullSafe(F.col("box"))).select(
        "id", "from_agent", "type", "payload", "created_at", "recipient")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("recipient").parquet(f"{folder}/out/batch_id={batch_id}")

    write(messages.sparkSession.createDataFrame([], mail.schema), BEFORE_ANY_BATCH)
    _run(mail, folder, write)
    return _output(messages.sparkSession, folder, mail.schema).select(*mail.columns)


def drain_order(messages: DataFrame, folder: str) -> DataFrame:
    """Unread messages numbered within their recipient's mailbox, in order of arrival by batches and of age inside one.

    The next free number of each mailbox is a table of one row for each, written anew with each batch from that of the batch before, so
    a retry counts nothing twice. Numbers never change: where messages arrive in order of age they are those of
    ``windows.drain_positions`` over all of them; one that arrives late gets the next number, after younger ones.
    """
    spark = messages.sparkSession
    totals = T.StructType([T.StructField("to_agent", T.StringType()), T.StructField("n", T.LongType())])

    def place(batch_id: int) -> str:
        return f"{folder}/totals/batch-{batch_id}"

    def write(rows: DataFrame, batch_id: int) -> None:
        ranks = windows.drain_positions(rows, f"{folder}/ranks/batch-{batch_id}")
        before = spark.read.schema(totals).parquet(place(batch_id - 1))
        box, n = F.col("to_agent").eqNullSafe(F.col("box")), F.coalesce("n", F.lit(0))
        out = ranks.join(before.withColumnRenamed("to_agent", "box"), box, "left").withColumn("position", F.col("position") + n)
        write_batch(out.drop("box", "n"), folder, batch_id)
        counts = ranks.groupBy("to_agent").agg(F.count("*").alias("n"))
        after = before.unionAll(counts).groupBy("to_agent").agg(F.sum("n").alias("n"))
        after.write.mode("overwrite").parquet(place(batch_id))

    spark.createDataFrame([], totals).write.mode("overwrite").parquet(place(BEFORE_ANY_BATCH))
    shape = messages.select("id", "to_agent", "from_agent", "type", "created_at").schema.add("position", T.LongType())
    _drive(messages, folder, shape, write)
    return _output(spark, folder, shape).drop("batch_id")


def rejected_payloads(payloads: DataFrame, kind: str, folder: str) -> DataFrame:
    """The payloads of a stream that can't be read, as they came; the side channel of the jobs that read the others."""
    bad = rejected(payloads, kind)
    _drive(bad, folder, bad.schema, lambda rows, n: write_batch(rows, folder, n))
    return _output(payloads.sparkSession, folder, bad.schema).drop("batch_id")


def order_sync(payloads: DataFrame, folder: str) -> DataFrame:
    """Ledger rows of paid orders, once per order however late it repeats.

    The first order of an id is kept as in a batch, so the result doesn't depend on how the orders are split into
    batches. The state, one order per id, is a store on the executors' disks under the checkpoint: a batch touches its
    own ids only, whatever the history holds. It writes those ids' first orders, and the last word on an id is
    the best of what was written.
    """
    orders = paid_orders(order_rows(payloads)).where(F.col("id").isNotNull())
    rank = ranked(orders, "id", ORDER_RANK)
    first = orders.groupBy("id").agg(F.min(rank).alias("first"))
    _drive(first, folder, first.schema, lambda rows, n: write_batch(rows, folder, n), "update")
    written = _output(payloads.sparkSession, folder, first.schema)
    kept = written.groupBy("id").agg(F.min("first").alias("first"))
    return sale_rows(kept.select(*[F.col(c) if c == "id" else F.col(f"first.{c}") for c in orders.columns]))


def lead_capture(leads: DataFrame, folder: str, at: str | None = None, horizon: str | None = None) -> DataFrame:
    """Valid email addresses, once each; the state holds the addresses on disk, and a batch looks up its own.

    By default an address is remembered for ever. With a time column ``at`` and a ``horizon``, such as ``30 days``, the state keeps
    an address until the newest time seen is so much later; one that comes back after that is captured again.
    """
    valid = leads.where(has_email(F.col("email")))
    if at is None:
        emails = valid.select("email").dropDuplicates(["email"])
    else:
        emails = valid.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["email"]).select("email")
    _drive(emails, folder, emails.schema, lambda rows, n: write_batch(rows, folder, n))
    return _output(leads.sparkSession, folder, emails.schema).drop("batch_id")


def _newest_batch(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    out = _output(spark, folder, schema)
    return out.where(F.col("batch_id") == out.select(F.max("batch_id")).scalar()).drop("batch_id")


def agent_state(runs: DataFrame, folder: str) -> DataFrame:
    """Running fold of the log of state writes; the state is one row per agent."""
    state = aggregates.agent_state(runs)
    _drive(state, folder, state.schema, lambda rows, n: write_batch(rows, folder, n), "complete")
    return _newest_batch(runs.sparkSession, folder, state.schema)


def daily_metrics(
    transactions: DataFrame, opportunities: DataFrame, products: DataFrame, folder: str,
) -> DataFrame:
    """All daily figures as a maintained table, from the streams of what they count.

    The state is one row for each day, on disk; what is late changes its day. A batch gives out the days it has changed
    with all their figures, and they replace these days' folders of the table, so the others keep their files and a retry
    writes the same.
    """
    days = aggregates.daily_metrics(transactions, opportunities, products)

    def replace(rows: DataFrame, _: int) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date").parquet(f"{folder}/table")

    spark = transactions.sparkSession
    replace(spark.createDataFrame([], days.schema), BEFORE_ANY_BATCH)
    _run(days, folder, replace, "update")
    return spark.read.schema(days.schema).parquet(f"{folder}/table").select(*days.columns)


def daily_sales(purchases: DataFrame, folder: str) -> DataFrame:
    """Sales and revenue per day of (``at``, ``value``); the state is one row per day.

    Every day is kept and reported, so a sale counts however late it arrives.
    """
    days = (
        purchases.groupBy(F.window("at", "1 day").alias("day"))
        .agg(F.count("*").alias("sales_count"), F.sum("value").cast(FINE_MONEY).alias("revenue"))
        .select(F.to_date("day.start").alias("date"), "sales_count", money.usd(F.col("revenue")).alias("revenue"))
    )
    _drive(days, folder, days.schema, lambda rows, n: write_batch(rows, folder, n), "complete")
    return _newest_batch(purchases.sparkSession, folder, days.schema)
