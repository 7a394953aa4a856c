"""Stored tables: checked appends, changes of parts, and lookups."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import mutations
from ledgerloom.schemas import TABLES, conform
from ledgerloom.sinks import tables
from ledgerloom.sources.tables import Shop, load, lookup
from ledgerloom.streaming import jobs

ROOT = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"


def opportunities(spark, *records):
    return spark.createDataFrame(list(records), "id long, type string, title string, status string")


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_violations_are_counted_as_rows_are_written(spark, folder):
    df = opportunities(spark, (1, "t", "a", None), (2, None, "b", "odd"), (3, None, None, "sold"))
    assert tables.append(df, folder, "opportunities", AS_OF) == {"type is null": 2, "title is null": 1, "status not allowed": 1}
    assert load(spark, folder, "opportunities").count() == 3
    assert tables.append(df.where("id = 1"), folder, "opportunities", AS_OF, {"type": ("u",)})["type not allowed"] == 1


@pytest.mark.parametrize("table, rows, columns", [
    ("opportunities", [(1, "t", "a"), (2, "t", None)], "id long, type string, title string"),
    ("transactions", [(1, None, "x")], "id long, amount decimal(18,2), transaction_id string"),
])
def test_a_refused_batch_leaves_nothing(spark, folder, table, rows, columns):
    with pytest.raises(Exception, match="is null"):
        tables.append(spark.createDataFrame(rows, columns), folder, table, AS_OF, refuse=True)
    assert not files(f"{folder}/{table}")


def test_rows_by_day_are_counted_once(spark, folder):
    df = spark.range(500).selectExpr("id", "if(id % 5 = 0, null, 1.5) AS amount", "1.0 AS net",
                                     "timestamp_seconds(id * 86400) AS occurred_at")
    assert tables.append(df, folder, "transactions", AS_OF) == {"amount is null": 100, "net is null": 0, "type not allowed": 0}


def test_a_change_rewrites_its_parts_only(spark, folder):
    products = Shop(spark, ROOT).products
    tables.write_parts(products, folder, "products", 64)
    before, ids = files(folder), [r.id for r in products.orderBy("id").limit(10).collect()]
    requests = spark.createDataFrame([(i, i, "new", "d", 100, "p", "u") for i in ids],
                                     "request_id long, product_id long, title string, description string, price_cents long, "
                                     "platform_id string, platform_url string")
    n = tables.change_parts(spark, folder, "products", requests.select(F.col("product_id").alias("id")),
                            lambda rows: mutations.products_listed(rows, requests, AS_OF), 64)
    after = files(folder)
    assert 1 <= n <= 10 and len(before - after) == n == len(after - before) and len(before & after) == len(before) - n
    got = tables.load_parts(spark, folder, "products").drop("part")
    want = mutations.products_listed(conform(products, TABLES["products"]), requests, AS_OF)
    stored = [c for c in want.columns if c != "updated_at"]  # derived for rows that were never changed
    assert sorted(map(str, got.select(stored).collect())) == sorted(map(str, want.select(stored).collect()))
    assert {r.id for r in got.where(F.col("updated_at") == F.lit(AS_OF).cast("timestamp")).collect()} == set(ids)


def test_no_keys_change_no_parts(spark, folder):
    tables.write_parts(Shop(spark, ROOT).products, folder, "products", 4)
    before = files(folder)
    keys = spark.createDataFrame([(None,)], "id long")
    assert tables.change_parts(spark, folder, "products", keys, lambda rows: rows, 4) == 0 and files(folder) == before


def scanned(df):
    """The rows that the scan of a plan gave out, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size() or plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_a_lookup_skips_row_groups_by_bloom_filters(spark, folder, monkeypatch):
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("title"))
    rows = conform(rows, TABLES["opportunities"]).repartition(4)
    keys = [r.title for r in rows.where("id IN (17, 40000)").collect()]
    spark.conf.set("parquet.block.size", str(1 << 17))
    spark.conf.set("parquet.enable.dictionary", "false")
    try:
        tables._write(rows, f"{folder}/with", "opportunities", "error")
        monkeypatch.setattr(tables, "LOOKUPS", {})
        tables._write(rows, f"{folder}/without", "opportunities", "error")
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.enable.dictionary")
    found = [lookup(spark, f"{folder}/{x}", "opportunities", "title", keys) for x in ("with", "without")]
    assert [sorted(r.id for r in df.collect()) for df in found] == [[17, 40000]] * 2
    assert scanned(found[0]) < scanned(found[1])


def test_state_of_leads_expires(spark, folder):
    def arrive(*rows):
        spark.createDataFrame(list(rows), "email string, at string").withColumn(
            "at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")

    seen = []
    run = jobs._run
    jobs._run = lambda *a, **k: seen.append(run(*a, **k)) or seen[-1]
    try:
        def capture(**options):
            leads = spark.readStream.schema("email string, at timestamp").parquet(f"{folder}/in")
            return sorted(r.email for r in jobs.lead_capture(leads, f"{folder}/{len(options)}", **options).collect())

        def state():
            return max(s["numRowsTotal"] for p in seen[-1].recentProgress[-1:] for s in p["stateOperators"])

        expiring = {"at": "at", "horizon": "1 day"}
        arrive(("a@x", "2024-01-01 00:00:00"), ("a@x", "2024-01-01 01:00:00"), ("b@x", "2024-01-01 02:00:00"), ("no", "2024-01-01"))
        assert capture(**expiring) == ["a@x", "b@x"] == capture()
        arrive(("c@x", "2024-02-01 00:00:00"), ("a@x", "2024-01-01 03:00:00"))
        assert capture(**expiring) == ["a@x", "b@x", "c@x"] == capture()
        arrive(("a@x", "2024-02-02 00:00:00"))
        assert capture(**expiring) == ["a@x", "a@x", "b@x", "c@x"]  # forgotten, so captured again
        assert state() <= 2
        assert capture() == ["a@x", "b@x", "c@x"]
        assert state() == 3
    finally:
        jobs._run = run
