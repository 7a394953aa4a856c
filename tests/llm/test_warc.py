import base64
import gzip
import hashlib

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.files import located


def archived(spark, folder, rows, size=64, least=0, clashes=False):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if clashes:
        pages = pages.selectExpr("*", "'own' AS payload", "'own' AS sha1", "1 AS chunk", "2 AS row_id", "3 AS refers_to")
    return warc.write_archives(warc.planned(pages, least, size), folder)


ROWS = [(1, "http://a/ b", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "u", "é" * 1000), (5, "v", "<p>one</p>"),
        (6, "w", "é" * 1000), (7, "x\r\ny", "WARC/1.1\r\n\r\nend"), (None, "n", "<p>one</p>"), (None, "n", "alone"),
        (8, "r", "twice"), (8, "r", "twice"), (9, "z", "x" * 64), (10, "z", "x" * 65)]


@pytest.mark.parametrize("size", [1, 64, 1 << 18])
def test_round_trip(spark, folder, size):
    archives = archived(spark, folder, ROWS, size, clashes=True)
    chunks = warc.read_chunks(archives, size).collect()
    assert sum(r.n_records for r in archives.collect()) == len(ROWS) == sum(c.is_last for c in chunks)
    assert all(len(c.data) <= size for c in chunks)
    stored = {}
    for c in sorted(chunks, key=lambda c: (c.archive, c.record, c.chunk)):
        stored[c.archive, c.record] = stored.get((c.archive, c.record), b"") + c.data
    for c in chunks:
        if c.is_last and c.record_type == "response":
            data = stored[c.archive, c.record]
            assert c.payload_bytes == len(data)
            assert c.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    texts = {c.page_id: stored[c.archive, c.record].decode() for c in chunks if c.is_last and c.record_type == "response"}
    assert texts == {3: "", 5: "<p>one</p>", 6: "é" * 1000, 7: "WARC/1.1\r\n\r\nend", None: "alone", 8: "twice",
                     9: "x" * 64, 10: "x" * 65}
    revisits = sorted((str(c.page_id), c.refers_to, c.payload_bytes) for c in chunks if c.record_type == "revisit")
    assert revisits == [("1", 5, 10), ("2", 3, 0), ("4", 6, 2000), ("None", 5, 10)]


def test_small_payloads_are_stored_each(spark, folder):
    got = warc.read_chunks(archived(spark, folder, ROWS, least=11), last_only=True).collect()
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == [4]


def test_archive_is_gzip_with_plain_headers(spark, folder):
    (path,) = [r.path for r in archived(spark, folder, [(7, "http://a/", "hi")]).collect()]
    text = gzip.open(located(path)[1]).read().decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\nhi\r\n\r\n")


def test_damaged_archive_is_refused(spark, folder):
    (path,) = [r.path for r in archived(spark, folder, [(7, "http://a/", "hi there")]).collect()]
    place = located(path)[1]
    data = gzip.open(place).read().replace(b"hi there", b"hi thera")
    with gzip.open(place, "wb") as f:
        f.write(data)
    with pytest.raises(ValueError, match="doesn't match"):
        list(warc.records_of(path, 64))


def test_no_whole_payload_is_shuffled(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (i * 1000)) for i in range(60)] + [(99, "v", "x" * 9000)],
                                  "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = warc.planned(pages, size=500)
        text = df._jdf.queryExecution().optimizedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    join = next(i for i, line in enumerate(text.split("\n")) if "Join LeftOuter" in line)
    assert any("Generate explode" in line for line in text.split("\n")[join + 1:])  # cut below the join
    assert "payload#" not in text.split("\n")[join - 1]
    assert max(len(r.data or b"") for r in rows) == 500
    chunks = [(r.row_id, r.chunk) for r in rows]
    assert len(chunks) == len(set(chunks)) and {r.refers_to for r in rows if not r.is_response} == {99}


def test_a_payload_above_one_batch(spark, folder):
    text = "".join(chr(97 + i % 26) for i in range(1000)) * 20_000  # 20 MB
    archives = archived(spark, folder, [(1, "u", text), (2, "v", "small"), (3, "w", text)], 1 << 18)
    got = {r.page_id: r for r in warc.read_chunks(archives, last_only=True).collect()}
    assert {k: (r.record_type, r.payload_bytes, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", len(text), 3), 2: ("response", 5, None), 3: ("response", len(text), None)}
    assert got[3].payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_null_ids_only(spark, folder):
    got = warc.read_chunks(archived(spark, folder, [(None, "u", "same")] * 3), last_only=True).collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * 3


def test_empty_table(spark, folder):
    assert warc.read_chunks(archived(spark, folder, [])).count() == 0
