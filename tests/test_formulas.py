"""Column functions against plain Python on random values."""

import json
import os.path
import random
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, pace, text
from ledgerloom.operators.filters import has_email
from ledgerloom.schemas import moment
from ledgerloom.sources.tables import Shop

N = 3000
NOW = datetime(2024, 1, 31)


@pytest.fixture()
def rng():
    return random.Random(11)


def applied(spark, values, ddl, column):
    """``column`` over ``values``, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {ddl}")
    return [r[1] for r in df.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_money_is_rounded_and_grouped(spark, rng):
    shown = {0.0: "$0.00", 0.125: "$0.12", 0.375: "$0.38", 12.5: "$12.50", 1234.5: "$1,234.50", -0.5: "$-0.50",
             9999.99: "$9,999.99", 10000.0: "$10,000", 10000.49: "$10,000", 1234567.8: "$1,234,568", -19999.25: "$-19,999.25"}
    assert applied(spark, list(shown), "double", text.fmt_money) == list(shown.values())
    values = [round(rng.uniform(-20_000, 20_000), 4) for _ in range(N)]
    for value, text_of in zip(values, applied(spark, values, "double", text.fmt_money)):
        places = Decimal("0.01") if value < 10000 else Decimal(1)
        assert Decimal(text_of.replace("$", "").replace(",", "")) == Decimal(value).quantize(places, ROUND_HALF_EVEN)


def test_fees_like_float_arithmetic(spark, rng):
    cents = [rng.randint(0, 5_000_000) for _ in range(N)]
    assert applied(spark, cents, "bigint", money.net_cents) == [c - int(c * 0.04) - 40 for c in cents]
    fees = applied(spark, cents, "bigint", lambda c: money.order_fee(money.cents_to_amount(c)).cast("double"))
    assert fees == pytest.approx([c / 100 * 0.04 + 0.40 for c in cents], abs=1e-9)


def test_ages_like_timedelta(spark, rng):
    then = [NOW - timedelta(seconds=rng.choice([100, 10_000, 10_000_000]) * rng.random()) for _ in range(N)]

    def age(t):
        s = int((NOW - t).total_seconds())
        for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
            if s >= size:
                return f"{s // size}{unit} ago"
        return f"{s}s ago"

    got = applied(spark, [str(t) for t in then], "string", lambda c: text.fmt_age(c.cast("timestamp"), moment(str(NOW))))
    assert got == [age(t) for t in then]


def test_whole_days_like_timedelta(spark, rng):
    starts = [NOW + timedelta(seconds=rng.uniform(-1e7, 1e7)) for _ in range(N)]
    got = applied(spark, [str(t) for t in starts], "string", lambda c: pace.whole_days(c.cast("timestamp"), moment(str(NOW))))
    assert got == [(NOW - t).days for t in starts]


def test_texts_are_cut_by_character(spark, rng):
    values = ["".join(rng.choice("aé漢😀 ") for _ in range(rng.randint(0, 90))) for _ in range(N)]
    assert applied(spark, values, "string", lambda c: text.cut(c, 40)) == [v[:40] for v in values]
    assert applied(spark, values, "string", lambda c: text.shorten(c, 52)) == [
        v[:52] + ("…" if len(v) > 52 else "") for v in values]


def test_file_names_and_emails(spark, rng):
    values = ["".join(rng.choice("aB9_.-/ @é") for _ in range(rng.randint(1, 20))) for _ in range(N)]
    assert applied(spark, values, "string", text.safe_filename) == [re.sub("[^a-zA-Z0-9_.-]", "_", v) for v in values]
    assert applied(spark, values, "string", text.base_name) == [os.path.basename(v) for v in values]
    assert applied(spark, values, "string", has_email) == ["@" in v for v in values]


def test_brackets_are_the_outermost(spark, rng):
    values = ["".join(rng.choice("a[]\n") for _ in range(rng.randint(0, 8))) for _ in range(N)]

    def outermost(v):
        found = re.search(r"\[[\s\S]*\]", v)
        return found and found.group(0)

    assert applied(spark, values, "string", text.bracketed) == [outermost(v) for v in values]


def test_prompts_from_answers(spark, rng):
    def answer():
        items = [{"title": f"t{rng.randint(0, 9)}", "prompt": "p [x]"} for _ in range(rng.randint(0, 3))]
        around = rng.choice([("", ""), ("Here: ", ""), ("\n", "\n"), ("```json\n", "\n```")])
        return items, around[0] + json.dumps(items) + around[1]

    made = [answer() for _ in range(300)]
    got = applied(spark, [a for _, a in made], "string", text.prompt_list)
    assert [[r.asDict() for r in items] for items in got] == [items for items, _ in made]


def test_page_text_like_a_regex_over_the_whole_page(spark):
    pages = Shop(spark, "/root/testdata/sf0.001").pages
    odd = spark.createDataFrame([(-1, "u", "<p\n class='x'>a\u00a0\u2003b</p>\ufeff\t<br/>\u3000c < d")], pages.schema)
    for r in pages.unionByName(odd).select("html", text.html_to_text(F.col("html")).alias("t")).collect():
        # Python's white space, less the separators and NEL that web pages do not count, plus the BOM.
        space = r"[^\S\x1c-\x1f\x85]|\ufeff"
        want = re.sub(rf"(?:{space})+", " ", re.sub("<[^>]+>", " ", r.html)).strip(" ")
        assert r.t == want
