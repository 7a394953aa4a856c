import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers_llm import pseudo_words
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerloom.llm import lines

SPACES = " \t\n\x0b\f\r"
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(docs, least=10, keep_first=False, least_chars=1):
    found, first = defaultdict(set), {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    for i in order:
        for at, line in enumerate((docs[i][1] or "").split("\n")):
            key = line.strip(SPACES).translate(UPPER)
            found[key].add(i)
            first.setdefault(key, (i, at))
    out = []
    for i, (doc, text) in enumerate(docs):
        all_lines, kept = (text or "").split("\n"), []
        for at, line in enumerate(all_lines):
            key = line.strip(SPACES).translate(UPPER)
            gone = len(key) >= least_chars and len(found[key]) >= least
            if not gone or (keep_first and first[key] == (i, at)):
                kept.append(line)
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(map(tuple, lines.applied(df, lines.keep_bitmaps(df, **options)).collect()), key=repr)


def test_common_lines_go_and_others_stay(documents):
    docs = [(i, f"Menu \n{' '.join(pseudo_words(5, i))}\n\t MENU\x0b\nfoot{i % 3}\n\nÀ propos") for i in range(30)]
    docs += [(100 + i, f"à propos\nnine\n{i}") for i in range(9)] + [(200, None), (201, ""), (202, "\n\n"), (203, " menu")]
    docs += [(204, "menu\n" * 50), (205, "twice\ntwice"), (206, "menu\r\n menu")]
    assert found(documents(docs, clashes=True)) == brute(docs)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("partitions", [1, 7])
def test_a_line_of_most_rows_crosses_ranges(spark, documents, keep_first, partitions):
    docs = [(i, f"hot\nown {i}\nhot\npair {i // 2}") for i in range(700)] + [(None, "hot\nnone"), (None, "hot")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions * 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for least in (2, 3, 10, 702, 703):
            df = documents(docs).repartition(4)
            assert found(df, least=least, keep_first=keep_first) == brute(docs, least, keep_first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_count_and_share_a_bitmap(documents):
    docs = [(1, "a\nb")] * 6 + [(None, "a\nc")] * 4 + [(2, "b")] + [(3, "x\na")]
    assert found(documents(docs)) == brute(docs)
    assert len(lines.keep_bitmaps(documents(docs)).collect()) == 4


def test_short_keys_stay(documents):
    docs = [(i, "ab\nabc\nàb") for i in range(4)]
    assert found(documents(docs), least=2, least_chars=3) == brute(docs, 2, False, 3)


def test_bitmaps_hold_a_bit_for_each_line(documents):
    df = documents([(i, "common\nown %d" % i) for i in range(10)])
    for r in lines.keep_bitmaps(df).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=r["n_lines"])
        assert bits.tolist() == [0, 1] and (r["n_lines"], r["n_dropped"]) == (2, 1)


def test_long_text_and_empty_table(documents):
    long = "\n".join(f"line {i % 1000}" for i in range(300_000))
    docs = [(1, long), (2, "line 5\nline 1000")]
    assert found(documents(docs), least=2) == brute(docs, 2)
    assert found(documents([])) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4) | st.none(), st.text("aAb \n", max_size=9)), max_size=30), st.integers(2, 4))
def test_random_documents(documents, docs, least):
    docs = list({(d, t): (d, t) for d, t in docs}.values())
    unique = [(i, t) for i, (_, t) in enumerate(docs)]
    assert found(documents(docs), least=least) == brute(docs, least)
    assert found(documents(unique), least=least, keep_first=True) == brute(unique, least, True)
