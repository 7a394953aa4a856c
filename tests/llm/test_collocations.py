import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import pseudo_words
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import collocations as co

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(docs, least=10, most_words=3, percent=50, top=2000):
    """(text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    longer = Counter()
    candidates = [p for p, a in f.items() if len(p) > 2 and a >= least]
    for lang, *p in candidates:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                sub = (lang, *p[i:i + k])
                longer[sub] = max(longer[sub], f[lang, *p])
    rows = []
    for lang, *p in candidates:
        a = f[lang, *p]
        if 100 * longer[lang, *p] >= percent * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, *p[:k]], f[lang, *p[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        rows.append((lang, " ".join(p), a, left, right, n[lang], s))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def found(spark, docs, **options):
    df = spark.createDataFrame(docs, "text string, lang string")
    df = df.withColumns({c: F.lit(c) for c in ("chunk", "word", "w1", "n", "f", "id", "rank")})
    return sorted(map(tuple, co.collocations(df, **options).collect()))


def invented(n, seed, vocabulary=30):
    r, words = random.Random(seed), pseudo_words(vocabulary, 1)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return ["".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n"]) for w in r.choices(words, weights, k=80)) for _ in range(n)]


def test_phrases_of_several_languages(spark, monkeypatch):
    docs = [(t if i % 2 else t.upper(), ["en", "fr", None, "und"][i % 4]) for i, t in enumerate(invented(60, 2))]
    docs += [("New York city hall! " * 30, "en"), ("à la carte É x x x x" * 12, "fr"), (None, "en"), ("", None), (" . ", "de")]
    assert found(spark, docs) == brute(docs)
    assert found(spark, docs, least=3, top=7, percent=30) == brute(docs, 3, 3, 30, 7)


@pytest.mark.parametrize("most_words", [2, 4, 5])
def test_longer_phrases(spark, most_words):
    docs = [(t, "en") for t in invented(25, 5, 8)] + [("one two three four five six. " * 11, "en")]
    assert found(spark, docs, most_words=most_words) == brute(docs, most_words=most_words)


def test_overlapping_repeats_and_equal_rows(spark):
    docs = [("ha " * 15, "en")] * 2 + [("b a b a b a " * 5, "en"), ("b a", "en")]
    assert found(spark, docs) == brute(docs)


def test_many_chunks_give_the_same(spark, monkeypatch):
    docs = [(t, "en") for t in invented(40, 9)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(17)
    assert sorted(map(tuple, co.collocations(df).collect())) == brute(docs)


def test_empty_table_and_very_long_text(spark):
    assert found(spark, []) == []
    docs = [(" ".join(invented(2500, 3, 200)), "en")]
    assert found(spark, docs, least=200) == brute(docs, least=200)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**12 + 1, 10**12 + 9), (10**9, 10**9, 10**9), (3, 7, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(co.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1000000 * a * a // (x * y) for a, x, y in rows]


@pytest.mark.parametrize("spread", [5, 3000, 200_000])
def test_tiles_count_as_a_table_does(spread):
    r = np.random.default_rng(1)
    a, b = (np.minimum((r.pareto(0.7, 150_000) * 3).astype(np.int64), spread) for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist()))
    x, y, n = co.tile_counts(a, b)
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == want


@settings(max_examples=50, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_numbers_come_back(numbers):
    assert co.unpack(co.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_a_chunk_gives_its_pairs_in_small_batches():
    tokens = np.arange(1, 3 * co.ROWS + 2)
    batch = pa.RecordBatch.from_pydict({"chunk": [7], "data": [co.pack(tokens)]})
    out = list(co.pair_rows(1)(iter([batch])))
    assert [b.num_rows for b in out] == [co.ROWS] * 3
    assert pa.Table.from_batches(out).column("w2").to_pylist() == tokens[:-1].tolist() and out[0].column("w1")[0].as_py() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_rows_beside_chunks_come_in_batches_of_any_size(size):
    rows = {"chunk": [], "data": [], "at": [], "id": []}
    for chunk, n in [(4, 5), (5, 0), (6, 1), (9, 0)]:
        for column, values in zip(rows.values(), ([chunk] * (n + 1), [co.pack(np.array([chunk, 0]))] + [None] * n,
                                                  [None, *range(n)], [None, *range(10, 10 + n)])):
            column += values
    schema = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("at", pa.int64()), ("id", pa.int64())])
    batches = pa.Table.from_pydict(rows, schema).to_batches(max_chunksize=size)
    found = [(c, t.tolist(), a.tolist(), i.tolist()) for c, t, (a, i) in co.chunks_beside(iter(batches), ["at", "id"])]
    assert found == [(4, [4, 0], [0, 1, 2, 3, 4], [10, 11, 12, 13, 14]), (6, [6, 0], [0], [10])]
