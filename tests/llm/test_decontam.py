import random
from itertools import combinations

from helpers_llm import pseudo_words

from ledgerloom.llm import decontam


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items):
    """All pairs with a window of 12 aligned words, or a whole shorter item, that are 75 % equal; under six words, all."""
    found = set()
    for d, text in docs:
        for i, item in items:
            a, b = (text or "").lower().split(), (item or "").lower().split()
            n = min(12, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + q < len(a) and a[shift + q] == b[q] for q in range(len(b))]
                if n and any((4 if n >= 6 else 3) * sum(same[q:q + n]) >= 3 * n for q in range(len(b) - n + 1)):
                    found.add((d, i))
    return found


def test_every_window_with_up_to_three_substitutions_is_found(spark, documents):
    r = random.Random(3)
    items = [(i, " ".join(pseudo_words(12 + i % 20, i))) for i in range(25)]
    docs = []
    for n in range(120):
        words = items[n % 25][1].split()
        for at in r.sample(range(len(words)), n % 5):
            words[at] = "changed"
        docs.append((n, " ".join([*pseudo_words(30, 1000 + n), *words, *pseudo_words(r.randrange(20), 2000 + n)])))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(docs), benchmark(spark, items)).collect()}
    assert got == brute(docs, items) and len(got) > 100


def test_short_items_with_every_allowed_substitution_are_found(spark, documents):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 16)]
    docs = []
    for n, text in items:
        for n_changed in range(min(n // 4 + 2, 4 if n < 12 else 3)):
            for places in combinations(range(n), n_changed):
                words = ["x" if k in places else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", *words, "after"])))
                docs.append((len(docs), " ".join(words)))
        docs += [(len(docs), " ".join(text.split()[1:])), (len(docs) + 1, " ".join(text.split()[:-1]))]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(docs), benchmark(spark, items)).collect()}
    assert got == brute(docs, items) and {i for _, i in got} == set(range(1, 16))


def test_case_punctuation_and_short_items(spark, documents):
    items = [(1, "One, two; THREE four five six"), (2, "one two three"), (3, None), (4, ""), (9, "one two three four five six!")]
    docs = [(1, "say (one) two three-four five SIX now"), (2, "one two three"), (3, None), (None, "one two three four five six"),
            (5, "")]
    got = {(r.doc_id, r.item_id, r.n_items, r.n_equal) for r in decontam.leaks(
        documents(docs, clashes=True), benchmark(spark, items)).collect()}
    assert got == {(1, 1, 2, 6), (None, 1, 2, 6), (1, 2, 1, 3), (2, 2, 1, 3), (None, 2, 1, 3)}


def test_a_benchmark_in_blocks_gives_the_same(spark, documents, monkeypatch):
    items = [(i, " ".join(pseudo_words(20, i))) for i in range(10)]
    docs = documents([(i, items[i % 10][1] + " end") for i in range(30)])
    whole = sorted(map(tuple, decontam.leaks(docs, benchmark(spark, items)).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 50)
    assert sorted(map(tuple, decontam.leaks(docs, benchmark(spark, items)).collect())) == whole


def test_repetitive_and_long_texts(spark, documents):
    docs = documents([(1, "la " * 3000), (2, " ".join(pseudo_words(30_000, 5)))])
    items = benchmark(spark, [(1, "la " * 500), (2, " ".join(pseudo_words(30_000, 5)[200:230]))])
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(1, 1), (2, 2)}


def test_stage_drops_overlapping_rows_only(spark, documents, tmp_path):
    item = " ".join(pseudo_words(20, 1))
    benchmark(spark, [(1, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([(1, item), (1, "clean text"), (None, item + " x"), (None, None), (2, "clean"), (2, "clean")], clashes=True)
    got = decontam.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in got.collect()) == ["1clean text", "2clean", "2clean", "NoneNone"]
    benchmark(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert decontam.stage(spark, docs, str(tmp_path)).count() == 6


def test_a_phrase_that_all_items_and_documents_share(spark, documents):
    phrase = "which of the following is the best answer to".split()
    items = [(i, " ".join([*phrase, *(f"i{i}w{k}" for k in range(8))])) for i in range(300)]
    docs = [(d, " ".join([f"d{d}", "before", *phrase, "after", f"d{d}"])) for d in range(300)]
    got = decontam.leaks(documents(docs), benchmark(spark, items)).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got) == 300 * 300
    assert {(r.n_equal, r.n_items) for r in got} == {(9, 1)}
