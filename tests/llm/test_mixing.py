import pytest
from helpers_llm import sentence
from pyspark.sql import functions as F

from ledgerloom.llm import mixing
from ledgerloom.llm.sums import running


def brute_targets(sizes):
    """Sources in order with their sizes: share out, cut at three times the size, share the excess again."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    target, rest, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and rest > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + rest * weights[s] / total >= 3 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += rest * weights[s] / total
            break
        share = {s: weights[s] * rest / total for s in open_}
        rest = sum(max(0.0, target[s] + share[s] - 3 * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(3.0 * sizes[s], target[s] + share[s])
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 3, "d": 40, "e": 2}, {"a": 5}, {"a": 0, "b": 0},
    {"a": 0, "b": 7, "c": 1}, {f"s{i:02}": (i * 37) % 101 for i in range(40)},
])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_taken_words_meet_the_budget(spark, documents):
    docs = documents([(i, sentence(10 + i % 7, i), "ab"[i % 3 == 0]) for i in range(200)] + [
        (900, None, "a"), (901, "", None), (None, "x y z", None), (902, " w " * 40, None)], clashes=True)
    sizes = mixing.sized(docs)
    rows = mixing.cut(sizes, sizes).collect()
    assert len(rows) == 204 and all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in ("a", "b", None):
        of = [r for r in rows if r.source == source]
        assert sum(r.taken for r in of) == int(of[0].target) and sum(r.size for r in of) == of[0].source_size
    again = mixing.cut(sizes.repartition(7), sizes).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_stage_repeats_and_cuts_documents(spark, documents):
    docs = documents([(1, "a b c d", "s"), (2, "e  f g h", "s"), (3, "x " * 100, "t"), (4, None, "s")], clashes=True)
    taken = {r.doc_id: r.taken for r in mixing.cut(mixing.sized(docs), mixing.sized(docs)).collect()}
    got = mixing.stage(spark, docs, "")
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r["row"] == "own row"
    assert words == {d: n for d, n in taken.items() if n}


def test_repeated_rows_share_their_taken_words(spark, documents):
    docs = documents([(1, "a b c", "s")] * 5 + [(2, "d " * 9, "t")])
    sizes = mixing.sized(docs)
    rows = mixing.cut(sizes, sizes).collect()
    assert len(rows) == 6 and sum(r.taken for r in rows) == sum(int(t) for t in {r.source: r.target for r in rows}.values())


def test_empty_table(spark, documents):
    assert mixing.stage(spark, documents([]), "").count() == 0


def test_running_sums_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i // 2 if i % 9 else None, i) for i in range(300)], "k long, v long")
    rows = running(df, [F.col("k"), F.col("v")], v_sum=F.col("v")).collect()
    ordered = sorted(rows, key=lambda r: (r.k is not None, r.k or 0, r.v))
    total = 0
    for r in ordered:
        assert r.v_sum_before == total and r.v_sum_total == sum(range(300))
        total += r.v
