import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerloom.llm import spelling

UPPER = {i: i + 32 for i in range(65, 91)}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(docs, noise=97):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    forms, rows = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if abs(len(v) - len(w)) < 2 and is_near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        rows[w] = (w, n, len(others), forms[w], counts[best] if forms[w] else None)
    out = []
    for w, row in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((*row, root))
    return sorted(out, key=repr)


def found(words):
    return sorted(map(tuple, spelling.variants(words).collect()), key=repr)


def invented(n, seed, letters="abé"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n)]


def test_documents(documents):
    docs = [(i, " ".join(w.upper() if i % 3 else w for w in invented(120, i % 7)) + " naïve, NAÏVE×x Straße's") for i in range(25)]
    docs += [(None, "abbab abbab ÉABAB"), (100, None), (101, ""), (7, "aaaaa"), (7, "aaaaa"), (102, "abcdefgh " * 5 + "x" * 3000)]
    want = brute_counts(docs)
    words = spelling.vocabulary(documents(docs, clashes=True))
    assert dict(map(tuple, words.collect())) == want
    assert found(words) == brute(want)


@pytest.mark.parametrize("size", [2, 5, 40])
def test_divided_parts_find_the_same_pairs(spark, size):
    words = sorted({w for w in invented(1500, 3, "ab") + invented(400, 4, "xyz") if len(w) >= 5})
    words += ["hothot" + w for w in words if len(w) < 8]
    df = spark.createDataFrame([(w, 3 + i % 50) for i, w in enumerate(words)], "word string, n long")
    got = [(r["word_a"], r["word_b"]) for r in spelling.near(df, size=size).collect()]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == {
        (a, b) for i, a in enumerate(sorted(words)) for b in sorted(words)[i + 1:] if abs(len(a) - len(b)) < 2 and is_near(a, b)}


def test_chains_lead_to_one_root(spark):
    chain = ["aaaaa" + "b" * k for k in range(12)]
    rows = [(w, 3 * 2**k) for k, w in enumerate(chain)] + [("zzzzz", 5), ("zzzzy", 9)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {got[w]["root"] for w in chain} == {chain[-1]}
    assert got["zzzzz"]["form"] is None and got["zzzzz"]["root"] == "zzzzz" and got["zzzzz"]["n_near"] == 1


def test_ties_go_to_the_least_word(spark):
    rows = [("eaten", 3), ("eaton", 9), ("eatin", 9), ("Éaten", 2)]
    got = {r["word"]: r["form"] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["eaten"] == "eatin"


def test_very_long_words(spark):
    r = random.Random(5)
    long = "".join(r.choices("abc", k=5000))
    words = [long, long[:2000] + long[2001:], long + "a", "b" + long[1:] if long[0] != "b" else "a" + long[1:], long[::-1]]
    got = spelling.near(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    assert {tuple(sorted((r["word_a"], r["word_b"]))) for r in got} == {
        tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1:] if is_near(a, b)}


def test_empty_table(documents):
    assert found(spelling.vocabulary(documents([]))) == []


def test_acceptor_is_minimal():
    words = sorted(["tap", "taps", "top", "tops"])
    a = spelling.Acceptor([tuple(w) for w in words])
    assert len(a.arcs) == 5  # start, after t, after the vowel, final after p, final after s
    assert sorted("".join(u) + ">" + "".join(v) for u, v in spelling.Composed(a).pairs(a.start)) == [
        "tap>taps", "tap>top", "taps>tops", "top>tops"]


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=25))
def test_composition_accepts_the_near_pairs(words):
    a = spelling.Acceptor(sorted(tuple(w) for w in words))
    got = {tuple(sorted(("".join(u), "".join(v)))) for u, v in spelling.Composed(a).pairs(a.start)}
    assert got == {(x, y) for x in words for y in words if x < y and is_near(x, y)}
