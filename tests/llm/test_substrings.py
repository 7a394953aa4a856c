from collections import Counter

import pytest
from helpers_llm import pseudo_words
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerloom.llm import substrings


def brute(docs):
    windows, words = Counter(), [(t or "").split() for _, t in docs]
    for w in words:
        windows.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, substrings.deduplicated(df).collect()), key=repr)


def test_passages_copies_and_loops(documents):
    passage, other = pseudo_words(50, 1), pseudo_words(36, 2)
    docs = [(i, " ".join([*pseudo_words(i % 40, 10 + i), *passage[i % 7:], *pseudo_words(i % 3, 90 + i)])) for i in range(30)]
    docs += [(100, " ".join(other[:35])), (101, " ".join(other[1:] + ["z"])), (102, " ".join(other)), (103, " ".join(other[:34]))]
    docs += [(200, "a b c " * 40), (201, "x " * 36), (202, "x " * 34), (203, " ".join(passage * 2))]
    docs += [(300, None), (301, ""), (302, " \n "), (None, " ".join(passage)), (303, " ".join(pseudo_words(100, 7)))]
    assert found(documents(docs, clashes=True)) == brute(docs)


def test_repeated_rows_and_ids(documents):
    text, more = " ".join(pseudo_words(60, 1)), " ".join(pseudo_words(60, 2))
    docs = [(1, text), (1, text), (2, more), (2, text), (None, more), (3, None), (3, None)]
    assert found(documents(docs)) == brute(docs)


def test_long_text_and_empty_table(documents):
    long = " ".join(pseudo_words(200_000, 3))
    docs = [(1, long), (2, " ".join(long.split()[150_000:150_100]))]
    got = found(documents(docs))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 200_000, 100), (2, 100, 100)]
    assert found(documents([])) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(20, 90)), min_size=1, max_size=12))
def test_random_cuts_of_few_texts(documents, cuts):
    bases = [pseudo_words(100, i) for i in range(3)] + [["a", "b"] * 50]
    docs = [(i, " ".join(bases[b][start:start + n])) for i, (b, start, n) in enumerate(cuts)]
    assert found(documents(docs)) == brute(docs)


@pytest.mark.parametrize("n", [1, 2, 28])
def test_least_of_is_the_first_minimum(n):
    import numpy as np

    h = np.random.default_rng(n).integers(0, 9, 200).astype(np.uint64)
    want = [i + int(h[i:i + n].argmin()) for i in range(200 - n + 1)]
    assert substrings.least_of(h, n).tolist() == want


def test_words_of_equal_hash_are_told_apart(documents):
    """Thue and Morse's sequence and its complement have one polynomial hash modulo 2^64 under every odd base."""
    ones = [bin(i).count("1") % 2 for i in range(2048)]
    word, other = ("".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones))
    h = substrings.Texts([f"{word} {other}"]).hashes
    assert h[0] == h[1]
    base = pseudo_words(120, 4)
    docs = [(1, " ".join([*base[:60], word, *base[60:]])), (2, " ".join([*base[:60], other, *base[60:]])),
            (3, " ".join([*base[30:60], word, *base[60:70]])), (4, " ".join([other, *pseudo_words(34, 5)])),
            (5, " ".join([word, *pseudo_words(34, 5)]))]
    assert found(documents(docs)) == brute(docs)


def test_chains_and_circles_of_paths(spark):
    # a chain of 40, a circle of 3, a loop of 1 and a node where two paths end; node names apart from each other
    rows = [(i, i, 1000 + i, 1001 + i, 1 + i % 3) for i in range(40)]
    rows += [(100, 0, 1, 2, 1), (101, 0, 2, 3, 1), (102, 0, 3, 1, 1), (200, 0, 9, 9, 2)]
    rows += [(300, 0, 20, 22, 1), (301, 0, 21, 22, 1), (302, 0, 22, 23, 1)]
    df = spark.createDataFrame(rows, "anchor long, path long, head long, tail long, n_edges int")
    got = {(r.anchor, r.path): (tuple(r.root), r.distance) for r in substrings.compacted(df).collect()}
    before = 0
    for i in range(40):
        assert got[i, i] == ((0, 0), before)
        before += 1 + i % 3
    assert all(got[a, 0] == ((a, 0), 0) for a in (100, 101, 102, 200, 300, 301, 302)) and len(got) == len(rows)


def test_whitespace_between_words_does_not_matter(documents):
    w = pseudo_words(50, 8)
    docs = [(1, " ".join(w)), (2, "\n".join(w)), (3, " \t ".join(w[5:45]) + "\r\n")]
    assert found(documents(docs)) == brute(docs)


def test_copies_with_replaced_words_keep_them(documents):
    w = pseudo_words(400, 11)
    docs = [(1, " ".join(w)), (2, " ".join(w))]
    for n, places in enumerate([(200,), (100, 300), (60, 150, 170, 290)]):
        docs.append((3 + n, " ".join(f"new{n}" if i in places else x for i, x in enumerate(w))))
    assert found(documents(docs)) == brute(docs)
