import random
import re

import numpy as np
import pandas as pd
import pytest
from helpers_llm import pseudo_words

from ledgerloom.llm import minhash
from ledgerloom.llm.arrays import Texts
from ledgerloom.llm.graph import components


def brute(docs):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(top(i), []).append(d)
    return [(d, len(sets[i]), min(ids[top(i)])) for i, (d, _) in enumerate(docs)]


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"e{seed}x{at}"
    return out


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.groups(df).collect())


@pytest.mark.parametrize("tile", [256, 8])
def test_groups_match_brute_force(documents, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    docs, at = [], 0
    for g in range(12):
        base = pseudo_words(40 + 25 * g, g)
        for i in range(14):
            docs.append((at, " ".join(edited(base, (i * len(base)) // 160, 100 * g + i))))
            at += 1
    docs += [(at + i, t) for i, t in enumerate([None, "", "one two", "One TWO", "É", "é", "a\xa0b", "a b", " one\ttwo "])]
    assert found(documents(docs, clashes=True)) == sorted(brute(docs))


def test_kept_has_one_of_each_group_and_repeated_rows_go(spark, documents):
    text = " ".join(pseudo_words(50, 1))
    docs = documents([(5, text), (3, text.upper()), (3, text.upper()), (9, "other text"), (None, text), (7, None), (8, "")], clashes=True)
    got = minhash.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 7, 8, 9]


def test_large_group_of_copies_and_one_long_text(documents):
    base = pseudo_words(60, 2)
    docs = [(i, " ".join(base)) for i in range(500)] + [(500 + i, " ".join(edited(base, 1, i))) for i in range(600)]
    docs += [(2000, " ".join(pseudo_words(60_000, 3)))]
    got = found(documents(docs))
    assert {c for d, _, c in got if d < 2000} == {0} and got[-1][2] == 2000


def test_a_shared_id_fetches_one_text_for_each_node(documents, monkeypatch):
    docs, fetched, in_tasks = [], [], minhash.in_tasks
    for g in range(20):
        base = pseudo_words(80, 50 + g)
        docs += [(None if g % 2 else 7, " ".join(edited(base, i % 2, g))) for i in (0, 1, 1)]

    def watched(df, work, *args, **more):
        if work is minhash.linked_rows:
            fetched.append((df.count(), df.select(*minhash.TILES, "node").distinct().count()))
        return in_tasks(df, work, *args, **more)

    monkeypatch.setattr(minhash, "in_tasks", watched)
    rows = minhash.groups(documents(docs)).collect()
    assert len(rows) == 60 and all(r.component_id == r.doc_id for r in rows)
    assert fetched[0][0] == fetched[0][1] >= 40


def test_empty_table(documents):
    assert found(documents([])) == []


def test_every_bin_fills_and_agreement_follows_similarity():
    a, b = pseudo_words(1000, 4), pseudo_words(1000, 5)
    texts = Texts([" ".join(a), " ".join(a[:800] + b[:200]), "one"])
    owner, hashes = minhash.shingles(texts)
    bins = minhash.sketches(owner, hashes, 3)
    sets = [set(hashes[owner == i].tolist()) for i in range(3)]
    similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((bins[0] == bins[1]).mean() - similarity) < 0.15
    assert (bins != 0).mean() > 0.99 and len(np.unique(bins[2])) > 100


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 140)) and got[200] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_leaves_out_no_key(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS key_a", "hash(id) AS key_b", "id AS text")
    keys = rows.where("text % 10 = 0")
    got = {r["text"] for r in minhash.maybe_among(rows, keys).collect()}
    assert {i for i in range(0, 20_000, 10)} <= got and len(got) < 2_200
    assert minhash.maybe_among(rows, keys.limit(0)).count() == 0


def test_counts_of_shared_shingles():
    r = np.random.default_rng(2)
    for n, most in ((2, 3), (2, 0), (7, 40), (40, 400)):
        sets = [np.unique(r.integers(0, 2 * most + 2, size=most)).astype(np.uint64) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        got = minhash.equal_counts(sets)
        assert all(want[i][j] in (None, got[i, j]) for i in range(n) for j in range(n))


def test_stretches_hold_whole_groups():
    keys = [0, 0, 1, 2, 2, 2, 3, 4, 4]
    frame = pd.DataFrame({"k": keys, "text": ["x" * n for n in (5, 30, 1, 2, 2, 2, 50, 0, 3)]})
    parts = list(minhash.stretches(frame, ["k"], 20))
    assert [p["k"].tolist() for p in parts] == [[0, 0], [1, 2, 2, 2], [3], [4, 4]]
    assert pd.concat(parts).equals(frame) and len(list(minhash.stretches(frame, ["k"]))) == 1
