import zlib

import numpy as np
import pytest
from helpers_llm import pseudo_words, sentence
from pyspark.sql import functions as F

from ledgerloom.llm import licences, toxicity
from ledgerloom.llm.machine import Rows, sigmoid

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled():
    """Toxic is an insult, or two harmless words that are only bad together."""
    r, rows = np.random.default_rng(1), []
    for i in range(3000):
        words, kind = pseudo_words(25, i), i % 10
        if kind == 0:
            words.insert(int(r.integers(25)), "idiot")
        if kind in (1, 3):
            words.insert(3, "green")
        if kind in (2, 3):
            words.insert(9, "people")
        rows.append((i, " ".join(words), int(kind in (0, 3))))
    return rows


def test_held_out_accuracy_with_pairs_of_terms(spark, documents, labelled):
    docs = documents([(i, t) for i, t, _ in labelled])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled], LABELS)
    rows = {r.doc_id: r for r in toxicity.scored(docs, toxicity.learned(docs, labels)).collect()}
    assert all(rows[i].held_out == held(i) for i, _, _ in labelled)
    test = [(rows[i].predicted, y) for i, _, y in labelled if held(i)]
    assert np.mean([p == y for p, y in test]) > 0.95
    again = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.learned(docs, labels)).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-6) for i, r in rows.items())


def test_scores_never_learn_from_held_out_labels(spark, documents, labelled):
    docs = documents([(i, t) for i, t, _ in labelled[:400]])
    labels = [(i, 1, y) for i, _, y in labelled[:400]]
    turned = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    models = [toxicity.learned(docs, spark.createDataFrame(x, LABELS)).toPandas() for x in (labels, turned)]
    assert models[0]["term"].tolist() == models[1]["term"].tolist()
    assert np.allclose(models[0]["weight"], models[1]["weight"])


def test_pairwise_sum_is_that_of_all_pairs():
    r = np.random.default_rng(2)
    v = r.normal(size=(6, toxicity.FACTORS))
    pairs = sum(v[i] @ v[j] for i in range(6) for j in range(i))
    assert ((v.sum(axis=0)**2).sum() - (v**2).sum()) / 2 == pytest.approx(pairs)
    assert sigmoid(np.array([-1e9, 0, 1e9])).tolist() == pytest.approx([0, 0.5, 1])


def test_odd_rows_and_missing_labels(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "x"), (3, "y " * 200_000), (3, "z")], clashes=True)
    for labels in ([], [(1, 1, 0), (2, 0, 0)], [(7, 1, None)], [(1, 1, 1), (1, 1, 0), (3, 1, 1)]):
        rows = toxicity.scored(docs, toxicity.learned(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert not [r for r in rows if r.doc_id is None][0].held_out
    assert toxicity.scored(documents([]), toxicity.learned(documents([]), spark.createDataFrame([], LABELS))).count() == 0


def test_licences_of_templates_variants_and_plain_texts(spark, documents):
    plain = [(1000 + i, "\n".join(sentence(12, 10 * i + k) for k in range(6))) for i in range(150)]
    whole = [(i, f"{sentence(10, i)}\n{t}\n{sentence(8, i)}") for i, (_, t) in enumerate(licences.TEMPLATES)]
    texts, classes = licences.variations(pseudo_words(50, 9), seed=77)
    varied = [(5000 + i, t) for i, t in enumerate(texts)]
    odd = [(900, None), (901, ""), (None, "\n \n"), (902, "the license of the work is here."), (903, "x " * 100_000)]
    docs = documents([*plain, *whole, *varied, *odd], clashes=True)
    model = licences.learned(documents([*plain, *whole]))
    rows = {r.doc_id: r for r in licences.scanned(docs, model).collect()}
    assert all(rows[i].licences == f for i, (f, _) in enumerate(licences.TEMPLATES))
    assert all(rows[d].licences == "" and rows[d].n_paragraphs == 6 for d, _ in plain)
    named = [(rows[5000 + i].licences, licences.FAMILIES[c]) for i, c in enumerate(classes)]
    assert np.mean([got == want for got, want in named]) > 0.8
    assert np.mean([got not in (want, "") for got, want in named]) < 0.03
    assert [(rows[d].n_paragraphs, rows[d].licences) for d in (900, 901, None, 902, 903)] == [
        (0, ""), (0, ""), (0, ""), (1, ""), (1, "")]


def test_licences_of_an_empty_table(spark, documents):
    assert licences.scanned(documents([]), licences.learned(documents([]))).count() == 0


def test_resemblance():
    template = "Released under the MIT License."
    assert licences.resemblance("released  under the mit license", [template])[0] == 1
    assert licences.resemblance("Foo 1.0 is released under the MIT License, which see, and then some more words", [template])[0] >= licences.ALIKE
    assert licences.resemblance("released the license", [template])[0] < licences.ALIKE
    assert Rows([]).take(np.zeros(0, np.int64))[0].tolist() == []


def test_the_sample_is_full_however_often_lines_repeat(documents, monkeypatch):
    monkeypatch.setattr(licences, "SAMPLE", 50)
    monkeypatch.setattr(licences, "in_tasks", lambda df, work, schema: df)
    monkeypatch.setattr(licences, "staged", lambda df, label: df)
    text = "\n".join(sentence(6, i) for i in range(200))
    sample = licences.learned(documents([(i, text) for i in range(100)])).where("line != ''")
    assert sample.count() == sample.distinct().count() == 50


def test_one_line_with_notices_of_two_families(spark, documents):
    plain = [(1000 + i, "\n".join(sentence(12, 10 * i + k) for k in range(6))) for i in range(150)]
    notice = {f: t for f, t in reversed(licences.TEMPLATES)}  # the first of each family
    two = [("MIT", "Apache-2.0"), ("GPL", "MIT"), ("BSD", "MPL-2.0"), ("GPL", "LGPL"), ("CC-BY", "MIT"), ("CC-BY", "CC-BY-SA")]
    docs = [(i, f"{notice[a]} {notice[b]}") for i, (a, b) in enumerate(two)]
    docs += [(100, "SPDX-License-Identifier: MIT OR Apache-2.0"), (101, notice["MIT"] + "\n" + notice["GPL"])]
    rows = {r.doc_id: r for r in licences.scanned(documents(docs), licences.learned(documents(plain))).collect()}
    assert [(rows[i].licences, rows[i].n_licensed) for i in range(len(two))] == [(",".join(sorted(p)), 1) for p in two]
    assert (rows[100].licences, rows[100].n_licensed) == ("Apache-2.0,MIT", 1)
    assert (rows[101].licences, rows[101].n_licensed, rows[101].n_unconfirmed) == ("GPL,MIT", 2, 0)


def test_labels_without_a_document_take_no_room_in_the_sample(spark, documents, labelled, monkeypatch):
    docs = documents([(i, t) for i, t, _ in labelled[:400]])
    labels = [(i, 1, y) for i, _, y in labelled[:400]]
    monkeypatch.setattr(toxicity, "SAMPLE", 400)
    models = [toxicity.learned(docs, spark.createDataFrame(x, LABELS)).toPandas() for x in (
        labels, labels + [(10_000 + i, 1, i % 2) for i in range(20_000)])]
    assert len(models[0]) > 20 and models[0]["term"].tolist() == models[1]["term"].tolist()
    assert np.allclose(models[0]["weight"], models[1]["weight"])


FOREIGN_LINES = [
    "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib", "Licensed under the Eclipse Public License, Version 2.0.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3.",
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."]


@pytest.mark.parametrize("line", FOREIGN_LINES)
def test_notices_of_other_licences_are_no_family(line):
    for first in range(licences.UNKNOWN):  # whatever the classifier thinks
        assert licences.confirmed(line, np.eye(licences.UNKNOWN + 1)[first]) == []


def test_every_template_is_its_own_family_only():
    for family, line in licences.TEMPLATES:
        chance = np.full(licences.UNKNOWN + 1, 0.01)
        chance[licences.FAMILIES.index(family)] = 0.9
        assert licences.confirmed(line, chance) == [family]


def shared_pairs(a, b):
    """Word pairs in both texts, and in each, by the words themselves."""
    sets = []
    for t in (a, b):
        words = "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in t).lower().split()
        sets.append(set(zip(words, words[1:])))
    return len(sets[0] & sets[1]), len(sets[0]), len(sets[1])


def test_resemblance_equals_brute_force():
    texts, _ = licences.variations(pseudo_words(50, 9), seed=7)
    templates = [t for _, t in licences.TEMPLATES]
    for text in texts[::37]:
        got = licences.resemblance(text, templates)
        for t, value in zip(templates, got):
            both, own, other = shared_pairs(text, t)
            want = max(both / max(1, own + other - both), licences.ALIKE / licences.COVERED * both / max(1, other))
            assert value == pytest.approx(want)


def auc(score, toxic):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = int(toxic.sum())
    return (rank[toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(toxic) - n))


def machine_and_linear(docs, labels, monkeypatch):
    """AUC on held-out labels of the full model and of one fitted without pairs."""
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held"), toxicity.terms(F.col("text")).alias("terms"))
    rows = rows.join(truth, "doc_id").orderBy("doc_id").toPandas()
    used, test = rows[~rows["held"]], rows[rows["held"]]
    out = []
    for settings in (toxicity.SETTINGS, ()):
        monkeypatch.setattr(toxicity, "SETTINGS", settings)
        model = toxicity.fit(Rows(used["terms"].tolist()), used["toxic"].to_numpy(float))
        weight, factors = dict(zip(model["term"], model["weight"])), dict(zip(model["term"], model["factors"]))
        score = []
        for own in test["terms"]:
            v = np.array([factors[t] for t in own if t in factors] or [np.zeros(toxicity.FACTORS)])
            score.append(sum(weight.get(t, 0) for t in own) + ((v.sum(axis=0)**2).sum() - (v**2).sum()) / 2)
        out.append(auc(np.array(score), test["toxic"].to_numpy()))
    return out


def test_pairs_explain_labels_that_single_terms_do_not(spark, documents, monkeypatch):
    rows = []
    for i in range(3000):
        words, kind = pseudo_words(25, i), i % 4
        if kind in (1, 3):
            words.insert(3, "green")
        if kind in (2, 3):
            words.insert(9, "people")
        rows.append((i, " ".join(words), int(kind in (0, 3))))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    full, linear = machine_and_linear(documents([(i, t) for i, t, _ in rows]), labels, monkeypatch)
    assert full > 0.97 and linear < 0.7


def test_pairs_do_no_harm_on_the_given_labels(spark, monkeypatch):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    full, linear = machine_and_linear(docs, labels, monkeypatch)
    assert full >= linear - 0.002 and full > 0.97


def test_scores_equal_the_sum_over_all_pairs(spark, documents, labelled):
    docs = documents([(i, t) for i, t, _ in labelled[:600]])
    model = toxicity.learned(docs, spark.createDataFrame([(i, 1, y) for i, _, y in labelled[:600]], LABELS))
    known = {r.term: (r.weight, np.array(r.factors)) for r in model.collect()}
    few = docs.where("doc_id < 20")
    terms = {r.doc_id: r.terms for r in few.select("doc_id", toxicity.terms(few["text"]).alias("terms")).collect()}
    for r in toxicity.scored(few, model).collect():
        own = [known[t] for t in terms[r.doc_id] if t in known]
        x = known[toxicity.BIAS][0] + sum(w for w, _ in own) + sum(
            float(a @ b) for i, (_, a) in enumerate(own) for _, b in own[:i])
        assert r.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-4)
