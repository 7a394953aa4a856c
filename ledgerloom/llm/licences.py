"""Licence scans by a trained paragraph classifier.

A paragraph is a line with a word. Its terms are the distinct hashed runs of one to three words; a multinomial logistic
regression over them gives the chance of each licence family and of ``unknown``. It is fitted on variations of the
templates (words dropped, words of other texts put in, two templates' texts cut short) and, for ``unknown``, on paragraphs
of the corpus. A temperature fitted on a part held back makes the chances calibrated, so that a paragraph is predicted to be
a notice if the chances of all families come to over a half. It names each family of which it resembles a template: over a
third (``ALIKE``) of the pairs of neighbouring words in either are in both, or three fifths (``COVERED``) of the template's are
in the paragraph. For a second family, three fifths of the pairs that no template of the first one has must be there, too.

The corpus sample for ``unknown`` has at most ``SAMPLE`` paragraphs, by a hash of the text; the fit is one task. The model has
a row for each term seen in ``LEAST_SEEN`` of its texts and is broadcast; it grows with the sample, not with the corpus. All paragraphs are scored.

Defined results: a null or blank text has no paragraphs and no licences. Rows that repeat an id are scanned each for itself.
An empty table gives an empty result. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.arrays import Texts, chunks, runs
from ledgerloom.llm.machine import AdaGrad, Rows
from ledgerloom.llm.workers import in_tasks
from ledgerloom.workspace import staged

# Notices by licence family.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("public domain", "This is free and unencumbered software released into the public domain."),
    ("public domain", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 "
                      "Universal."),
)
# Notices of licences that are none of the families.
FOREIGN = (
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
)
SHORT = 12  # words; longer templates may be cut short
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
UNKNOWN = len(FAMILIES)  # the class after the families
SAMPLE = 10_000  # paragraphs of the corpus that the model learns from
ALIKE, COVERED = 0.35, 0.6
VARIANTS = 120  # of each template
LEAST_SEEN = 3  # training paragraphs that a term must be in
EPOCHS, BATCH = 12, 128
_PLAIN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
MODEL = "term long, weights binary"  # weights as 32-bit floats


class Paragraphs:
    """The lines that have a word, of texts in lower case without ASCII punctuation."""

    def __init__(self, texts: list[str | None]):
        t = Texts([None if x is None else x.encode("utf-8", "surrogatepass").translate(_PLAIN).decode(
            "utf-8", "surrogatepass") for x in texts], lower=True)
        line = np.cumsum(t.data == 10)[t.starts] if len(t.starts) else np.zeros(0, np.int64)
        first = np.ones(len(line), bool)
        first[1:] = line[1:] != line[:-1]
        self.of_word = np.cumsum(first) - 1
        self.hashes, self.n = t.hashes, int(first.sum())
        self.text = t.owners()[first]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and paragraph of each run of ``n`` words."""
        found = runs(self.hashes, n)
        own = self.of_word[:len(found)]
        whole = own == self.of_word[n - 1:] if len(found) else np.zeros(0, bool)
        return found[whole].view(np.int64), own[whole]

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms and their paragraphs, in order of paragraph and term."""
        found = [self.grams(n) for n in (1, 2, 3)]
        return distinct(np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found]))


def distinct(term: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    return term[new], owner[new]


def rows_of(term: np.ndarray, owner: np.ndarray, n: int) -> Rows:
    return Rows(np.split(term, np.searchsorted(owner, np.arange(1, n)))) if n else Rows([])


def variations(fill: list[str], seed: int = 11) -> tuple[list[str], list[int]]:
    """Texts like the templates, and their classes: words dropped, others put in before, after and inside."""
    random, texts, classes = np.random.default_rng(seed), [], []
    for family, template in TEMPLATES:
        for i in range(VARIANTS):
            words = template.split()
            if i:
                words = [w for w in words if random.random() > 0.08] or words
                for _ in range(random.integers(0, 3)):
                    words.insert(int(random.integers(0, len(words) + 1)), str(random.choice(fill)))
                if random.random() < 0.3:
                    words = ["Copyright", str(random.integers(1990, 2030)), str(random.choice(fill)), *words]
                if len(words) > 12 and random.random() < 0.3:
                    start = int(random.integers(0, len(words) - 10))
                    words = words[start:start + int(random.integers(10, len(words) - start + 1))]
            texts.append(" ".join(words))
            classes.append(FAMILIES.index(family))
    return texts, classes


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logits(rows: Rows, weights: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The sums of the weights of each row's terms; the last row of ``weights`` is the bias."""
    term, of = rows.take(part)
    out = np.tile(weights[-1], (len(part), 1)).astype(np.float64)
    np.add.at(out, of, weights[term])
    return out


def fit(sample: list[str]) -> pd.DataFrame:
    """The weights of all terms of the training texts, with the temperature worked in; the bias has term 0."""
    notices = [t for _, t in TEMPLATES]
    common = [t for t in sample if resemblance(t, notices).max() < ALIKE]
    fill = [w for t in common[:200] for w in t.split()][:2000] or ["text"]
    texts, classes = variations(fill)
    # words of licences in other company are unknown as well
    random = np.random.default_rng(5)
    vocabulary = [w for t in notices for w in t.split()]
    mixed = [" ".join([*random.choice(fill, 8), *random.choice(vocabulary, 3)]) for _ in range(len(texts) // 4)]
    paragraphs = Paragraphs([*texts, *mixed, *common])
    term, owner = paragraphs.terms()
    label = np.array(classes + [UNKNOWN] * (len(mixed) + len(common)))[paragraphs.text]
    names, at, seen = np.unique(term, return_inverse=True, return_counts=True)
    often = seen >= LEAST_SEEN
    use = often[at]
    names, at, owner = names[often], (np.cumsum(often) - 1)[at[use]], owner[use]
    rows = rows_of(at, owner, paragraphs.n)
    held = random.random(len(label)) < 0.2
    weights = np.zeros((len(names) + 1, len(FAMILIES) + 1))
    steps = AdaGrad(weights, 0.3, 1e-4)
    used = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for batch in np.array_split(random.permutation(used), max(1, len(used) // BATCH)):
            error = softmax(logits(rows, weights, batch))
            error[np.arange(len(batch)), label[batch]] -= 1
            error /= len(batch)
            term, of = rows.take(batch)
            touched, where = np.unique(np.append(term, np.full(len(batch), len(names))), return_inverse=True)
            gradient = np.zeros((len(touched), weights.shape[1]))
            np.add.at(gradient, where, error[np.append(of, np.arange(len(batch)))])
            steps.step(touched, gradient)
    back = np.flatnonzero(held)
    x = logits(rows, weights, back)
    loss = [-np.log(softmax(x / t)[np.arange(len(back)), label[back]] + 1e-12).mean() for t in TEMPERATURES]
    weights /= TEMPERATURES[int(np.argmin(loss))]
    return pd.DataFrame({"term": np.append(names, 0), "weights": [w.tobytes() for w in weights.astype(np.float32)]})


TEMPERATURES = np.geomspace(0.5, 5, 24)


def pairs(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring words of a text, whatever its lines."""
    p = Paragraphs([text.replace("\n", " ")])
    return np.unique(runs(p.hashes, 2))


_known: dict[tuple[str, ...], list[np.ndarray]] = {}


def resemblance(text: str, templates: list[str]) -> np.ndarray:
    """How like a text is to each template; ``ALIKE`` is enough. The share of word pairs in both of those in either or,
    scaled so that ``COVERED`` gives the same, of the template's."""
    key = tuple(templates)
    if key not in _known:
        _known[key] = [pairs(t) for t in templates]
    own, out = pairs(text), []
    for other in _known[key]:
        both = len(np.intersect1d(own, other, assume_unique=True))
        out.append(max(both / max(1, len(own) + len(other) - both), ALIKE / COVERED * both / max(1, len(other))))
    return np.array(out)


def word_set(text: str) -> np.ndarray:
    return np.unique(Paragraphs([text.replace("\n", " ")]).hashes)


@cache
def notices() -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Family (none of foreign ones), number of words, distinct words and distinct pairs of each notice."""
    every = [*TEMPLATES, *[("", t) for t in FOREIGN]]
    return [(f, len(Paragraphs([t]).hashes), word_set(t), pairs(t)) for f, t in every]


@cache
def set_apart(k: int) -> tuple[bool, np.ndarray]:
    """Whether a template has words that no notice of another licence has; those, or else such pairs."""
    family, _, *own = notices()[k]
    for i, mine in enumerate(own):
        others = [n[2 + i] for n in notices() if n[0] != family]
        mine = np.setdiff1d(mine, np.concatenate(others), assume_unique=False)
        if len(mine):
            return i == 0, mine
    return False, np.zeros(0, np.uint64)


def share(part: np.ndarray, whole: np.ndarray) -> float:
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part) if len(part) else 1.0


def fits(k: int, words: np.ndarray, own: np.ndarray) -> bool:
    """Whether a text of these words and pairs has what sets template ``k`` apart, and is not rather another notice."""
    family, n_words, template_words, template = notices()[k]
    of_words, apart = set_apart(k)
    there = share(apart, words if of_words else own)
    if len(apart) and there < (COVERED if n_words <= SHORT else 1 / len(apart)):
        return False
    for other, _, other_words, other_pairs in notices():
        beyond = np.setdiff1d(other_words, template_words, assume_unique=True)
        if other == family or not len(beyond) or share(beyond, words) < COVERED or share(other_pairs, own) < COVERED:
            continue
        if share(np.setdiff1d(template, other_pairs, assume_unique=True), own) < COVERED:
            return False
    return True


def confirmed(text: str, chance: np.ndarray) -> list[str]:
    """The families that a text resembles, from the likeliest on; what sets a further one apart from those before it must
    be there as well, since notices of different families share most of their words."""
    own, names, known = pairs(text), [], np.zeros(0, np.uint64)
    like = resemblance(text, [t for _, t in TEMPLATES]) >= ALIKE
    if not like.any():
        return names
    words = word_set(text)
    like = np.array([bool(x) and fits(k, words, own) for k, x in enumerate(like)])
    templates = [n[3] for n in notices()[:len(TEMPLATES)]]
    for i in np.argsort(-chance[:UNKNOWN], kind="stable").tolist():
        at = [k for k, (f, _) in enumerate(TEMPLATES) if f == FAMILIES[i]]
        apart = [np.setdiff1d(templates[k], known, assume_unique=True) for k in at if like[k]]
        if any(not names or len(x) and share(x, own) >= COVERED for x in apart):
            names.append(FAMILIES[i])
            known = np.union1d(known, np.concatenate([templates[k] for k in at]))
    return names


def learned(docs: DataFrame) -> DataFrame:
    """The model, fitted on templates and a sample of the corpus's distinct paragraphs."""
    split = F.split("text", "\n")
    lines = docs.select(F.explode(split).alias("line")).where(F.trim("line") != "")
    hashed = lines.select("line", F.xxhash64("line").alias("h"))
    n_lines = hashed.agg(F.approx_count_distinct("h")).first()[0]  # one number; repeats don't count
    # a share of the distinct lines by their hash, so that only about four samples are shuffled to find them
    few = hashed.where(F.pmod("h", F.lit(max(1, -(-n_lines // (4 * SAMPLE))))) == 0)
    sample = few.distinct().orderBy("h", "line").limit(SAMPLE)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield fit(sorted(x for frame in frames for x in frame["line"] if x))

    always = docs.sparkSession.range(1).select(F.lit("").alias("line"))  # a task even if the corpus is empty
    return staged(in_tasks(sample.select("line").unionAll(always).repartition(1), work, MODEL), "licence-model")


def scanned(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, licences, n_licensed, n_unconfirmed): the families found, in order and joined by commas, and
    how many paragraphs name one or only seem to."""
    found = model.toPandas().sort_values("term")
    is_bias = (found["term"] == 0).to_numpy()
    packed = b"".join([*found["weights"][~is_bias], *found["weights"][is_bias]])
    weights = np.frombuffer(packed, np.float32).reshape(-1, UNKNOWN + 1)
    shared = docs.sparkSession.sparkContext.broadcast((found["term"].to_numpy()[~is_bias], weights))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weight = shared.value
        known = np.zeros(1 << 22, bool)
        known[names & (len(known) - 1)] = True
        for frame in chunks(frames, "text"):
            texts = [x if isinstance(x, str) else None for x in frame["text"]]
            p = Paragraphs(texts)
            found = []
            for n in (1, 2, 3):  # nearly all terms are unknown to the model
                term, owner = p.grams(n)
                maybe = known[term & (len(known) - 1)]
                found.append((term[maybe], owner[maybe]))
            term, owner = distinct(np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found]))
            at = np.minimum(np.searchsorted(names, term), max(0, len(names) - 1))
            real = names[at] == term if len(names) else np.zeros(0, bool)
            rows = rows_of(at[real], owner[real], p.n)
            chance = softmax(logits(rows, weight, np.arange(p.n))) if p.n else np.zeros((0, UNKNOWN + 1))
            families = [[] for _ in texts]
            licensed, doubtful = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            hit = np.flatnonzero(chance[:, :UNKNOWN].sum(axis=1) > 0.5)
            if len(hit):
                starts = np.searchsorted(p.text, np.arange(len(texts)))
                for i in hit.tolist():
                    of = int(p.text[i])
                    plain = texts[of].encode("utf-8", "surrogatepass").translate(_PLAIN).split(b"\n")
                    line = [x for x in plain if x.split()][i - int(starts[of])].decode("utf-8", "surrogatepass")
                    named = confirmed(line, chance[i])
                    families[of] += named
                    licensed[of] += bool(named)
                    doubtful[of] += not named
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].array, "n_paragraphs": np.bincount(p.text, minlength=len(texts)),
                "licences": [",".join(sorted(set(f))) for f in families], "n_licensed": licensed,
                "n_unconfirmed": doubtful})

    return in_tasks(
        docs.select("doc_id", "text"), work,
        "doc_id string, n_paragraphs long, licences string, n_licensed long, n_unconfirmed long", ids=("doc_id",))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs, learned(docs))
