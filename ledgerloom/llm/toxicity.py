"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of longer words, hashed into ``TERMS`` places. The score is the logistic function of a bias, a
weight for each term and, for each two terms, the product of their factors: a pair such as an insult and the name of a
group can weigh more than both alone. The pairs are never listed; their sum is half the difference between the squared
sum of factors and the sum of their squares.

The weights are fitted first, then weights and factors together, with decay and a threshold that leave most factors at 0; of some
settings, and the weights alone, the one is taken that does best on rows held back, so pairs take part only where they help.

The model is fitted on at most ``SAMPLE`` labelled rows that have a document, chosen by a hash of the id, in one task; terms that fewer than
``LEAST_SEEN`` of them hold have no weight. The weights, at most one row for each place, are broadcast. Scoring
covers all rows, in batches.

Defined results: a null or blank text has no terms and gets the score of the bias. An id that is labelled twice counts as
toxic if one label says so; labels without a value are left out. Rows that repeat an id are scored each for itself, and
one of them is learned from. A null id is not held out and has no label. With no labels of one kind, the score is 0 or 1
for all (0.5 with none at all). Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import text as tx
from ledgerloom.llm.machine import AdaGrad, Rows, sigmoid, sums
from ledgerloom.llm.workers import in_tasks
from ledgerloom.workspace import staged

TERMS = 1 << 22
BEGINNINGS = (5,)  # letters
FACTORS = 4
SAMPLE = 20_000  # labelled rows that the model is fitted on
LEAST_SEEN = 5
EPOCHS, BATCH = 12, 256
# of the factors: spread at the start, rate of the steps, decay, threshold under which they become 0, and epochs
SETTINGS = ((0.02, 0.05, 1e-2, 5e-3, 6), (0.1, 0.1, 5e-3, 4e-3, 12))
HELD_BACK = 0.15  # of the sample, for the choice among them; with under ``LEAST_BACK`` rows, pairs take no part
LEAST_BACK = 20
MODEL = "term int, weight float, factors array<float>"
BIAS = -1  # its place among the terms


def terms(text: Column) -> Column:
    """The places of a text's distinct words and of the beginnings of longer ones."""

    def place(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(TERMS)).cast("int")

    def places(word: Column) -> Column:
        return F.array(place(word), *[
            F.when(F.length(word) > n, place(F.left(word, F.lit(n)), F.lit(n))) for n in BEGINNINGS])

    words = F.array_distinct(tx.plain_words(text))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, places))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Machine:
    """A factorization machine in training: bias, weights and, once pairs take part, factors."""

    def __init__(self, bias: float, n: int):
        self.bias = AdaGrad(np.array([bias]), 0.1, 0.0)
        self.linear = AdaGrad(np.zeros(n), 0.3, 1e-4, threshold=2e-3)
        self.paired: AdaGrad | None = None

    def with_pairs(self, spread: float, rate: float, decay: float, threshold: float) -> Machine:
        """A copy that goes on with pairs, from small random factors."""
        out = deepcopy(self)
        start = np.random.default_rng(7).normal(0, spread, (len(self.linear.weights), FACTORS))
        out.paired = AdaGrad(start, rate, decay, threshold)
        return out

    def logits(self, term: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The logits of ``n`` rows; the factors of their terms and the sums of these by row."""
        x = self.bias.weights[0] + sums(self.linear.weights[term], of, n)
        if self.paired is None:
            return x, None, None
        v = self.paired.weights[term]
        total = sums(v, of, n)
        return x + ((total**2).sum(axis=1) - sums((v**2).sum(axis=1), of, n)) / 2, v, total

    def train(self, rows: Rows, toxic: np.ndarray, used: np.ndarray, epochs: int) -> Machine:
        random = np.random.default_rng(7)
        for _ in range(epochs):
            for batch in np.array_split(random.permutation(used), max(1, len(used) // BATCH)):
                term, of = rows.take(batch)
                x, v, total = self.logits(term, of, len(batch))
                error = (sigmoid(x) - toxic[batch]) / len(batch)
                touched, where = np.unique(term, return_inverse=True)
                self.linear.step(touched, sums(error[of], where, len(touched)))
                if v is not None:
                    self.paired.step(touched, sums(error[of][:, None] * (total[of] - v), where, len(touched)))
                self.bias.step(np.array([0]), np.array([error.sum()]))
        return self

    def loss(self, rows: Rows, toxic: np.ndarray, part: np.ndarray) -> float:
        """The mean log loss of some rows."""
        out = 0.0
        for batch in np.array_split(part, -(-len(part) // BATCH)):
            x, _, _ = self.logits(*rows.take(batch), len(batch))
            out += float((np.logaddexp(0, x) - toxic[batch] * x).sum())
        return out / len(part)


def fit(rows: Rows, toxic: np.ndarray) -> pd.DataFrame:
    """The weights of all terms seen often enough, and the bias."""
    names, at = np.unique(rows.terms, return_inverse=True)
    seen = np.bincount(at, minlength=len(names)) >= LEAST_SEEN
    place = np.where(seen, np.cumsum(seen) - 1, -1)[at]
    owner = np.repeat(np.arange(len(rows.sizes)), rows.sizes)[place >= 0]
    place = place[place >= 0]
    known = Rows(np.split(place, np.cumsum(np.bincount(owner, minlength=len(rows.sizes)))[:-1]))
    n = int(seen.sum())
    rate = toxic.mean() if len(toxic) else 0.5
    bias, weights, factors = float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -20, 20)), np.zeros(n), np.zeros((n, FACTORS))
    if 0 < rate < 1 and n:
        back = np.random.default_rng(5).random(len(toxic)) < HELD_BACK
        used, back = np.flatnonzero(~back), np.flatnonzero(back)
        best = Machine(bias, n).train(known, toxic, used if len(back) >= LEAST_BACK else np.arange(len(toxic)), EPOCHS)
        if len(back) >= LEAST_BACK:
            with_pairs = [best.with_pairs(*s[:-1]).train(known, toxic, used, s[-1]) for s in SETTINGS]
            best = min([best, *with_pairs], key=lambda m: m.loss(known, toxic, back))
        bias, weights = float(best.bias.weights[0]), best.linear.weights
        factors = factors if best.paired is None else best.paired.weights
    model = pd.DataFrame({"term": names[seen].astype(np.int32), "weight": weights.astype(np.float32),
                          "factors": list(factors.astype(np.float32))})
    return pd.concat([model, pd.DataFrame({
        "term": np.array([BIAS], np.int32), "weight": np.array([bias], np.float32),
        "factors": [np.zeros(FACTORS, np.float32)]})], ignore_index=True)


def fit_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sample = pd.concat([*frames, pd.DataFrame({"doc_id": [], "terms": [], "toxic": []})]).sort_values("doc_id")
    yield fit(Rows(sample["terms"].tolist()), sample["toxic"].to_numpy(dtype=np.float64))


def learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model, a row for each term and one for the bias, from labelled rows that aren't held out."""
    known = labels.select("doc_id", "toxic").where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    here = docs.select(F.col("doc_id").alias("id")).distinct()
    sample = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).join(here, "id", "left_semi")
    sample = F.broadcast(sample.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "toxic", terms(F.col("text")).alias("terms"))
    # terms are found in parallel; only they go to the one task that fits
    return staged(in_tasks(rows.repartition(1), fit_rows, MODEL), "model")


def scored(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    found = model.toPandas()  # at most TERMS + 1 rows
    is_bias = (found["term"] == BIAS).to_numpy()
    bias = float(found.loc[is_bias, "weight"].sum())  # none at all without labels
    found = found[~is_bias].sort_values("term")
    factors = np.stack([*found["factors"].to_list(), np.zeros(FACTORS, np.float32)]).astype(np.float32)
    weights = np.append(found["weight"].to_numpy(np.float32), np.float32(0))  # the last row is for unknown terms
    shared = docs.sparkSession.sparkContext.broadcast((found["term"].to_numpy(), weights, factors))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weight, factor = shared.value
        place = np.full(TERMS, len(names), np.int32)
        place[names] = np.arange(len(names))
        for frame in frames:
            rows, score = Rows(frame["terms"].tolist()), np.empty(len(frame))
            for first in range(0, len(frame), 512):
                part = np.arange(first, min(first + 512, len(frame)))
                term, of = rows.take(part)
                term = place[term]
                v = factor[term]
                total = sums(v, of, len(part))
                score[part] = sigmoid(bias + sums(weight[term], of, len(part)) + (
                    (total**2).sum(axis=1) - sums((v**2).sum(axis=1), of, len(part))) / 2)
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "held_out": frame["held_out"], "score": score,
                                "predicted": (score >= 0.5).astype(np.int32)})

    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), terms(F.col("text")).alias("terms"))
    return in_tasks(d, work, "doc_id string, held_out boolean, score double, predicted int", ids=("doc_id",))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, learned(docs, labels))
