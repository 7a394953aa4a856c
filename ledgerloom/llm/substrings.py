"""Removal of long word sequences that occur more than once.

The edges of the De Bruijn graph are runs of 35 words, its nodes the 34 words that two edges share. Edges that follow
each other in a document and have the same anchor, the least hash among the eight-word runs inside, form a path; a path
is one row. Equal edges have equal anchors, so paths meet by anchor:

* paths of one anchor that are equal are occurrences of one repeated path;
* where paths of an anchor differ, it branches: one occurrence of each is taken apart into edges, read from the text at
  its coordinates, and the edges are joined.

Repeated paths are compacted through joins on their nodes: where one repeated path ends in a node, one begins there and no
other does either, the two are one. Joins that double their reach give each path the first one of its chain and its
distance from it, so occurrences that follow each other in one document at the same distance become one span. Circular
chains have no first path, and theirs stay single.

A word goes if an edge that occurs twice or more covers it; which edges do is judged on the input. Paths and edges are
compared by 64 bits of a cryptographic digest of the words at their coordinates, together with the 64 bits of the
anchor; numeric hashes only bring them together and name nodes.

Defined results: a null or blank text has no words and keeps none; one with under 35 words is kept whole. Kept words are
joined by one space. Rows that repeat id and text are occurrences of their own, so each loses what it shares with the
other. Null ids are ids like others. Texts and ids
are told apart by 128 bits. An empty table gives an empty result; only doc_id and text are read, so other
columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.arrays import Texts, chunks, runs
from ledgerloom.llm.workers import in_tasks
from ledgerloom.workspace import staged

WINDOW = 35
ANCHOR = 8
KEY = ["key_a", "key_b"]
CLASS = ["anchor", "path"]
PATH = ["start", "n_edges", "single", "branches", "anchor", "path"]
PIECE = ["anchor", "path", "head", "tail", "n_edges", "edge", "single", "key_a", "key_b", "first"]
PIECE_TYPES = {c: {"n_edges": "Int32", "first": "Int32", "single": "boolean"}.get(c, "Int64") for c in PIECE}


def least_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The place of the first least entry among each ``n`` neighbours."""
    at, width = np.arange(len(hashes)), 1
    while width < n:
        step = min(width, n - width)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(hashes[a] <= hashes[b], a, b)
        width += step
    return at


def plain(texts: pd.Series) -> Texts:
    """Texts with their words joined by one space, so that equal words are equal bytes."""
    return Texts([b" ".join(t.encode("utf-8", "surrogatepass").split()) if isinstance(t, str) else b"" for t in texts])


def digests(texts: Texts, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64 bits of a digest of the words from each ``first`` to before ``after``."""
    data = memoryview(texts.bytes)
    spans = zip(texts.starts[first].tolist(), texts.stops[after - 1].tolist())
    return np.frombuffer(b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in spans]), np.int64)


def path_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames, "text"):
        texts = plain(frame["text"])
        n = len(texts.hashes) - WINDOW + 1  # windows, those across texts included
        if n < 1:
            continue
        words = runs(texts.hashes, ANCHOR)
        anchor = least_of(words, WINDOW - ANCHOR + 1)
        owner = texts.owners()
        whole = owner[:n] == owner[WINDOW - 1:]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[:n - 1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        after = np.flatnonzero(new | ~whole)  # a path ends where the next or a window across texts begins
        place = np.searchsorted(after, first, "right")
        last = np.concatenate([after, [n]])[place]
        of = owner[first]
        yield pd.DataFrame({
            "key_a": frame["key_a"].to_numpy()[of], "key_b": frame["key_b"].to_numpy()[of],
            "start": (first - texts.bounds[of]).astype(np.int32), "n_edges": (last - first).astype(np.int32),
            "anchor": words[anchor[first]].view(np.int64),
            "path": digests(texts, first, last + WINDOW - 1),
        })


def edge_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What paths consist of, read at their coordinates: the edges of branching ones; the end nodes of repeated ones."""
    for frame in chunks(frames, "text"):
        texts = plain(frame["text"])
        nodes = runs(texts.hashes, WINDOW - 1).view(np.int64)
        paths = pd.DataFrame([tuple(p.values()) if isinstance(p, dict) else tuple(p) for row in frame["paths"] for p in row],
                             columns=PATH)
        of = np.repeat(np.arange(len(frame)), frame["paths"].str.len())
        keys = {k: frame[k].to_numpy()[of] for k in KEY}
        start, n_edges = paths["start"].to_numpy(np.int64), paths["n_edges"].to_numpy(np.int64)
        first = texts.bounds[of] + start
        whole = np.flatnonzero(~paths["single"].to_numpy(bool))
        yield pd.DataFrame({
            "anchor": paths["anchor"].to_numpy()[whole], "path": paths["path"].to_numpy()[whole],
            "head": nodes[first[whole]], "tail": nodes[(first + n_edges)[whole]],
            "n_edges": n_edges[whole].astype(np.int32)}).reindex(columns=PIECE).astype(PIECE_TYPES)
        apart = np.flatnonzero(paths["branches"].to_numpy(bool))
        n = n_edges[apart]
        row = np.repeat(apart, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[row] + step
        yield pd.DataFrame({
            "anchor": paths["anchor"].to_numpy()[row], "edge": digests(texts, at, at + WINDOW),
            "single": paths["single"].to_numpy(bool)[row], "key_a": keys["key_a"][row], "key_b": keys["key_b"][row],
            "first": (start[row] + step).astype(np.int32)}).reindex(columns=PIECE).astype(PIECE_TYPES)


def kept_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames, "text"):
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(frame["text"], frame["spans"]):
            words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []  # at the six space bytes
            n_words.append(len(words))
            if spans is not None and len(spans):
                gone = np.zeros(len(words) + 1, np.int32)
                first, after = (np.array([s[k] for s in spans]) for k in ("first", "after"))
                np.add.at(gone, first, 1)
                np.add.at(gone, after, -1)
                words = list(compress(words, np.cumsum(gone[:-1]) == 0))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n_words": n_words, "n_removed": n_removed, "kept": kept})


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with 128 bits that tell their id and text from others'."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(1), "text").alias("key_a"),
                       F.xxhash64("text", F.lit(2), "doc_id").alias("key_b"))


def compacted(classes: DataFrame) -> DataFrame:
    """(anchor, path, root, distance): for each repeated path (``anchor``, ``path``, ``head``, ``tail``, ``n_edges``) the first
    one of its chain over nonbranching nodes, and the number of edges before it in that chain.

    A path has one predecessor at most and is one's at most, so no join here meets a frequent key.
    """
    name = F.struct(*CLASS)
    into = classes.groupBy(F.col("tail").alias("node")).agg(
        F.count("*").alias("n_in"), F.min(F.struct(name.alias("root"), F.col("n_edges").cast("long").alias("distance"))).alias("before"))
    out = classes.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n_out"), F.min(name).alias("of"))
    links = into.where("n_in = 1").join(out.where("n_out = 1"), "node")
    linked = classes.select(*CLASS).join(links.select("of.*", "before"), CLASS, "left")
    state = staged(linked.select(
        name.alias("of"), F.coalesce("before.root", name).alias("root"),
        F.coalesce("before.distance", F.lit(0)).alias("distance"), F.col("before").isNotNull().alias("open")), "chains")
    done, left, n, before = state.where("NOT open"), state.where("open"), None, None
    while n != 0:
        n = left.count()
        if n == before:  # each turn ends the chains up to twice as long, so these are circles
            left = left.select("of", F.col("of").alias("root"), F.lit(0).cast("long").alias("distance"), "open")
            break
        ahead = done.unionAll(left).select(
            F.col("of").alias("root"), F.col("root").alias("next"), F.col("distance").alias("more"), F.col("open").alias("on"))
        moved = staged(left.join(ahead, "root").select(
            "of", F.col("next").alias("root"), (F.col("distance") + F.col("more")).alias("distance"), F.col("on").alias("open")), "chains")
        done, left, before = done.unionAll(moved.where("NOT open")), moved.where("open"), n
    return done.unionAll(left).select("of.*", "root", "distance")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, first, after): stretches of words, by number, that repeated edges cover."""
    texts = keyed(docs).drop("doc_id")
    paths = staged(in_tasks(
        texts, path_rows, "key_a long, key_b long, start int, n_edges int, anchor long, path long"), "paths")
    # written, so that the join reads both sides from shuffles of their own and can split a frequent anchor
    anchors = staged(paths.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("path") != F.max("path")).alias("branches")).where("n > 1").drop("n"), "anchors")
    met = staged(paths.join(anchors, "anchor"), "met-paths")
    distinct = met.groupBy(*CLASS, "branches").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "n_edges")).alias("at"))
    distinct = staged(distinct.select(*CLASS, "branches", (F.col("n") == 1).alias("single"), "at.*"), "distinct-paths")
    of_docs = distinct.groupBy(*KEY).agg(F.collect_list(F.struct(*PATH)).alias("paths"))
    pieces = staged(in_tasks(
        texts.join(of_docs, KEY).select(*KEY, "text", "paths"), edge_rows,
        "anchor long, path long, head long, tail long, n_edges int, edge long, single boolean, key_a long, key_b long, "
        "first int"), "pieces")

    classes = pieces.where("edge IS NULL").select(*CLASS, "head", "tail", "n_edges").dropDuplicates(CLASS)
    chains = staged(compacted(classes), "compacted")
    # a document may hold the ends of a chain at the right distance with other words between them: its paths stay apart then
    whole = met.join(chains, CLASS).groupBy(*KEY, "root", (F.col("start") - F.col("distance")).alias("origin")).agg(
        F.collect_set(F.struct("start", "n_edges")).alias("parts"))
    first, last = F.array_min("parts"), F.array_max("parts")
    n_edges = F.aggregate("parts", F.lit(0), lambda total, x: total + x["n_edges"])
    whole = whole.withColumn("spans", F.when(
        last["start"] + last["n_edges"] - first["start"] == n_edges,
        F.array(F.struct(first["start"].alias("start"), n_edges.alias("n_edges")))).otherwise(F.col("parts")))
    whole = whole.select(*KEY, F.inline("spans")).select(
        *KEY, F.col("start").alias("first"), (F.col("start") + F.col("n_edges") + (WINDOW - 1)).alias("after"))

    edges = pieces.where("edge IS NOT NULL")
    repeated = staged(edges.groupBy("anchor", "edge").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "edges")
    single = edges.where("single").join(repeated, ["anchor", "edge"]).select(
        *KEY, "first", (F.col("first") + WINDOW).alias("after"))
    return whole.unionAll(single)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's text without the words that repeated spans cover."""
    spans = repeated_spans(docs).groupBy(*KEY).agg(F.collect_set(F.struct("first", "after")).alias("spans"))
    d = keyed(docs).join(spans, KEY, "left").select("doc_id", "text", "spans")
    return in_tasks(d, kept_rows, "doc_id string, n_words long, n_removed long, kept string", ids=("doc_id",))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
