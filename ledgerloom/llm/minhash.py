"""Near-duplicate groups by MinHash with fast similarity sketching.

A document's set holds its distinct five-word shingles. The sketch has 128 bins: in each round, all shingles are hashed
into bins anew, and a bin that is still empty takes the least hash it gets. A set of n shingles is through after about
128 ln 128 / n rounds; after 128 rounds, round 128 + i sends everything to bin i, so every bin fills.

Documents with equal sets are one node. The sketch is cut into 32 bands of 4 bins. Nodes that agree in a band meet there,
and those that agree in enough bins are compared by their full sets: two sets with a similarity of 0.75 miss each other
in all bands once in 200,000 cases, and the bin test leaves out as few. Nodes that meet are compared in
tiles of bounded size; a tile gives out a tree over those of its nodes that are linked, never all its pairs. Shingles
are compared as 64-bit hashes, sets found equal by 128 bits.

Defined results: a document without words has no set, is linked with nothing and is its own component. One with under
five words has its whole sequence as one shingle. A null doc_id takes part but names a component only if all ids in
it are null. Rows that repeat an id share its component if their texts do. An empty table gives an empty result; only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import text as tx
from ledgerloom.llm.arrays import Texts, chunks, mix, runs
from ledgerloom.llm.graph import components
from ledgerloom.llm.substrings import KEY, keyed
from ledgerloom.llm.workers import in_tasks
from ledgerloom.workspace import staged

SHINGLE = 5
PERCENT = 75
BINS, ROWS = 128, 4
LEAST_EQUAL = 72  # bins; sets with a similarity of 0.75 agree in 96 on average, with a deviation of 5
FILTER = 1 << 25  # bits
TILE = 256  # nodes; a tile compares two such parts of a bucket
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(2**64 - 1)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles, in order of both."""
    owners, n = texts.owners(), len(texts.hashes)
    hashes = runs(texts.hashes, SHINGLE)
    whole = owners[:len(hashes)] == owners[n - len(hashes):]
    owner, hashes = owners[:len(hashes)][whole], hashes[whole]
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < SHINGLE))
    whole_texts = [runs(texts.hashes[texts.bounds[i]:texts.bounds[i + 1]], int(texts.counts[i])) for i in short]
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes, *whole_texts])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]


def sketches(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` sets, 16 bits from the hash in each bin; zeros for an empty set."""
    out, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    open_sets = np.bincount(owner, minlength=n) > 0
    for turn in range(2 * BINS):
        use = open_sets[owner]
        if not use.all():
            owner, hashes = owner[use], hashes[use]
        if not len(owner):
            break
        value = mix(hashes + _ROUND * np.array(turn, np.uint64))
        bins = (value >> np.uint64(57)).astype(np.int64) if turn < BINS else np.full(len(value), turn - BINS)
        got = np.full(n * BINS, _MAX, np.uint64)
        np.minimum.at(got, owner * BINS + bins, value)
        new = ~filled & (got != _MAX)
        out[new] = got[new]
        filled |= new
        open_sets &= ~filled.reshape(n, BINS).all(axis=1)
    return mix(out).astype(np.uint16).reshape(n, BINS)


def nodes_of(owner: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """16 bytes that tell each set from others."""
    parts = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for i, p in enumerate(parts):
        np.add.at(p, owner, mix(hashes ^ np.array(0xA5A5A5A5 + 7 * i, np.uint64)))
    return [a.tobytes() for a in np.ascontiguousarray(np.stack(parts, axis=1))]


def sketch_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames, "text"):
        texts = Texts(frame["text"].tolist(), lower=True)
        owner, hashes = shingles(texts)
        n = len(frame)
        yield pd.DataFrame({
            "doc_id": frame["doc_id"].array, **{k: frame[k].to_numpy() for k in KEY},
            "n_shingles": np.bincount(owner, minlength=n),
            "node": nodes_of(owner, hashes, n),
            "bands": list(sketches(owner, hashes, n).view(np.int64)),
        })


def by_group(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of a task sorted by ``keys``, cut between groups only."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        ids = frame[keys].to_numpy()
        last = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
        if len(last):
            yield frame.iloc[:last[-1] + 1]
            frame = frame.iloc[last[-1] + 1:].reset_index(drop=True)
        rest = frame
    if rest is not None and len(rest):
        yield rest


def group_ids(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    ids = frame[keys].to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    return np.cumsum(new)


def stretches(frame: pd.DataFrame, keys: list[str], size: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """A frame of whole groups in parts of whole groups, whose texts have about ``size`` characters each."""
    lengths = frame["text"].str.len().to_numpy(dtype=np.int64)
    group = group_ids(frame, keys)
    starts = np.flatnonzero(np.diff(group, prepend=0))
    part = ((np.cumsum(lengths) - lengths)[starts] // size)[group - 1]
    for rows in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
        yield frame.iloc[rows[0]:rows[-1] + 1]


TILES = ["band", "key", "part_a", "part_b"]


def likely_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the nodes in a tile, those that some other one of it is likely to be linked with: sizes allow it, enough bins
    agree, and no earlier band has both (the pair is looked at there)."""
    for frame in by_group(frames, TILES):
        bands = np.stack(frame["bands"].to_numpy())
        bins = bands.view(np.uint16).reshape(len(frame), BINS)
        size, band, group = (frame["n_shingles"].to_numpy(), frame["band"].to_numpy(), group_ids(frame, TILES))
        hit = np.zeros(len(frame), bool)
        step = 1
        rows = np.arange(len(frame))
        while True:
            rows = rows[rows < len(frame) - step]
            rows = rows[group[rows] == group[rows + step]]
            if not len(rows):
                break
            a, b = rows, rows + step
            fit = 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
            a, b = a[fit], b[fit]
            for i in range(0, len(a), 4096):
                x, y = a[i:i + 4096], b[i:i + 4096]
                like = (bins[x] == bins[y]).sum(axis=1) >= LEAST_EQUAL
                x, y = x[like], y[like]
                earlier = (bands[x] == bands[y]) & (np.arange(BINS // ROWS) < band[x][:, None])
                fresh = ~earlier.any(axis=1)
                hit[x[fresh]] = hit[y[fresh]] = True
            step += 1
        yield frame.loc[hit, [*TILES, "node", *KEY]]


def equal_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares."""
    n = len(sets)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(at, minlength=len(every)) > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, column = owner[use], column[at[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float64)
    n_columns = int(shared.sum())
    width = min(n_columns, max(1024, (1 << 22) // n))  # of the 0/1 matrix that is held at once
    for first in range(0, n_columns, width or 1):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def linked_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the nodes of each tile, links from the first node of a component to all others of it."""
    for frame in (part for whole in by_group(frames, TILES) for part in stretches(whole, TILES)):
        texts = Texts(frame["text"].tolist(), lower=True)
        owner, hashes = shingles(texts)
        found = nodes_of(owner, hashes, len(frame))
        bounds = np.searchsorted(owner, np.arange(len(frame) + 1))
        nodes, group = frame["node"].map(bytes).tolist(), group_ids(frame, TILES)
        links = []
        for rows in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group)) + 1):
            own = {nodes[i]: i for i in rows if nodes[i] == found[i]}
            rows = list(own.values())
            if len(rows) < 2:
                continue
            sets = [hashes[bounds[i]:bounds[i + 1]] for i in rows]
            both, size = equal_counts(sets), np.array([len(s) for s in sets])
            linked = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
            seen = np.zeros(len(rows), bool)
            for first in range(len(rows)):
                if seen[first]:
                    continue
                seen[first], front = True, [first]
                while front:
                    reached = np.flatnonzero(linked[front].any(axis=0) & ~seen)
                    seen[reached], front = True, reached.tolist()
                    links += [(nodes[rows[first]], nodes[rows[i]]) for i in front]
        yield pd.DataFrame(links, columns=["node_a", "node_b"])


def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose KEY is among those of ``keys``, and a few others.

    The keys set bits of a filter that is broadcast: 64 bits in a row, at most FILTER / 64 rows whatever the input. The more keys
    there are, the more other rows pass.
    """
    word = F.expr(f"pmod(key_a, {FILTER}) div 64").alias("word")
    bit = F.expr("shiftleft(1L, int(pmod(key_a, 64)))").alias("bit")
    words = keys.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(words), "word")
    return met.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    texts = keyed(docs)
    d = staged(in_tasks(
        texts, sketch_rows, "doc_id string, key_a long, key_b long, n_shingles long, node binary, bands array<long>",
        ids=("doc_id",)), "sketches")
    vertex = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("node")).alias("vertex")
    nodes = staged(d.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(*KEY)).alias("at"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")).select("node", vertex, "at", "n_shingles", "bands"), "nodes")

    short = F.xxhash64("node")
    in_bands = nodes.select(short.alias("short"), F.posexplode("bands").alias("band", "key"))
    buckets = in_bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.when(F.col("n") <= 2 * TILE, 1).otherwise(F.ceil(F.col("n") / TILE))
    met = in_bands.join(buckets, ["band", "key"]).withColumn("parts", parts.cast("int"))
    met = met.withColumn("part", F.pmod("short", F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("short", "band", "key", F.least("part", "other").alias("part_a"),
                     F.greatest("part", "other").alias("part_b"))
    likely = met.join(nodes.withColumn("short", short), "short").select(
        *TILES, "node", "n_shingles", "bands", "at.*")
    likely = staged(in_tasks(
        likely.repartition(*TILES).sortWithinPartitions(*TILES), likely_rows,
        "band int, key long, part_a int, part_b int, node binary, key_a long, key_b long"), "likely")
    # one text for each node, whatever its id has beside it; most others are left out before anything is shuffled
    own = maybe_among(texts.select(*KEY, "text"), likely).dropDuplicates(KEY)
    full = likely.join(own, KEY).select(*TILES, "node", "text").repartition(*TILES).sortWithinPartitions(*TILES)
    links = in_tasks(full, linked_rows, "node_a binary, node_b binary")
    names = nodes.select("node", "vertex")
    links = links.join(names.toDF("node_a", "a"), "node_a").join(names.toDF("node_b", "b"), "node_b")
    roots = components(links)
    named = names.join(roots, "vertex", "left").select(
        "node", F.coalesce(F.col("root.doc_id"), F.col("vertex.doc_id")).alias("component_id"))
    with_words = d.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id")
    without = d.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionAll(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least id; of rows equal in id and text, one."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("id")).distinct()
    d = tx.rows(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi")
    return d.withColumns({"id": F.col("row.doc_id"), "text": F.col("row.text")}).dropDuplicates(
        ["id", "text"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
