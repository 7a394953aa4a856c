"""Grouping of spelling variants: words that differ by one edit, and the frequent word that each is a form of.

The vocabulary is an acceptor that is composed with a one-edit transducer and with the acceptor again; the accepted paths
of the composed machine are the pairs of near words. The vocabulary is divided by states that
its paths go through: two words of length m that differ by one code point, or words of length m and m + 1, share their
first m // 2 code points or their last m - m // 2, so the pair is found in the acceptor of the words that share this half,
read forwards or backwards. Each such part is an initial state of its own. What a part's words do not share is a minimised acyclic
acceptor, built for some parts at a time, with one arc from its start for each part. A part with too
many words is divided again in the same way, by the half of what is not shared yet, until at most one code point, or two of the
longer words, are left: the alphabet bounds those. A pair is found in one part only, the one that its common beginning fits.

Defined results: a null text has no words. A null doc_id is an empty text where runs are hashed. Rows that repeat id and
text count each time. Words are told apart and ordered by code points. An empty table gives an empty result; only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.workers import in_arrow, text_batches
from ledgerloom.workspace import staged

LEAST_CHARS = 5
LEAST_COUNT = 3
NOISE = 97  # of so many runs, one loses a letter; 0: none does
RUN = re.compile("[A-Za-zÀ-ÿ]+")
PART = 20_000  # words; larger parts are divided
LONG = 64  # code points not shared; parts with more are divided, so that no automaton is deep
HELD = 200_000  # distinct words that a task counts before it gives them out
GROUP = 4_000  # words; parts are composed together up to this number


# counting


def runs_of(text: bytes | None, doc_id, noise: int) -> Counter:
    """How often each word stands in a text; only A-Z become lower case."""
    counts = Counter(RUN.findall((text or b"").lower().decode("utf-8", "replace")))
    if not noise:
        return counts
    out, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def count_rows(noise: int, least_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least_chars]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                counts.update(runs_of(text, doc_id, noise))
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    return work


def vocabulary(
    docs: DataFrame, noise: int = NOISE, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough."""
    counts = in_arrow(docs.select("doc_id", "text"), count_rows(noise, least_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# automata


class Acceptor:
    """A minimised acyclic acceptor of strings that come in order; equal states are one.

    ``arcs[q]`` maps symbols to states, ``final`` holds the accepting ones.
    """

    def __init__(self, strings: list[tuple]):
        self.arcs: list[dict] = []
        self.final: set[int] = set()
        self._known: dict[tuple, int] = {}
        open_states: list[tuple[dict, bool]] = [({}, False)]  # of the last string's path, not yet in the register
        last: tuple = ()
        for s in strings:
            shared = 0
            while shared < min(len(s), len(last)) and s[shared] == last[shared]:
                shared += 1
            self._close(open_states, last, shared)
            open_states += [({}, False) for _ in s[shared:]]
            open_states[-1] = (open_states[-1][0], True)
            last = s
        self._close(open_states, last, 0)
        self.start = self._register(*open_states[0])

    def _close(self, open_states: list, last: tuple, depth: int) -> None:
        while len(open_states) > depth + 1:
            state = self._register(*open_states.pop())
            open_states[-1][0][last[len(open_states) - 1]] = state

    def _register(self, arcs: dict, is_final: bool) -> int:
        key = (is_final, *sorted(arcs.items()))
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            if is_final:
                self.final.add(self._known[key])
        return self._known[key]


# The one-edit transducer: state 0 copies; one arc, a replaced or an inserted symbol, leads to state 1, which copies and accepts.
# Swapping the tapes gives the deletions, so each unordered pair is accepted once.


class Composed:
    """The acceptor, the one-edit transducer and the acceptor again: a state is a pair of the acceptor's states before
    the edit (then both are the same) or after it."""

    def __init__(self, acceptor: Acceptor):
        self.a, self.alive = acceptor, {}

    def ends(self, q: int, r: int) -> list[tuple]:
        """After the edit, both sides read the same: the strings that ``q`` and ``r`` both accept."""
        key = (q, r) if q < r else (r, q)
        if key not in self.alive:
            a, b = self.a.arcs[q], self.a.arcs[r]
            if len(b) < len(a):
                a, b = b, a
            out = [()] if q in self.a.final and r in self.a.final else []
            for c, to in a.items():
                if c in b:
                    out += [(c, *rest) for rest in self.ends(to, b[c])]
            self.alive[key] = out
        return self.alive[key]

    def edits(self, q: int) -> Iterator[tuple[tuple, tuple, int]]:
        """The edits in state ``q``: what each side reads, and the states after it."""
        arcs = sorted(self.a.arcs[q].items())
        for i, (c, to) in enumerate(arcs):
            for d, other in arcs[i + 1:]:
                for end in self.ends(to, other):
                    yield (c, *end), (d, *end)
            for end in self.ends(q, to):
                yield end, (c, *end)

    def pairs(self, q: int, path: tuple = ()) -> Iterator[tuple[tuple, tuple]]:
        """The pairs of strings accepted from ``q``, the path to it before both."""
        stack = [(q, path)]
        found: dict[int, list] = {}
        while stack:
            q, path = stack.pop()
            if q not in found:
                found[q] = list(self.edits(q))
            for u, v in found[q]:
                yield path + u, path + v
            stack += [(to, (*path, c)) for c, to in self.a.arcs[q].items()]


def near_pairs(parts: list[tuple[int, int, int, bool, list[str]]]) -> Iterator[tuple[str, str]]:
    """Pairs of words that one edit tells apart, shorter or smaller ones first, within each part.

    A part has the length m of its shorter words, how many code points all of them share at the beginning and at the end,
    the number that their common beginning has to stay below, if any, and the words.
    """
    strings, words = [], []
    for i, (m, first, last, _, members) in enumerate(parts):
        strings += [(i, *w[first:len(w) - last]) for w in members]
    acceptor = Acceptor(sorted(set(strings)))
    composed = Composed(acceptor)
    for i, state in acceptor.arcs[acceptor.start].items():
        m, first, last, below, members = parts[i]
        head, tail = members[0][:first], members[0][len(members[0]) - last:]
        seen = set()
        for a, b in composed.pairs(state):
            u, v = head + "".join(a) + tail, head + "".join(b) + tail
            if len(u) != m or (u, v) in seen:  # two words of length m + 1 meet in a part of that length
                continue
            seen.add((u, v))
            if below:
                same = 0
                while same < m and u[same] == v[same]:
                    same += 1
                if same >= below:
                    continue
            yield u, v


PLACE = ["m", "first", "last", "below", "key"]


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part, the near pairs of each part."""
    key, members, counts, parts, size = None, [], {}, [], 0

    def out() -> pa.RecordBatch:
        found = list(near_pairs(parts))
        us, vs = [u for u, _ in found], [v for _, v in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(us, pa.string()), pa.array([counts[u] for u in us], pa.int64()), pa.array(vs, pa.string()),
             pa.array([counts[v] for v in vs], pa.int64())], names=["word_a", "n_a", "word_b", "n_b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*PLACE, "word", "n")]
        for *own, word, n in zip(*columns):
            if own != key:
                if len(members) > 1:
                    parts.append((*key[:4], members))
                    size += len(members)
                if size > GROUP:
                    yield out()
                    counts, parts, size = {}, [], 0
                key, members = own, []
            members.append(word)
            counts[word] = n
    if len(members) > 1:
        parts.append((*key[:4], members))
    yield out()


# dividing


def part_key(word: Column, first: Column, last: Column) -> Column:
    """What the words of a part share: their beginning and their end; the lengths tell where one ends."""
    return F.concat(F.substring(word, F.lit(1), first), F.lit("|"), F.substring(word, F.length(word) - last + 1, last))


def divided(rows: DataFrame) -> DataFrame:
    """The rows of parts (m, first, last, below, word, n) in parts that share half of the rest more."""
    gap = F.col("m") - F.col("first") - F.col("last")
    middle = (F.col("first") + F.floor(gap / 2)).cast("int")
    halves = F.array(
        F.struct(middle.alias("first"), F.col("last"), F.col("below")),
        F.struct("first", (F.col("last") + F.ceil(gap / 2)).cast("int").alias("last"),
                 F.when(F.col("below") > 0, F.least("below", middle)).otherwise(middle).alias("below")))
    out = rows.select("word", "n", "m", F.explode(halves).alias("half")).select("word", "n", "m", "half.*")
    return out.withColumn("key", part_key(F.col("word"), F.col("first"), F.col("last")))


def parted(words: DataFrame, least_chars: int, size: int) -> DataFrame:
    """The words in parts of at most ``size``, or of words that differ in one place only."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(lengths).alias("m")).where(F.col("m") >= least_chars)
    zero = F.lit(0).cast("int")
    rows = divided(rows.withColumns({"first": zero, "last": zero, "below": zero}))
    done = []
    while True:
        rows = staged(rows, "parts")
        sizes = rows.groupBy(*PLACE).agg(F.count("*").alias("size"))
        gap = F.col("m") - F.col("first") - F.col("last")
        large = ((F.col("size") > size) & (gap > 1)) | ((F.col("size") > 1) & (gap > LONG))
        large = staged(sizes.where(large).drop("size"), "large-parts")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(large, PLACE, "left_anti"))
        rows = divided(rows.join(large, PLACE, "left_semi").drop("key"))


def near(words: DataFrame, least_chars: int = LEAST_CHARS, size: int = PART) -> DataFrame:
    """(word_a, n_a, word_b, n_b): each pair of words (word, n) that one inserted, deleted or replaced code point tells
    apart, once. No word may be shorter than ``least_chars``, at least 3."""
    rows = parted(words, least_chars, size)
    rows = rows.repartition(*PLACE).sortWithinPartitions(*PLACE, "word")
    return in_arrow(rows, pair_rows, "word_a string, n_a long, word_b string, n_b long")


# forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) of a word lead in the end. Each turn doubles the steps; a form is at
    least twice as frequent as its word, so the chains are short."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("of"), F.col("root").alias("further"))
        moved = staged(at.join(step, F.col("root") == F.col("of"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame, least_chars: int = LEAST_CHARS, size: int = PART) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words (word, n): a word's form is its most frequent near word, if that
    is at least twice as frequent; its root is where forms lead in the end."""
    pairs = near(words, least_chars, size)
    both = pairs.unionAll(pairs.select("word_b", "n_b", "word_a", "n_a")).toDF("word", "n", "other", "other_n")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("own_n"),
        F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("own_n")
    best = staged(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"),
                              F.when(is_form, -F.col("best.less")).alias("form_n")), "best")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
                      F.coalesce("root", "word").alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(staged(vocabulary(docs), "vocabulary"))
