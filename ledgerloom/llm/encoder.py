"""Token ids of many texts at once.

A byte-level tokenizer cuts a text at each single space or line break between two other characters, whatever
stands around it. So a text is encoded as its words, each with the space or break before it, and a word that a task has
met before is not encoded again. Texts with other white space between words are encoded whole.

It also cuts a word between letters, numbers and other characters, which the tokenizer itself tells apart. So of a new word
only the pieces are encoded that have not been met either, be it as words or in other words. Words that have an apostrophe, white
space or an added token in them stay whole.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm.arrays import Texts

MOST_KNOWN, MOST_IDS = 2_500_000, 1 << 26  # words and pieces, and their ids; then they are forgotten and learned anew
AT_ONCE = 1 << 15  # new words that are taken up together
_MARK = np.array([0x51ED270B35E9A1C7, 0], np.uint64)  # without and with a space before it
_WHITE = np.array([c for c in range(0x3001) if chr(c).isspace()])  # there is none above
_MIXED = 4  # the kind of a character that is no letter (1), number (2) or sign (3), or not always cut off from them
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder for a tokenizer file, kept by a worker from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; one text at a time has no use for more
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        (self.line_break,) = self.whole("\n")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.kinds = np.zeros(0x110000, np.uint8)  # of characters; 0: not asked yet
        self.kinds[[ord("'"), *_WHITE]] = _MIXED
        if self._n_pieces("a1!a!1a") != 7:
            self.kinds[:] = _MIXED  # another rule
        self._forget()

    def _forget(self) -> None:
        # tables of known words and pieces: their keys in order, the place of their ids in the pool, where a line break
        # stands before them, and how many (-1: not to be encoded alone); new tables are merged into the last one until that
        # is the larger one
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of words, and which words are known."""
        at, length, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for table, ats, lengths in self.tables:
            open_keys = np.flatnonzero(~known)
            place = np.searchsorted(table, keys[open_keys])
            place[place == len(table)] = 0
            hit = table[place] == keys[open_keys]
            found, place = open_keys[hit], place[hit]
            at[found], length[found], known[found] = ats[place], lengths[place], True
        return at, length, known

    def whole(self, text: str) -> np.ndarray:
        # the library's plain call also works out the string and place of each token, at the cost of the ids again
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, self.dtype)

    def _n_pieces(self, text: str) -> int:
        return len(self.pre_tokenizer.pre_tokenize_str(text)) if self.pre_tokenizer else 1

    def _cut(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[str, np.ndarray]:
        """The pieces of ``n`` words, with a line break after each, and how many each word has."""
        for c in np.unique(codes[self.kinds[codes] == 0]).tolist():
            self.kinds[c] = next((k for k, x in enumerate("a1!", 1) if self._n_pieces(x + chr(c)) == 1), _MIXED)
        kinds, whole = self.kinds[codes], np.zeros(n, bool)
        whole[owner[(kinds == _MIXED) & (codes != 10) & (codes != 32)]] = True
        text = codes.tobytes().decode("utf-32-le")
        for a in self.added:
            if a in text:
                whole |= np.array([a in w for w in text.split("\n")[:-1]])
        cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) & (np.maximum(kinds[1:], kinds[:-1]) < _MIXED)) + 1
        cuts = cuts[~whole[owner[cuts]]]
        return np.insert(codes, cuts, 10).tobytes().decode("utf-32-le"), 1 + np.bincount(owner[cuts], minlength=n)

    def _add(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin in the pool, to which they are added."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _ids(self, at: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.pool[np.repeat(at - (ends - length), length) + np.arange(ends[-1])]

    def _pieces(self, text: str, counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Place and number of the ids of words, from those of their pieces, and which have several; what the tables lack now."""
        t = Texts([text])
        spaced = t.data[t.starts - 1] == 32
        keys, which = np.unique(t.hashes ^ _MARK[spaced.astype(np.int8)], return_inverse=True)
        at, length, known = self._find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            place = np.empty(len(keys), np.int64)
            place[which] = np.arange(len(which))
            place = place[new]
            ids = self.whole(_lines(t.data, (t.starts - spaced)[place], t.stops[place])[:-1])
            ids = np.concatenate([np.array([self.line_break], self.dtype), ids])
            breaks = np.flatnonzero(ids == self.line_break)
            at[new], length[new] = self._add(ids) + breaks + 1, np.diff(breaks, append=len(ids)) - 1
        first = np.cumsum(counts) - counts
        word_at, word_length = at[which[first]], np.add.reduceat(length[which], first)
        several = counts > 1
        if several.any():  # their pieces' ids end to end, after the line break before the first
            begins, use = np.zeros(len(which), np.int64), np.repeat(several, counts)
            begins[first] = 1
            begins, use = begins[use], which[use]
            n, sizes = length[use] + begins, word_length[several] + 1
            word_at[several] = self._add(self._ids(at[use] - begins, n, np.cumsum(n))) + np.cumsum(sizes) - sizes + 1
        return (word_at, word_length, several), (keys[new], at[new], length[new])

    def _learn(self, keys: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Take up words, each with the space before it, if any, and a line break after it; place and number of their ids."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        breaks = codes == 10
        owner, ends = np.cumsum(breaks) - breaks, np.flatnonzero(breaks)
        starts = np.concatenate([[0], ends[:-1] + 1])
        starts += codes[starts] == 32
        fit = ~(np.isin(codes[starts], _WHITE) | np.isin(codes[ends - 1], _WHITE))
        at, length, own = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64), ~fit
        tables = []
        if fit.any():
            if not fit.all():
                codes, owner = codes[fit[owner]], (np.cumsum(fit) - 1)[owner[fit[owner]]]
            (at[fit], length[fit], own[fit]), pieces = self._pieces(*self._cut(codes, owner, int(fit.sum())))
            tables.append(pieces)
        # a word of one piece is that piece
        tables.append((keys[own], at[own], length[own]))
        table = _in_order(tables)
        while self.tables and len(self.tables[-1][0]) < 4 * len(table[0]):
            table = _in_order([self.tables.pop(), table])
        self.tables.append(table)
        return at, length

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        t = Texts(texts)
        if not len(t.hashes):
            return [self.whole(x or "") for x in texts]
        owner, before = t.owners(), t.data[t.starts - 1]
        first = np.zeros(len(owner), bool)
        first[t.bounds[:-1][t.counts > 0]] = True
        spaced, broken = ~first & (before == 32), ~first & (before != 32)
        text_starts = np.concatenate([[0], t.ends[:-1]])
        gap = t.starts - np.concatenate([[0], t.stops[:-1]])
        odd = np.where(first, t.starts != text_starts[owner], (gap != 1) | ((before != 32) & (before != 10)))
        last = t.bounds[1:] - 1
        irregular = np.bincount(owner, odd, minlength=len(texts)) > 0
        irregular |= (t.counts == 0) | (t.stops[last] != t.ends - 1)

        keys, which = np.unique(t.hashes ^ _MARK[spaced.astype(np.int8)], return_inverse=True)
        if sum(len(table[0]) for table in self.tables) > MOST_KNOWN or self.used > MOST_IDS:
            self._forget()
        at, length, known = self._find(keys)
        somewhere = np.empty(len(keys), np.int64)
        somewhere[which] = np.arange(len(which))
        unknown = np.flatnonzero(~known)
        for new in np.split(unknown, range(AT_ONCE, len(unknown), AT_ONCE)):
            if len(new):
                place = somewhere[new]
                at[new], length[new] = self._learn(
                    keys[new], _lines(t.data, (t.starts - spaced)[place], t.stops[place]))
        at, length = at[which], length[which]
        irregular |= np.bincount(owner, length < 0, minlength=len(texts)) > 0
        at -= broken
        length = np.where(length < 0, 0, length + broken)
        ends = np.cumsum(length)
        ids = self._ids(at, length, ends)
        bounds = np.concatenate([[0], ends])[t.bounds]
        return [
            self.whole(texts[i] or "") if irregular[i] else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


def _lines(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> str:
    """Stretches of UTF-8 bytes, with a line break after each."""
    n = stops - starts + 1
    ends = np.cumsum(n)
    lines = data[np.repeat(starts - (ends - n), n) + np.arange(ends[-1])]
    lines[ends - 1] = 10
    return lines.tobytes().decode("utf-8", "replace")


def _in_order(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables as one, sorted by its keys; places and numbers take 32 bits."""
    keys = np.concatenate([t[0] for t in tables])
    order = np.argsort(keys, kind="stable")
    at, length = (np.concatenate([t[i].astype(np.int32, copy=False) for t in tables])[order] for i in (1, 2))
    return keys[order], at, length
