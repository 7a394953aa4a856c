"""Token files: a wavelet matrix of the ids, with rank and select, and the documents they belong to.

Layout: the magic bytes, then sections, then a JSON footer with the places of the sections, its length in 8 bytes and the
magic bytes again. A plane holds one bit of every id, highest bit first; after each plane, ids with a 0 there come
before those with a 1, each in their old order. The bits of a plane are cut into blocks, compressed one by one;
for each block the file holds its place and the ones before it. The documents (id and number of tokens) are an Arrow
stream.
"""

from __future__ import annotations

import json
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard

from ledgerloom.llm.files import reading, writing

MAGIC = b"WVLTOKN1"
BLOCK = 1 << 16  # bits


def write(path: str, ids: np.ndarray, doc_ids: pa.Array, counts: list[int]) -> None:
    pack = zstandard.ZstdCompressor(level=1)
    width = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    with writing(path) as out:
        out.write(MAGIC)
        at, planes = len(MAGIC), []
        for bit in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            bits = packed.tobytes()
            blocks = [pack.compress(bits[i:i + BLOCK // 8]) for i in range(0, len(bits), BLOCK // 8)]
            before = [int(np.bitwise_count(packed[i:i + BLOCK // 8]).sum()) for i in range(0, len(bits), BLOCK // 8)]
            one, zero = np.flatnonzero(ones), np.flatnonzero(~ones)
            planes.append({
                "bit": bit, "zeros": len(zero), "at": at, "sizes": [len(b) for b in blocks],
                "ones": [0, *accumulate(before)],
            })
            for b in blocks:
                out.write(b)
                at += len(b)
            ids = np.concatenate([ids.take(zero), ids.take(one)])
        table = pa.table({"doc_id": doc_ids, "n_tokens": pa.array(counts, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        documents = sink.getvalue().to_pybytes()
        out.write(documents)
        footer = json.dumps({
            "n": len(ids), "planes": planes, "documents": [at, len(documents)], "type": ids.dtype.str}).encode()
        out.write(footer + struct.pack("<q", len(footer)) + MAGIC)


class TokenFile:
    """Reads a token file; single lookups touch one or two blocks of each plane."""

    def __init__(self, path: str):
        self.file = reading(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        length, magic = struct.unpack("<q", tail[:8])[0], tail[8:]
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        footer = json.loads(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        self.n, self.planes, self.dtype = footer["n"], footer["planes"], np.dtype(footer["type"])
        for p in self.planes:
            p["places"] = np.concatenate([[0], np.cumsum(p["sizes"], dtype=np.int64)]) + p["at"]
        self._documents, self.unpack = footer["documents"], zstandard.ZstdDecompressor()

    def close(self) -> None:
        self.file.close()

    def documents(self) -> pa.Table:
        at, length = self._documents
        return pa.ipc.open_stream(self.file.read_at(length, at)).read_all()

    def _bits(self, plane: dict, block: int) -> np.ndarray:
        packed = self.file.read_at(plane["sizes"][block], int(plane["places"][block]))
        return np.unpackbits(np.frombuffer(self.unpack.decompress(packed), np.uint8), bitorder="little").view(bool)

    def _rank(self, plane: dict, i: int) -> int:
        """The ones among the first ``i`` bits."""
        block, rest = divmod(i, BLOCK)
        return plane["ones"][block] + (int(self._bits(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: dict, one: bool, k: int) -> int:
        """The place of the ``k``-th one or zero, from 0."""
        ones = np.array(plane["ones"])
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._bits(plane, block)
        return block * BLOCK + int(np.flatnonzero(bits if one else ~bits)[k - before[block]])

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in self.planes:
            block, rest = divmod(i, BLOCK)
            bits = self._bits(p, block)
            ones = p["ones"][block] + int(bits[:rest].sum())
            if bits[rest]:
                value |= 1 << p["bit"]
                i = p["zeros"] + ones
            else:
                i -= ones
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` among those in [first, last) stand after the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for p in self.planes:
            a, b = self._rank(p, first), self._rank(p, last)
            first, last = (p["zeros"] + a, p["zeros"] + b) if token >> p["bit"] & 1 else (first - a, last - b)
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often an id stands in [first, last)."""
        a, b = self._range(token, first, self.n if last is None else last)
        return b - a

    def find(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence of an id, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in reversed(self.planes):
            one = bool(token >> p["bit"] & 1)
            i = self._select(p, one, i - p["zeros"] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(self.n, self.dtype)
        for p in reversed(self.planes):
            raw = self.file.read_at(int(p["places"][-1]) - p["at"], p["at"])
            bits = b"".join(
                self.unpack.decompress(raw[a:a + s]) for a, s in zip((p["places"][:-1] - p["at"]).tolist(), p["sizes"]))
            ones = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~ones)] = values[:p["zeros"]]
            above[np.flatnonzero(ones)] = values[p["zeros"]:] | self.dtype.type(1 << p["bit"])
            values = above
        return values
