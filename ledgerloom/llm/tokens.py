"""Token ids in binary files, one wavelet matrix for each shard.

Documents are range-partitioned by id, so that shards follow each other in the order of ids; a task writes a shard
whenever it has ``SHARD`` tokens, so memory stays bounded by that and the longest document. The list of shards is
written too, and everything read later goes by it: a shard that a lost task has left is written again under
its name, or never read.

Defined results: a null text is empty and has the end id alone. Null ids come first; rows of equal id are ordered by a
hash of their text. An empty table gives no shard and an empty result. Only doc_id and text are read, so other columns
never clash. Strings of special tokens in a text are those tokens, as the tokenizer file has them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.arrays import chunks
from ledgerloom.llm.encoder import encoder
from ledgerloom.llm.sums import running
from ledgerloom.llm.wavelet import TokenFile, write
from ledgerloom.llm.workers import in_tasks, spread
from ledgerloom.workspace import new_folder, staged

VOCABULARY = "byte_bpe_50k.json"
END = 2
SHARD = 1 << 21  # tokens


def encode_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Write the shards of (doc_id, text) into ``folder``; a row for each: part, shard, path, n_docs, n_tokens, and
    tokens_before, of all shards before it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, n_shards, part = encoder(tokenizer), 0, 0
        ids, doc_ids, counts, held = [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal n_shards, held
            path = f"{folder}/{part:07d}-{n_shards:07d}.tokens"
            write(path, np.concatenate(ids), pa.array(doc_ids, pa.int64()), counts)
            row = pd.DataFrame({"part": [part], "shard": [n_shards], "path": [path], "n_docs": [len(counts)],
                                "n_tokens": [held]})
            n_shards, held = n_shards + 1, 0
            for x in (ids, doc_ids, counts):
                x.clear()
            return row

        last = np.array([end], encode.dtype)
        for frame in chunks(frames, "text"):
            part = int(frame["part"].iloc[0])
            texts = frame["text"].where(frame["text"].notna(), None).tolist()
            for i, found in zip(frame["doc_id"].tolist(), encode.encode(texts)):
                ids += [found, last]
                doc_ids.append(int(i) if isinstance(i, str) else None)
                counts.append(len(found) + 1)
                held += len(found) + 1
                if held >= shard:
                    yield close()
        if counts:
            yield close()

    d = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    d = d.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    shards = staged(in_tasks(
        d, work, "part int, shard int, path string, n_docs long, n_tokens long", ids=("doc_id",)), "shards")
    placed = running(shards, [F.col("part"), F.col("shard")], tokens=F.col("n_tokens"))
    return placed.withColumnRenamed("tokens_before", "before").drop("tokens_total")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, before in zip(frame["path"], frame["before"]):
                file = TokenFile(path)
                documents, ids = file.documents(), file.tokens().astype("<u4")
                file.close()
                counts = documents["n_tokens"].to_numpy()
                ends = np.cumsum(counts)
                yield pd.DataFrame({
                    "doc_id": documents["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                    "start": before + ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())],
                })

    return in_tasks(spread(shards.select("path", "before")), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files; the rows that the files hold."""
    folder = new_folder(spark, "tokens")
    return read_documents(encode_shards(docs, public_tokenizers.path(VOCABULARY), folder))


def query(spark, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
