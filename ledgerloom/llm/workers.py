"""Python tasks over a frame."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

import ledgerloom

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only


def hand_back() -> None:
    """Give the system back the memory that this process has freed; glibc keeps what lies between pieces still in use."""
    if _trim:
        _trim(0)


def handing_back(work: Callable) -> Callable:
    """The ``work`` of a task, after which its worker, which outlives it, hands back what it has freed."""

    def task(batches: Iterator) -> Iterator:
        yield from work(batches)
        hand_back()

    return task


def _with_library(df: DataFrame) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(ledgerloom.__file__)))
    paths = df.sparkSession.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), root]))


def in_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this library on the path as in ``in_tasks``; ids of any type keep their nulls."""
    _with_library(df)
    return df.mapInArrow(handing_back(work), schema)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches of a task, cut so that the texts of each have about ``size`` bytes; empty ones are left out."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.binary())
        ends = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in lengths])
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def in_tasks(df: DataFrame, work: Callable, schema: str, ids: tuple[str, ...] = ()) -> DataFrame:
    """``df.mapInPandas``, with this library on the path of Python workers that share the driver's folders.

    On a cluster the library is installed or shipped with the job. The columns ``ids`` go through Python as strings
    (and are strings in ``schema``), since pandas would make floats of numbers with nulls among them.
    """
    _with_library(df)
    types = dict(df.dtypes)
    out = df.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(handing_back(work), schema)
    return out.withColumns({c: F.col(c).cast(types[c]) for c in ids if c in out.columns})


def spread(files: DataFrame) -> DataFrame:
    """Rows that name files, dealt to as many tasks as a shuffle has: they are few and small, what they name isn't."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path")
