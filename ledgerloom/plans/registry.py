"""Registration of named queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.plans import shared_sql
from ledgerloom.sources.tables import Shop
from ledgerloom.sources.views import VIEWS

# Fixed parameters of the registered queries; library functions take them as arguments.
AS_OF_TXN = "2001-08-01 00:00:00"
AS_OF_EVENT = "2024-01-31 00:00:00"
START = "2001-07-01 00:00:00"
GOAL = 2_000_000_000
HORIZON = 60
LEDGER_UNTIL = "1998-06-01 00:00:00"  # orders before this time are in the ledger already


@dataclass(frozen=True)
class Plan:
    run: Callable[[Shop], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(key: str, sql: str | None = None):
    """Register ``run(shop)`` under ``key``, with its checking SQL over the domain views."""

    def register(run: Callable[[Shop], DataFrame]):
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = Plan(run, with_views(sql) if sql else None)
        return run

    return register


def with_views(sql: str) -> str:
    """``sql`` with the views it names, directly or through other views, as common table expressions."""
    definitions = {name: v.sql() for name, v in VIEWS.items()} | shared_sql.VIEWS
    needed: list[str] = []

    def need(text: str) -> None:
        for name in definitions:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(definitions[name])
                needed.append(name)

    need(sql)
    head = ",\n".join(f"{name} AS ({definitions[name]})" for name in needed)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body


def run(key: str, spark: SparkSession, root: str) -> DataFrame:
    return PLANS[key].run(Shop(spark, root))


def by_status_text(counts: Column) -> Column:
    """A map of counts as one text, in order of the keys."""
    entries = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.array_join(entries, "|")


def id_sql(*parts: str) -> str:
    """The id that a row gets from its content, in SQL."""
    text = ", ".join(f"coalesce(concat(length({p}), ':', {p}), '-')" for p in parts)
    return f"CAST(concat('0x', substring(md5(concat({text})), 1, 15)) AS BIGINT)"


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Report exact decimals as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
