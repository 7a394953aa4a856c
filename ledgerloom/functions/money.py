"""Fees, net amounts and unit changes, in exact decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from ledgerloom.schemas import FINE_MONEY, MONEY

# The marketplace keeps 4% and 40 cents per order, the store keeps 5%.
FEE_PERCENT = 4
FEE_FLAT_CENTS = 40
STORE_KEEPS_PERCENT = 5


def cents_to_amount(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def amount_to_cents(amount: Column) -> Column:
    """Whole cents; digits below a cent are cut."""
    return (amount * 100).cast("bigint")


def order_fee(amount: Column) -> Column:
    """Fee on one order, to a hundredth of a cent."""
    percent = F.lit(Decimal(FEE_PERCENT) / 100)
    return (amount * percent + F.lit(Decimal(FEE_FLAT_CENTS) / 100)).cast(FINE_MONEY)


def net_cents(cents: Column) -> Column:
    """Order cents after the percentage fee, cut to whole cents, and the flat fee."""
    percent = F.call_function("div", cents * FEE_PERCENT, F.lit(100).cast("bigint"))
    return cents - percent - FEE_FLAT_CENTS


def net_amount(kind: Column, amount: Column, fee: Column) -> Column:
    """What a ledger row adds to the balance: expenses take away, all else is amount less fee."""
    return F.when(kind == "expense", -F.abs(amount)).otherwise(amount - fee).cast(FINE_MONEY)


def usd(c: Column) -> Column:
    """A reported money value."""
    return c.cast("double")
