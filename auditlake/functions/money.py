"""Exact decimal money: two places, half up, rounded line by line and then summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, PRICE = "decimal(22,2)", "decimal(22,4)"


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def line_amounts(gross: Column, discount: Column, tax_rate: Column) -> dict[str, Column]:
    """net, tax and total of a line; a discount over the gross amount makes them null (the line is invalid)."""
    net = F.when(discount <= gross, (gross - discount).cast(MONEY))
    tax = money(net * tax_rate / F.lit(100).cast("decimal(3,0)"))
    return {"net_amount": net, "tax_amount": tax, "total_amount": (net + tax).cast(MONEY)}


def effective_unit_price(gross: Column, discount: Column, quantity: Column) -> Column:
    """(gross - discount) / quantity to four places; null unless quantity is positive."""
    return F.when(quantity > 0, F.round((gross - discount) / quantity, 4).cast(PRICE))


def signed(document_type: Column, amount: Column) -> Column:
    """Credit notes count against; a missing amount counts as zero."""
    value = F.coalesce(amount, F.lit(0).cast(MONEY))
    return F.when(document_type == "CREDIT_NOTE", -value).otherwise(value).cast(MONEY)


def quantile_between(count: Column, low: Column, high: Column, quarter: int) -> Column:
    """Quarter/4 quantile of count decimals, by linear interpolation between the two it lies between, exact to six places."""
    part = F.pmod((count - 1) * quarter, F.lit(4)).cast("decimal(2,0)") * F.lit("0.25").cast("decimal(2,2)")
    return (low + (high - low) * part).cast("decimal(24,6)")


def quantile(values: Column, quarter: int) -> Column:
    """Quarter/4 quantile of a sorted array of decimals."""
    at = (F.size(values) - 1) * quarter
    low = F.try_element_at(values, F.floor(at / 4).cast("int") + 1)
    high = F.coalesce(F.try_element_at(values, F.floor(at / 4).cast("int") + 2), low)
    return quantile_between(F.size(values), low, high, quarter)
