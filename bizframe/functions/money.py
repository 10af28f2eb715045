"""Amounts: conversion of currency and units, rounding, tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_price(strategy: str, cost: Column, source_price: Column, percent: float = 0.0) -> Column:
    """The price of a mirrored line: cost, cost plus a percentage, or the source price less a discount."""
    return {
        "cost": cost,
        "cost_plus": cost * (1 + percent / 100),
        "source": source_price,
        "source_discount": source_price * (1 - percent / 100),
    }[strategy]


def convert_quantity(quantity: Column, from_ratio: Column, to_ratio: Column, digits: int = 2) -> Column:
    """Between units of one category, half up."""
    return F.round(quantity * from_ratio / to_ratio, digits)


def signed_round(c: Column, digits: int = 0) -> Column:
    """Half away from zero, as a double; a negative value that becomes zero keeps its sign, as its text does."""
    return F.when(c < 0, -F.round(-c, digits)).otherwise(F.round(c, digits))


def conversion_date(strategy: str, invoice: Column, accounting: Column, source: Column, today: Column) -> Column:
    return {
        "invoice_date": F.coalesce(invoice, accounting, today),
        "accounting_date": F.coalesce(accounting, invoice, today),
        "source_date": F.coalesce(source, today),
        "today": today,
    }[strategy]


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def planned_date(committed: Column, ordered: Column, lead_days: Column) -> Column:
    return F.coalesce(committed, F.date_add(ordered, lead_days))
