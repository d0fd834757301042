"""Prices and lists that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.strings import is_blank, strip

#: Numbers a price may be written as. Spark's cast alone would also take `1d`, `1f`, `inf`.
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """Text to double, null if it is no number; `_` may stand between digits."""
    bare = F.regexp_replace(strip(c), r"(?<=\d)_(?=\d)", "")
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def clean_price(c: Column) -> Column:
    """`$1,234.50` to 1234.5; empty or unreadable text to null."""
    return to_number(F.regexp_replace(c, "[$,]", ""))


def price_or_zero(c: Column) -> Column:
    """Blank text is 0, unreadable text is null (and meant for quarantine)."""
    return F.when(strip(c) == "", F.lit(0.0)).otherwise(to_number(c))


def price_or_null(c: Column) -> Column:
    """Missing or NaN to null."""
    number = c.cast("double")
    return F.when(~F.isnan(number), number)


def price_error(c: Column, name: str) -> Column:
    """Reason text if a filled-in price cannot be read, else null."""
    return F.when(~is_blank(c) & to_number(c).isNull(), F.concat(F.lit(f"bad {name}: "), c))


def list_split_raw(c: Column) -> Column:
    """`[a, b]` cut at commas; quotes and spaces stay; empty text gives one empty item."""
    return F.split(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), ",", -1)


def list_parse_clean(c: Column) -> Column:
    """`["a", "b"]` to its items without quotes and outer spaces; empty or null to no items."""
    bare = F.replace(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), F.lit('"'), F.lit(""))
    items = F.transform(F.split(bare, ",", -1), strip)
    return F.when(bare != "", items).otherwise(F.array().cast("array<string>"))


def list_to_json(c: Column) -> Column:
    return F.to_json(c)


__all__ = [
    "clean_price",
    "list_parse_clean",
    "list_split_raw",
    "list_to_json",
    "price_error",
    "price_or_null",
    "price_or_zero",
    "to_number",
]
