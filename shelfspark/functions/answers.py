"""Typed product rows out of free text that holds one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.fields import clean_price
from shelfspark.functions.strings import once
from shelfspark.schema import ANSWER, ANSWER_KEYS
from shelfspark.session import with_computed


def json_block(answer: Column) -> Column:
    """From the first `{` to the last `}`, across lines; null if there is none."""
    block = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)


def strict_json(block: Column) -> Column:
    """The block if it is exactly one well-formed JSON value, else null.

    Wrapping it in an array makes the parser reject trailing text; a second
    element would mean the block held two values.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    second = F.try_variant_get(parsed, "$[1]", "string")
    return F.when(parsed.isNotNull() & second.isNull(), block)


def repair_json(block: Column) -> Column:
    """Single to double quotes, then quotes around every word before a colon."""
    return F.regexp_replace(F.replace(block, F.lit("'"), F.lit('"')), r"(?U)(\w+):", '"$1":')


def parse_json(answer: Column) -> Column:
    """Well-formed JSON text out of an answer: as is, else repaired, else null."""
    return once(json_block(answer), lambda b: F.coalesce(strict_json(b), once(repair_json(b), strict_json)))


def _error(answer: Column, json: Column) -> Column:
    missing = F.array_except(F.array(*map(F.lit, ANSWER_KEYS)), F.json_object_keys(json))
    return (
        F.when(json_block(answer).isNull(), F.lit("no JSON object"))
        .when(json.isNull(), F.lit("unreadable JSON"))
        .otherwise(
            once(missing, lambda m: F.when(F.size(m) > 0, F.concat(F.lit("missing "), F.array_join(m, ","))))
        )
    )


def with_parsed_answer(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds ``json`` and ``error`` (why there is no usable object)."""
    parsed = with_computed(df, json=parse_json(F.col(answer)))
    return with_computed(parsed, error=_error(F.col(answer), F.col("json")))


def with_product_columns(df: DataFrame) -> DataFrame:
    """Typed product columns out of ``json``, read once."""
    fields = F.col("_fields")
    typed = {name: fields[name] for name in ANSWER_KEYS}
    typed.update({name: clean_price(fields[name]) for name in ("price_without_discount", "price")})
    return with_computed(df, _fields=F.from_json("json", ANSWER)).select(
        *df.columns, *[typed[name].alias(name) for name in ANSWER_KEYS]
    )
