"""Quality rules as a short-circuit cascade, on DataFrame functions alone.

A rule is a measure of the text and a limit. What a rule costs and how much it
rejects is measured on a sample; rules with the most rejections per second come
first, and a later rule's measure is not computed for a text already rejected.
The order changes the cost only: a text is kept if it passes every rule.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.batches import other_columns, quoted
from shelfspark.session import scratch_path

_BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of the sample on which costs and rejections are measured.
SAMPLE_ROWS = 2000
WINDOW = 5


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where a lambda inside ``use`` reads it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of five words, in order."""
    return once(
        words,
        lambda w: F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
            )
        ),
    )


def n_repeat_words(windows: Column) -> Column:
    """Words within a run that the text holds twice or more. Without a repeated run, only a set of hashes is made."""
    def repeated(pairs: Column) -> Column:
        same = lambda p, k: p["h"] == F.get(pairs, k)["h"]
        starts = F.transform(pairs, lambda p, k: F.when(same(p, k + 1) | ((k > 0) & same(p, k - 1)), p["i"]))
        return F.sort_array(F.filter(starts, lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            once(pairs, lambda p: covered(repeated(p)))
        )

    return once(windows, counted)


class Rule(NamedTuple):
    """``bad`` says of the words and the text whether to reject."""

    name: str
    bad: Callable[[Column, Column], Column]


def too_few_words(n_words: Column) -> Column:
    return n_words < 10


def too_repetitive(n_repeat: Column, n_words: Column) -> Column:
    return 100 * n_repeat > 20 * n_words


def too_many_symbols(symbols: Column, n_words: Column) -> Column:
    return 100 * symbols > 30 * n_words


def odd_word_length(chars: Column, n_words: Column) -> Column:
    return (chars > 25 * n_words) | (2 * chars < 3 * n_words)


def too_many_dup_lines(dup: Column, n_words: Column) -> Column:
    """More than one repeated line for every 12 words."""
    return 12 * dup > n_words


RULES = [
    Rule("few_words", lambda w, t: too_few_words(F.size(w))),
    Rule("repetitive", lambda w, t: too_repetitive(n_repeat_words(window_hashes(w)), F.size(w))),
    Rule("symbols", lambda w, t: too_many_symbols(n_symbols(t), F.size(w))),
    Rule("word_length", lambda w, t: odd_word_length(word_chars(w), F.size(w))),
    Rule("dup_lines", lambda w, t: too_many_dup_lines(n_dup_lines(t), F.size(w))),
]


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_words", words(quoted(text)))


def rule_order(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on a random sample of about ``sample_rows`` rows.

    The sample is written once, so a rule's time holds no scan of the table.
    An empty table leaves the order as given.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "rule-sample")
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))
    docs.select(quoted(text).alias("text")).sample(share, seed=7).limit(sample_rows).write.parquet(path)
    sample = _with_words(spark.read.parquet(path), "text")

    def measured(bad: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(bad)).first()[0]
        return time.perf_counter() - start, rejected

    measured(F.size("_words") < 0)  # compiles and warms up
    bare, _ = measured(F.size("_words") < 0)
    worth = {}
    for rule in rules:
        seconds, rejected = measured(rule.bad(F.col("_words"), F.col("text")))
        worth[rule.name] = rejected / max(seconds - bare, 1e-3)
    return sorted(rules, key=lambda r: -worth[r.name])


def rejected_by(rules: list[Rule], words: Column, text: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't computed."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.bad(words, text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", out: str = "rejected_by") -> DataFrame:
    """Adds ``out``: the first rule, in the measured order, that rejects the text; null for texts to keep.

    A null or empty text has no words and is rejected. An empty table stays empty,
    repeated rows stay, a column named like ``out`` is replaced.
    """
    rules = rule_order(docs, text=text) if rules is None else rules
    kept = [quoted(c) for c in other_columns(docs, [out, "_words"])]
    return _with_words(docs, text).select(*kept, rejected_by(rules, F.col("_words"), quoted(text)).alias(out))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds all measures, each computed once: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [quoted(c) for c in other_columns(docs, [*names, "_words", "_windows"])]
    w, t = F.col("_words"), quoted(text)
    return (
        _with_words(docs.select(*kept), text)
        .select(
            *kept,
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_symbols(t).alias("n_symbols"),
            n_dup_lines(t).alias("n_dup_lines"),
            window_hashes(w).alias("_windows"),
        )
        .select(*kept, *names[:4], n_repeat_words(F.col("_windows")).alias("n_repeat_words"))
    )


#: The rules on measures already at hand, in the names of ``measures``.
MEASURED = {
    "few_words": lambda: too_few_words(F.col("n_words")),
    "repetitive": lambda: too_repetitive(F.col("n_repeat_words"), F.col("n_words")),
    "symbols": lambda: too_many_symbols(F.col("n_symbols"), F.col("n_words")),
    "word_length": lambda: odd_word_length(F.col("word_chars"), F.col("n_words")),
    "dup_lines": lambda: too_many_dup_lines(F.col("n_dup_lines"), F.col("n_words")),
}


def first_rejection(rules: list[Rule]) -> Column:
    """As ``rejected_by``, over the columns of ``measures``."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(MEASURED[rule.name](), F.lit(rule.name)).otherwise(verdict)
    return verdict
