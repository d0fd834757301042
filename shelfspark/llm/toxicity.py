"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both models have orders 2 and 1. The count of a pair of words is discounted and
backs off to how many different words the second one follows (its continuation
count) in the class, and that to the continuation counts of both classes together.
Each order is also interpolated with a model that the classes share, whose weight
falls with the count that a class of this size would be expected to have: what is
rare is carried by the shared model and says little.
A text's evidence is the difference of its log-likelihoods divided by its tokens; a
logistic curve turns it into a score.

A factor of the likelihoods up to a limit is taken to be of a language or a topic;
only what a word or pair has beyond it counts. Entries with nothing beyond add 0 and aren't stored. A model of bounded size goes to the tasks; a larger one is joined
with those words and pairs of the texts that a bitmap of its keys lets through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shelfspark.llm.batches import add_columns, mix, quoted, slices
from shelfspark.llm.decontaminate import tokens
from shelfspark.llm.graph import BROADCAST_KEYS, stored
from shelfspark.session import BROADCAST_ROWS, at_most

DISCOUNT = 0.75
#: Expected count of a word, and of a pair, at which a class's own model and the shared one weigh the same.
SHARED, SHARED_PAIRS = 0.5, 2.0
#: Ratio of likelihoods that is taken to be of a language or a topic, not of a tone; what goes beyond counts.
LEAST_RATIO = 4.0
#: Model entries that go to the tasks (16 bytes each).
BLOCK_ENTRIES = 2_000_000
#: Bits of a larger model's bitmap for each entry, and the logarithm of the most bits it may have (64 MB).
ENTRY_BITS, MOST_BITS = 8, 29
#: Bits in one row that ``bitmap_construct_agg`` returns.
_CHUNK = 15
#: Labelled rows on which the logistic curve is fitted, taken by the hash of their id.
CALIBRATION_ROWS = 100_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key of the word, key of the word and the one before) of each token.

    Words have 32 bits in a pair's key; the few that collide are one word to the models.
    """
    row, *_, value, _ = tokens(texts)
    word = (value >> np.uint64(32)).astype(np.int64)
    before = np.zeros(len(word), np.int64)
    if len(word):
        before[1:] = np.where(row[1:] == row[:-1], word[:-1], 0)
    # The lowest bit of a history is set, so that no pair looks like a word.
    history = (before & 0x7FFFFFFF) | 1
    return row, word, history << 32 | word


def count_pairs(labelled: DataFrame, text: str, toxic: str) -> DataFrame:
    """(pair, toxic, ordinary): how many texts of each class hold each pair of words; summed by slice first.

    A text counts once, so a word that one text repeats a thousand times is no evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            row, _, pair = grams(part.column(0))
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
            label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row[new]]
            keys, at = np.unique(pair[new], return_inverse=True)
            bad = np.bincount(at, weights=label, minlength=len(keys)).astype(np.int64)
            good = np.bincount(at, weights=1 - label, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bad), pa.array(good)], names=["pair", "toxic", "ordinary"])

    counted = labelled.select(quoted(text), quoted(toxic).cast("int")).mapInArrow(run, "pair long, toxic long, ordinary long")
    return counted.groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _beyond(difference: Column) -> Column:
    """What a log-likelihood difference has beyond the least ratio."""
    return F.signum(difference) * F.greatest(F.abs(difference) - math.log(LEAST_RATIO), F.lit(0.0))


def _with(pairs: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``pairs`` with the columns of ``other`` (stored), a row for each key; few rows go to the pairs."""
    return pairs.join(F.broadcast(other) if at_most(other, BROADCAST_ROWS) else other, key)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(key, weight): what a word, or a pair beyond its word, adds to the log-likelihood difference.

    All labelled rows and all their words and pairs count, also those of a single text.
    Without rows of both classes the model is empty.
    """
    pairs = stored(count_pairs(labelled, text, toxic), "pair-counts").select(
        "*", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("word"), F.shiftright("pair", 32).alias("history")
    )
    by_word = stored(
        pairs.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("ordinary") > 0).alias("o"), F.count("*").alias("n")),
        "continuations",
    )
    sums = by_word.agg(
        F.sum("t"), F.sum("o"), F.sum("n"), F.count_if(F.col("t") > 0), F.count_if(F.col("o") > 0)
    ).first()
    all_t, all_o, all_n, words_t, words_o = (float(x or 0) for x in sums)
    if not all_t or not all_o:
        return labelled.sparkSession.createDataFrame([], "key long, weight double")
    share = F.col("n") / all_n

    def word_rate(seen: str, kinds: float, total: float) -> Column:
        """The class's likelihood of a word in units of the shared one."""
        own = F.greatest(F.col(seen) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * share
        return (own + SHARED) / (total * share + SHARED)

    lower = stored(
        by_word.select("word", share.alias("share"), word_rate("t", words_t, all_t).alias("r_toxic"), word_rate("o", words_o, all_o).alias("r_ordinary")),
        "words",
    )
    of_word = _beyond(F.log(F.col("r_toxic") / F.col("r_ordinary")))
    histories = stored(
        pairs.groupBy("history").agg(F.sum("toxic").alias("h_toxic"), F.sum("ordinary").alias("h_ordinary"), F.count("*").alias("kinds")),
        "histories",
    )
    both = F.col("h_toxic") + F.col("h_ordinary")

    def pair_rate(kind: str) -> Column:
        """The same of a word after its history; what the discount takes backs off to the class's words."""
        mine, rate = F.col(f"h_{kind}"), F.col(f"r_{kind}")
        own = F.greatest(F.col(kind) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") / both * mine * F.col("share") * rate
        return (own + SHARED_PAIRS * rate) / ((F.col("toxic") + F.col("ordinary")) * mine / both + SHARED_PAIRS)

    of_pair = _beyond(F.log(pair_rate("toxic") / pair_rate("ordinary")))
    words = lower.select(F.col("word").alias("key"), of_word.alias("weight"))
    beyond = _with(_with(pairs, histories, "history"), lower, "word").select(F.col("pair").alias("key"), (of_pair - of_word).alias("weight"))
    return words.unionByName(beyond).where("weight != 0")


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(model: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each key of ``model``, set in tasks and gathered in parts of 4 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _CHUNK), pa.array(at & (1 << _CHUNK) - 1)], names=["part", "bit"])

    parts = model.select("key").mapInArrow(run, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("set")).collect()
    out = np.zeros((1 << bits - _CHUNK, 1 << _CHUNK - 3), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["set"], np.uint8)
    return out.ravel()


def evidence(docs: DataFrame, model: DataFrame, text: str, keep: list[str], out: str = "evidence") -> DataFrame:
    """Columns ``keep`` and ``out``, the log-likelihood difference by token (0 for texts without tokens)."""
    entries = model.count()
    kept = [quoted(c) for c in keep]
    if entries > BLOCK_ENTRIES:
        return _joined(docs, model, entries, text, keep, out)
    rows = model.toPandas().sort_values("key")
    keys, weights = rows["key"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)

    def compute(texts: pa.Array) -> list[pa.Array]:
        row, word, pair = grams(texts)
        total = np.zeros(len(texts))
        for found in (word, pair) if len(keys) else ():
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            total += np.bincount(row, weights=np.where(keys[at] == found, weights[at], 0.0), minlength=len(texts))
        count = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        return [pa.array(total / count)]

    scored = add_columns(docs.select(*kept, quoted(text).alias("_text")), "_text", StructType([StructField("_sum", DoubleType())]), compute)
    return scored.select(*kept, F.round("_sum", 9).alias(out))


def _joined(docs: DataFrame, model: DataFrame, entries: int, text: str, keep: list[str], out: str) -> DataFrame:
    """``evidence`` by a join: each text's words and pairs that the bitmap lets through meet the model by key."""
    kept = [quoted(c) for c in keep]
    bits = min(MOST_BITS, max(_CHUNK, math.ceil(math.log2(ENTRY_BITS * entries))))
    filled = _bitmap(model, bits)

    def compute(texts: pa.Array) -> list[pa.Array]:
        row, word, pair = grams(texts)
        both, rows = np.concatenate([word, pair]), np.concatenate([row, row])
        at = _bits(both, bits)
        some = (filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        order = np.argsort(rows[some], kind="stable")
        ends = np.cumsum(np.bincount(rows[some], minlength=len(texts)))
        keys = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), both[some][order]).cast(pa.list_(pa.int64()))
        return [pa.array(np.bincount(row, minlength=len(texts)).astype(np.int64)), keys]

    fields = StructType([StructField("_tokens", LongType()), StructField("_keys", ArrayType(LongType()))])
    asked = docs.select(*kept, F.monotonically_increasing_id().alias("_row"), quoted(text).alias("_text"))
    # Stored, as the numbers of the rows must stay what they are.
    texts = stored(add_columns(asked, "_text", fields, compute, keep=[*keep, "_row"]), "text-keys")
    sums = texts.select("_row", F.explode("_keys").alias("key")).join(model, "key").groupBy("_row").agg(F.sum("weight").alias("_sum"))
    mean = F.coalesce("_sum", F.lit(0.0)) / F.greatest("_tokens", F.lit(1))
    return texts.join(sums, "_row", "left").select(*kept, F.round(mean, 9).alias(out))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a little ridge; a flat curve at the share of ones without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    scale = max(float(x.std()), 1e-9)
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(id: Column) -> Column:
    """Rows whose labels nothing is learned from. A null id is not held out; it has no label either."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def toxicity(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", threshold: float = 0.7
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Labels of rows with crc32(id) mod 3 = 1 are never used. Remainder 0 gives the
    counts, remainder 2 the logistic curve, so the curve is fitted on texts that the
    models haven't seen. An id labelled both ways counts as toxic; null labels don't
    count. Null and empty texts have evidence 0 and get the score of that; without
    labels all scores are 0.5. Repeated rows are scored each; other columns don't matter.
    """
    known = stored(
        labels.where(quoted(toxic).isNotNull() & quoted(id).isNotNull() & ~held_out(quoted(id)))
        .groupBy(quoted(id).alias("_id"))
        .agg(F.max(quoted(toxic)).alias("_toxic")),
        "known-labels",
    )
    few = known.count() <= BROADCAST_KEYS
    counted = known.where(F.crc32(F.col("_id").cast("string")) % 3 == 0)
    rows = docs.select(quoted(id).alias("_id"), quoted(text).alias("_text"))
    model = stored(fit(rows.join(F.broadcast(counted) if few else counted, "_id"), "_text", "_toxic"), "toxicity-model")
    scored = stored(evidence(docs, model, text, [id]), "evidence")
    sample = (
        scored.select(quoted(id).alias("_id"), "evidence")
        .join(known.where(F.crc32(F.col("_id").cast("string")) % 3 == 2), "_id")
        .orderBy(F.xxhash64("_id"), "_id", "evidence")
        .limit(CALIBRATION_ROWS)
        .select("evidence", F.col("_toxic").cast("double"))
        .toPandas()
    )
    slope, offset = logistic(sample["evidence"].to_numpy(float), sample["_toxic"].to_numpy(float))
    score = F.round(1 / (1 + F.exp(-(F.col("evidence") * slope + offset))), 6)
    return scored.select(
        quoted(id).alias("doc_id"), held_out(quoted(id)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )
