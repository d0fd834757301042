"""Near-duplicate texts: similarity ratio, ranked lists, whole catalogs.

The ratio of two texts is ``round(100 * 2 * LCS / (len a + len b))``. Greedy
dedup walks texts in rank order and drops one if a text kept before it reaches
the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

#: Rows of one candidate group a task compares at a time (twice this many at most).
GROUP_ROWS = 1000
#: Slots of the token frequency table, which is sent to every executor.
SLOTS = 1 << 16


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character (bit-parallel)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    """0..100; equal texts 100, a missing text 0; halves round to even."""
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    return round(100.0 * (2.0 * lcs_length(a, b) / (len(a) + len(b))))


def dedup_results(
    ranked: DataFrame, threshold: int = 95, by: str = "query_id", order: str = "rank", text: str = "text"
) -> DataFrame:
    """Greedy dedup of each query's hit list; kept rows come back as query, rank and text.

    For lists whose length is bounded by the search that made them (its ``size``).
    Lists travel to Python as arrays, many queries per Arrow batch. A list of
    unknown length belongs in :func:`dedup_catalog`.
    """

    @F.pandas_udf("array<boolean>")
    def keep(lists: pd.Series) -> pd.Series:
        def walk(texts) -> list[bool]:
            kept: list[str] = []
            flags = []
            for t in texts:
                flags.append(not any(ratio(t, other) >= threshold for other in kept))
                if flags[-1]:
                    kept.append(t)
            return flags

        return lists.map(walk)

    lists = ranked.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("l"))
    flagged = lists.select(by, F.arrays_zip("l", keep(F.col(f"l.{text}")).alias("kept")).alias("z"))
    return flagged.select(by, F.explode("z").alias("z")).where("z.kept").select(by, f"z.l.{order}", f"z.l.{text}")


# --- Candidates -------------------------------------------------------------------
#
# Let x = (threshold - 0.5) / 100. Ratio >= threshold needs 2*LCS >= x*(la + lb), so
# lengths satisfy lb >= la * x / (2 - x). Turning a into b deletes la - LCS and
# inserts lb - LCS characters; a deletion breaks at most two of a's bigrams, an
# insertion one, so both share at least 3*LCS - la - lb - 1 bigrams (as multisets),
# which is (1.5*x - 1)*(la + lb) - 1 or more. Texts that share o of their tokens share
# one among the first len - o + 1 of each in any common order; rarest first keeps
# the groups small.
#
# Short texts and low thresholds may ask for no common bigram. Such a text keeps all
# its bigrams, for longer partners that do ask for one, and adds two tokens of its
# length: on a scale whose steps are the factor 2 / x - 1, near texts are at most a step
# apart, and share a token.


def _bigrams(text: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        out.append(f"{pair}{seen[pair]}")
    return out


def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


def _needed_overlap(length: int, x: float) -> int:
    """Least number of bigrams a text of this length shares with any near-duplicate; 0 or less if none."""
    shortest_sum = length + length * max(0.0, x) / (2.0 - x)
    return int(np.ceil((1.5 * x - 1.0) * shortest_sum - 1.0 - 1e-9))


def _length_tokens(length: int, x: float) -> list[str]:
    if x <= 0 or length == 0:
        # With x at or under zero, all texts are alike; else only empty ones are like empty ones.
        return ["\x00all"] if x <= 0 else ["\x00empty"]
    step = int(np.floor(np.log(length) / np.log(2.0 / x - 1.0) + 1e-9)) if x < 1 else length
    return [f"\x00{step}", f"\x00{step + 1}"]


def _prefix(text: str, x: float, counts: np.ndarray) -> list[str]:
    if x > 0 and (1.0 - x) * len(text) * 2.0 / x < 1.0:
        return []  # too short for any unequal text to come near
    need = _needed_overlap(len(text), x)
    if need <= 0:
        return [*(_bigrams(text) if x > 2 / 3 else ()), *_length_tokens(len(text), x)]
    tokens = sorted(_bigrams(text), key=lambda t: (counts[_slot(t)], t))
    return tokens[: max(0, len(tokens) - need + 1)]


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How often each slot of the token table is hit: SLOTS numbers, whatever the input size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for frame in frames:
            slots = [_slot(t) for text in frame["text"] for t in _bigrams(text)]
            total += np.bincount(slots, minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})

    counts = np.zeros(SLOTS, dtype=np.int64)
    per_slot = texts.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for row in per_slot.toLocalIterator():  # at most SLOTS rows
        counts[row["slot"]] = row["n"]
    return counts


def _with_tokens(texts: DataFrame, threshold: int) -> DataFrame:
    """Adds each text's prefix ``tokens``; stored, since every round reads them."""
    x = (threshold - 0.5) / 100.0
    counts = _slot_counts(texts)

    @F.pandas_udf("array<string>")
    def prefix(column: pd.Series) -> pd.Series:
        return column.map(lambda t: _prefix(t, x, counts))

    return cut_lineage(texts.withColumn("tokens", prefix(F.col("text"))))


def _candidate_groups(items: DataFrame) -> DataFrame:
    """`token, i, j, part, ...item columns`: groups of bounded size that hold every near-duplicate pair.

    The members of a frequent token are spread over parts; each pair of parts is
    one group, so no task sees more than two parts.
    """
    members = items.withColumn("token", F.explode("tokens")).drop("tokens")
    keys = ["scope", "token"]
    parts = members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = parts.select(*keys, F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    placed = members.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (
        placed.withColumn("other", other)
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("other", "parts")
    )


def _collected(groups: DataFrame) -> DataFrame:
    """One row per group, its members as arrays in rank order.

    A group has at most two parts, so the arrays are bounded, and one Arrow batch
    carries many groups to Python.
    """
    members = F.sort_array(F.collect_list(F.struct("ord", "text", "part", "kept")))
    packed = groups.groupBy("scope", "token", "i", "j").agg(members.alias("m"))
    return packed.where(F.size("m") > 1).select("scope", (F.col("i") == F.col("j")).alias("same"), "m.ord", "m.text", "m.part", "m.kept")


_HIST = 64


def _histograms(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _HIST), dtype=np.int16)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i] = np.bincount(codes % _HIST, minlength=_HIST)
    return out


def _near(texts: list[str], part: np.ndarray, same_part: bool, x: float) -> Iterator[tuple[int, np.ndarray]]:
    """For every row (in rank order): the earlier rows of the group that may be near it.

    Length and letter counts rule most out: texts at distance d differ by at most
    d letters.
    """
    lengths = np.array([len(t) for t in texts])
    hist = _histograms(texts)
    for row in range(1, len(texts)):
        limit = (1.0 - x) * (lengths[:row] + lengths[row]) + 1e-9
        possible = np.abs(lengths[:row] - lengths[row]) <= limit
        if not same_part:
            possible &= part[:row] != part[row]
        rows = np.flatnonzero(possible)
        if len(rows):
            gap = np.abs(hist[rows] - hist[row]).sum(axis=1)
            rows = rows[gap <= limit[rows]]
        if len(rows):
            yield row, rows


def _check(threshold: int) -> None:
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must lie in 0..100")


def _distinct_texts(df: DataFrame, order: str, text: str, scope: str | None) -> DataFrame:
    """`scope, ord, text`: the first of all equal texts. Missing texts resemble nothing."""
    key = F.col(scope).cast("string") if scope else F.lit("")
    return (
        df.where(F.col(text).isNotNull())
        .groupBy(key.alias("scope"), F.col(text).alias("text"))
        .agg(F.min(order).alias("ord"))
        .select("scope", "ord", "text")
    )


def similar_pairs(df: DataFrame, threshold: int = 95, order: str = "ord", text: str = "text", scope: str | None = None) -> DataFrame:
    """`scope, ord, other, ratio`: distinct texts and every earlier text that reaches the threshold.

    All pairs are its result, so its size is that of the clusters squared; use
    :func:`dedup_catalog` to clean a catalog. Under a threshold of about 67 no common
    bigram can be asked for, and all texts of like length are compared, in blocks.
    """
    _check(threshold)
    items = _with_tokens(_distinct_texts(df, order, text, scope), threshold).withColumn("kept", F.lit(False))
    groups = _collected(_candidate_groups(items))
    x = (threshold - 0.5) / 100.0

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for g in frame.itertuples():
                for row, rows in _near(g.text, g.part, g.same, x):
                    values = [(other, ratio(g.text[row], g.text[other])) for other in rows]
                    found.extend((g.scope, g.ord[row], g.ord[o], v) for o, v in values if v >= threshold)
            yield pd.DataFrame(found, columns=["scope", "ord", "other", "ratio"])

    return groups.mapInPandas(pairs, "scope string, ord long, other long, ratio int").distinct()


def dedup_catalog(
    df: DataFrame, threshold: int = 95, order: str = "ord", text: str = "text", scope: str | None = None
) -> DataFrame:
    """The rows greedy dedup keeps, for lists of any length; ``scope`` keeps lists apart.

    Each round keeps the texts without an undecided earlier neighbor, then drops
    the neighbors of kept ones. A group only reports *whether* a text has an
    earlier neighbor, so no pairs are written; but the members of a token that many
    texts share are repeated once per part in every round. Rows with a missing text
    are all kept.
    """
    _check(threshold)
    x = (threshold - 0.5) / 100.0
    items = _with_tokens(_distinct_texts(df, order, text, scope), threshold)

    def verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flags = [(g.scope, g.ord[row], flag) for g in frame.itertuples() for row, flag in judge(g)]
            yield pd.DataFrame(flags, columns=["scope", "ord", "flag"])

    def judge(g) -> Iterator[tuple[int, int]]:
        """Undecided rows with an earlier neighbor: 2 if one is kept, else 1."""
        if g.kept.all():
            return
        for row, rows in _near(g.text, g.part, g.same, x):
            if g.kept[row]:
                continue
            # Kept neighbors decide, so they are looked at first.
            for other in rows[np.argsort(~g.kept[rows], kind="stable")]:
                if ratio(g.text[row], g.text[other]) >= threshold:
                    yield row, 2 if g.kept[other] else 1
                    break

    state = items.withColumn("kept", F.lit(False))
    kept_parts: list[DataFrame] = []
    while True:
        groups = _collected(_candidate_groups(state))
        seen = groups.mapInPandas(verdicts, "scope string, ord long, flag int")
        flags = seen.groupBy("scope", "ord").agg(F.max("flag").alias("flag"))
        judged = cut_lineage(state.where(~F.col("kept")).join(flags, ["scope", "ord"], "left"))
        fresh = judged.where(F.col("flag").isNull()).drop("flag").withColumn("kept", F.lit(True))
        waiting = judged.where(F.col("flag") == 1).drop("flag")
        kept_parts.append(fresh)
        if waiting.isEmpty():
            break
        state = waiting.unionByName(fresh)

    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    key = F.col(scope).cast("string") if scope else F.lit("")
    survivors = kept.select(F.col("scope").alias("_scope"), F.col("ord").alias(order), F.col("text").alias(text))
    # By text too, as two texts may have one rank.
    found = df.where(F.col(text).isNotNull()).withColumn("_scope", key).join(survivors, ["_scope", order, text], "left_semi")
    return found.select(*df.columns).unionByName(df.where(F.col(text).isNull()))


def recommendations(queries: DataFrame, docs: DataFrame, size: int = 20, threshold: int = 95) -> DataFrame:
    """`query_id, rank, text`: autocomplete hits without near-duplicates."""
    from shelfspark.operators.lexical import match_all_terms

    hits = match_all_terms(queries, docs, size).select("query_id", "rank", F.col("product_resume").alias("text"))
    return dedup_results(hits, threshold)


__all__ = ["dedup_catalog", "dedup_results", "lcs_length", "ratio", "recommendations", "similar_pairs"]
