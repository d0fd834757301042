"""Equi-joins in which one key may hold a third of the rows of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import BROADCAST_ROWS

#: Rows of one key that one task should see at most, of the big and of the small side, and pairs it should make.
ROWS_PER_SPLIT = 1_000_000
SMALL_ROWS_PER_SPLIT = 100_000
PAIRS_PER_SPLIT = 20_000_000


def key_splits(
    small: DataFrame, keys: list[str], sizes: DataFrame, per_split: int, small_per_split: int, pairs_per_split: int
) -> DataFrame:
    """Keys that need more than one split: `_a` cuts of the big side and `_b` of the small side.

    A key's work is the rows it has on both sides and the pairs they make, so the
    cuts follow ``df`` of ``sizes``, the key's rows in ``small`` and their product.
    """
    asked = small.groupBy(*keys).agg(F.count("*").alias("_asked"))
    load = asked.join(sizes, [k for k in keys if k in sizes.columns], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    b = F.ceil(F.col("_asked") / small_per_split)
    pairs = F.col("df").cast("double") * F.col("_asked") / pairs_per_split
    # No finer than one row of the big side; what is left over is cut on the small side.
    a = F.least(F.greatest(F.ceil(F.col("df") / per_split), F.ceil(pairs / b)), F.col("df"))
    cut = load.select(*keys, a.cast("int").alias("_a"), F.least(F.greatest(b, F.ceil(pairs / a)), F.col("_asked")).cast("int").alias("_b"))
    return cut.where("_a > 1 or _b > 1")


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    sizes: DataFrame,
    spread_by: str,
    spread_small_by: str,
    per_split: int = ROWS_PER_SPLIT,
    small_per_split: int = SMALL_ROWS_PER_SPLIT,
    pairs_per_split: int = PAIRS_PER_SPLIT,
) -> DataFrame:
    """Inner join of ``big`` and ``small`` on ``keys`` with hot keys cut on both sides.

    ``sizes`` holds the row count ``df`` of every key of ``big`` that matters, by all or
    some of ``keys``. A hot key becomes a grid: its big rows are dealt to `_a` cuts by a
    hash of ``spread_by`` and repeated for each of `_b` cuts, its small rows the other way
    round, and each cell of the grid is a key of its own. All other keys have one cell.
    Hot keys are counted, and while they are few they go to the rows, so that neither
    side is shuffled on the bare key before it is cut.
    """
    hot = key_splits(small, keys, sizes, per_split, small_per_split, pairs_per_split)
    hot_keys = hot.count()
    if not hot_keys:
        return big.join(small, keys)
    if hot_keys <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    a, b = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))

    def cut(side: DataFrame, by: str, mine: str, other: str, n, repeats) -> DataFrame:
        dealt = side.join(hot, keys, "left").withColumn(mine, F.pmod(F.xxhash64(by), n).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), repeats - 1))).drop("_a", "_b")

    left = cut(big, spread_by, "_row", "_column", a, b)
    right = cut(small, spread_small_by, "_column", "_row", b, a)
    return left.join(right, [*keys, "_row", "_column"]).drop("_row", "_column")
