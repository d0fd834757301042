"""Term postings, corpus statistics and their on-disk layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.strings import analyze
from shelfspark.session import kept, over_all_cores, scratch_path

Analyzer = Callable[[Column], Column]


#: Fixed values of the similarity.
K1, B = 1.2, 0.75

#: Documents in a block, the unit that a search may leave out.
BLOCK_DOCS = 1 << 16


def impact(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """What one term adds to a score, without the query's weight: 0 to 1."""
    return tf / (tf + F.lit(K1) * (1 - B + B * dl / avg_dl))


def field_tokens(
    docs: DataFrame, fields: list[str], analyzer: Analyzer = analyze, id_col: str = "id", length: Analyzer = F.size
) -> DataFrame:
    """`field, id, dl, tokens`: one row per document and non-empty field. ``length`` of the tokens is the field's."""
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), analyzer(F.col(f)).alias("tokens")) for f in fields])
    )
    return (
        docs.select(F.col(id_col).alias("id"), per_field.alias("f"))
        .select("f.field", "id", length(F.col("f.tokens")).alias("dl"), "f.tokens")
        .where("dl > 0")
    )


def count_terms(tokens: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """`field, term, id, tf, dl` from token rows.

    With a ``vocabulary`` (distinct ``term``), other terms are dropped before
    anything is shuffled for counting.
    """
    exploded = tokens.select("field", "id", "dl", F.explode("tokens").alias("term"))
    if vocabulary is not None:
        exploded = exploded.join(vocabulary, "term", "left_semi")
    return exploded.groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf")).select(
        "field", "term", "id", "tf", "dl"
    )


def build_postings(docs: DataFrame, fields: list[str], analyzer: Analyzer = analyze, id_col: str = "id") -> DataFrame:
    return count_terms(field_tokens(docs, fields, analyzer, id_col))


#: Stands for the document itself: one row per document and field, so that field
#: statistics need no second pass over the texts. No analyzer makes this term.
WHOLE = ""


def _with_whole(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("tokens", F.concat(F.array(F.lit(WHOLE)), "tokens"))


#: Documents whose postings one task of ``store_index`` counts (expected), and tokens that it counts at a time.
PART_DOCS, PART_TOKENS = 2_000, 1 << 20


def _counted(rows: pa.RecordBatch) -> pa.Table:
    """`field, term, block, id, tf, dl` of token rows; rows of one id and length are one document."""
    words = rows.column("tokens").flatten().dictionary_encode()
    ids = rows.column("id").dictionary_encode(null_encoding="encode")
    fields, dl = rows.column("field").dictionary_encode(), rows.column("dl").to_numpy().astype(np.int64)
    codes = lambda x: x.indices.to_numpy().astype(np.int64)
    key = (codes(fields) * len(ids.dictionary) + codes(ids)) * (dl.max() + 1) + dl
    first, doc = np.unique(key, return_index=True, return_inverse=True)[1:]
    n = len(words.dictionary) + 1  # number 0 is the document itself
    of = np.repeat(doc, rows.column("tokens").value_lengths().to_numpy())
    pairs, tf = np.unique(np.concatenate([doc * n, of * n + codes(words) + 1]), return_counts=True)
    at = pa.array(first[pairs // n])
    terms = pa.concat_arrays([pa.array([WHOLE], words.dictionary.type), words.dictionary]).take(pa.array(pairs % n))
    field, block, id, length = (rows.column(c).take(at) for c in ("field", "block", "id", "dl"))
    return pa.table({"field": field, "term": terms, "block": block, "id": id, "tf": pa.array(tf, pa.int64()), "dl": length})


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """`field, term, block, n, docs`: the `n` postings of each term in each block, in the order of the terms."""
    rows = rows.combine_chunks()
    fields, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("field", "term"))

    def places(column: pa.DictionaryArray) -> np.ndarray:
        order = pc.sort_indices(column.dictionary).to_numpy()
        return np.argsort(order)[column.indices.to_numpy()].astype(np.int64)

    block = rows.column("block").to_numpy().astype(np.int64)
    key = (places(fields) * len(terms.dictionary) + places(terms)) * (block.max() + 1) + block
    order = np.argsort(key, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
    sorted_rows = rows.take(pa.array(order)).combine_chunks()
    docs = pa.StructArray.from_arrays([sorted_rows.column(c).combine_chunks() for c in ("id", "tf", "dl")], names=["id", "tf", "dl"])
    docs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), docs)
    heads = [sorted_rows.column(c).combine_chunks().take(pa.array(starts)) for c in ("field", "term", "block")]
    return pa.RecordBatch.from_arrays([*heads, docs.value_lengths(), docs], names=["field", "term", "block", "n", "docs"])


def _pack(whole_blocks: bool):
    """Packs token rows that lie in the order of `block, id`; a block has one row a term if ``whole_blocks``, else an id is in one row."""
    group, most = ["block"] if whole_blocks else ["block", "id"], PART_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the group that may go on
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("tokens").value_lengths().to_numpy())])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
                rows = batch.slice(lo, hi - lo)
                last = [rows.column(c)[-1] for c in group]
                found = _counted(rows)
                same = [pc.is_null(found.column(c)) if not v.is_valid else pc.fill_null(pc.equal(found.column(c), v), False) for c, v in zip(group, last)]
                same = same[0] if whole_blocks else pc.and_(*same)
                done, rest = found.filter(pc.invert(same)), found.filter(same)
                if done.num_rows:
                    yield _packed(_merged([*held, done]))
                    held = []
                held = [_merged([*held, rest])]
                lo = hi
        if held:
            yield _packed(held[0])

    return run


def _merged(parts: list[pa.Table]) -> pa.Table:
    """Counts of documents that go on from one part to the next are one."""
    if len(parts) == 1:
        return parts[0]
    keys = ["field", "term", "block", "id", "dl"]
    return pa.concat_tables(parts).group_by(keys).aggregate([("tf", "sum")]).rename_columns({"tf_sum": "tf"}).select(parts[0].column_names)


def _unpacked(packed: DataFrame) -> DataFrame:
    """`field, term, id, tf, dl, block`, without the rows that stand for documents."""
    each = packed.where(F.col("term") != WHOLE).select("field", "term", "block", F.explode("docs").alias("d"))
    return each.select("field", "term", "d.id", "d.tf", "d.dl", "block")


def packed_impacts(packed: DataFrame, stats: DataFrame) -> DataFrame:
    """`field, term, block, top` for each packed row."""
    rated = packed.where(F.col("term") != WHOLE).join(F.broadcast(stats), "field")  # as many rows as fields
    top = F.array_max(F.transform("docs", lambda d: impact(d["tf"], d["dl"], F.col("avg_dl"))))
    return rated.select("field", "term", "block", top.alias("top"))


@dataclass(frozen=True)
class TextIndex:
    """Stored postings, document frequencies and field statistics of a set of documents.

    ``impacts`` holds the largest impact of each term in each block of documents. An
    index of one block has none, as there is nothing to leave out. Blocks that one task
    counts as wholes are rows of the packed postings, so their impacts are read off these.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    impacts: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        packed, terms, stats, layout = (spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "stats", "layout"))
        row = layout.first()
        impacts = None if row["blocks"] == 1 else packed_impacts(packed, stats) if row["whole_blocks"] else spark.read.parquet(f"{path}/impacts")
        return TextIndex(_unpacked(packed), terms, stats, impacts)


def finish_index(postings: DataFrame, path: str, blocks: int) -> TextIndex:
    """Writes what follows from ``postings``, which were written to ``path``."""
    spark = postings.sparkSession
    stored = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    words = stored.where(F.col("term") != WHOLE)

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(part.schema).parquet(f"{path}/{name}")

    terms = written(document_frequency(words), "terms")
    stats = written(field_stats(stored.where(F.col("term") == WHOLE)).coalesce(1), "stats")
    impacts = block_impacts(words, stats)
    if blocks == 1:
        written(spark.createDataFrame([], impacts.schema), "impacts")
        return TextIndex(words, terms, stats)
    return TextIndex(words, terms, stats, written(impacts, "impacts"))


def block_impacts(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """`field, term, block, top`: the largest impact of a term in a block."""
    rated = postings.join(F.broadcast(stats), "field")  # as many rows as fields
    return rated.groupBy("field", "term", "block").agg(F.max(impact(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("top"))


def _blocks(docs: DataFrame, block_docs: int) -> int:
    return max(1, -(-docs.count() // block_docs))


def _in_blocks(postings: DataFrame, blocks: int) -> DataFrame:
    return postings.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def store_index(
    docs: DataFrame,
    fields: list[str],
    path: str,
    analyzer: Analyzer = analyze,
    id_col: str = "id",
    length: Analyzer = F.size,
    block_docs: int = BLOCK_DOCS,
) -> TextIndex:
    """Writes the full index, to be searched any number of times.

    Documents are dealt by their block, or by their id where a block is too much for a task, so all postings of a
    document are counted in one task and only texts are shuffled. Each file holds its documents'
    postings in runs in the order of the terms, one row for each term and block.
    """
    spark, total = docs.sparkSession, docs.count()
    blocks = max(1, -(-total // block_docs))
    whole = blocks > 1 and total <= blocks * PART_DOCS
    place = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    tasks = max(-(-total // PART_DOCS), min(total, spark.sparkContext.defaultParallelism), 1)
    dealt = docs.select(*dict.fromkeys([id_col, *fields])).repartition(tasks, place if whole else F.col(id_col)).sortWithinPartitions(place, id_col)
    tokens = _in_blocks(field_tokens(dealt, fields, analyzer, id_col, length), blocks)
    kind = tokens.schema["id"].dataType.simpleString()
    packed = tokens.mapInArrow(_pack(whole), f"field string, term string, block int, n int, docs array<struct<id: {kind}, tf: bigint, dl: int>>")
    packed.write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(packed.schema).parquet(f"{path}/postings")

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(part.schema).parquet(f"{path}/{name}")

    terms = written(stored.where(F.col("term") != WHOLE).groupBy("field", "term").agg(F.sum("n").alias("df")), "terms")
    each = stored.where(F.col("term") == WHOLE).select("field", F.explode("docs.dl").alias("dl"))
    stats = written(field_stats(each).coalesce(1), "stats")
    written(spark.createDataFrame([(blocks, whole)], "blocks int, whole_blocks boolean").coalesce(1), "layout")
    impacts = None if blocks == 1 else packed_impacts(stored, stats)
    if blocks > 1 and not whole:
        impacts = written(impacts.groupBy("field", "term", "block").agg(F.max("top").alias("top")), "impacts")
    return TextIndex(_unpacked(stored), terms, stats, impacts)


def index_for(
    vocabulary: DataFrame, docs: DataFrame, fields: list[str], analyzer: Analyzer, id_col: str = "id", block_docs: int = BLOCK_DOCS
) -> TextIndex:
    """Postings of some terms only, for one batch of queries over unindexed documents.

    Written once to the shared folder, since the search reads them several times.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    blocks = _blocks(docs, block_docs)
    # Cutting the texts into words takes nearly all of the time, so they are dealt to all cores first.
    tokens = field_tokens(over_all_cores(docs.select(*dict.fromkeys([id_col, *fields]))), fields, analyzer, id_col)
    wanted = vocabulary.unionByName(spark.createDataFrame([(WHOLE,)], "term string"))
    postings = _in_blocks(count_terms(_with_whole(tokens), wanted), blocks)
    postings.write.parquet(f"{path}/postings")
    return finish_index(postings, path, blocks)


#: Ranges that the sorted dictionary is cut into, and characters of a range's first term that are kept.
TERM_RANGES, RANGE_CHARS = 128, 32


def terms_of_prefixes(dictionary: DataFrame, prefixes: DataFrame, ranges: int = TERM_RANGES) -> DataFrame:
    """`prefix, term`: the dictionary's terms that begin with each prefix.

    The dictionary (distinct ``term``) is cut into ranges of its sorted order, whose few
    first terms are all that is gathered. Terms that begin with a prefix lie
    between it and the prefix with the last character there is, so a prefix meets
    the ranges between these two only.
    """
    dictionary = dictionary.select("term")
    first = dictionary.repartitionByRange(ranges, "term").groupBy(F.spark_partition_id().alias("p")).agg(F.min("term").alias("t"))
    bounds = sorted(r["t"] for r in first.select(F.substring("t", 1, RANGE_CHARS).alias("t")).collect())
    starts = F.array(*[F.lit(b) for b in bounds]).cast("array<string>")

    def place(x: Column) -> Column:
        return F.size(F.filter(starts, lambda b: b <= x))

    last = place(F.concat("prefix", F.lit("\U0010ffff")))
    asked = prefixes.select("prefix").distinct().withColumn("_range", F.explode(F.sequence(place(F.col("prefix")), last)))
    met = dictionary.withColumn("_range", place(F.col("term"))).join(asked, "_range")
    return met.where(F.col("term").startswith(F.col("prefix"))).select("prefix", "term")


def prefix_index(index: TextIndex, prefixes: DataFrame) -> TextIndex:
    """An index in which each prefix is a term, made of the postings of the whole terms that begin with it."""
    found = terms_of_prefixes(index.terms.select("term").distinct(), prefixes)
    merged = (
        index.postings.join(found, "term")
        .groupBy("field", F.col("prefix").alias("term"), "block", "id", "dl")
        .agg(F.sum("tf").alias("tf"))
    )
    postings = kept(merged, "prefix-postings")
    terms = kept(document_frequency(postings), "prefix-terms")
    impacts = None if index.impacts is None else kept(block_impacts(postings, index.stats), "prefix-impacts")
    return TextIndex(postings, terms, index.stats, impacts)


def field_stats(tokens: DataFrame) -> DataFrame:
    """`field, n_docs, avg_dl`: one row per field."""
    return tokens.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """`field, term, df`. Postings hold a document once per term, so rows are documents."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """`field, term, df, n_docs, avg_dl` for every term."""
    tokens = field_tokens(docs, fields, id_col=id_col)
    # One row per field name given: the broadcast side is as long as ``fields``.
    return document_frequency(count_terms(tokens)).join(F.broadcast(field_stats(tokens)), "field")
