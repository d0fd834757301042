"""Models as columns: a plug for external ones and deterministic stand-ins.

The stand-ins replace hosted models that cannot be reached from a job; they are
rules, not imitations of those models.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfspark.functions.strings import analyze, once, strip
from shelfspark.functions.templates import CONTEXT_TEMPLATE, fill
from shelfspark.operators.postings import TextIndex
from shelfspark.operators.rows import SCORE_DECIMALS
from shelfspark.session import over_all_cores, scratch_path, with_computed

#: Vector length and batch size of the models in use.
DIMS = 1536
BATCH = 32

TextModel = Callable[[Sequence[str]], Sequence]


class _Patient:
    """A model called with retries, each after a longer wait, and at most so many texts a second."""

    def __init__(self, model: TextModel, retries: int, wait: float, texts_per_second: float | None):
        self.model, self.retries, self.wait, self.rate = model, retries, wait, texts_per_second
        self.free_at = 0.0

    def __call__(self, texts: list[str]) -> list:
        for attempt in range(self.retries + 1):
            if self.rate:
                time.sleep(max(0.0, self.free_at - time.monotonic()))
                self.free_at = time.monotonic() + len(texts) / self.rate
            try:
                answers = list(self.model(texts))
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
                return answers
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError


def apply_text_model(
    df: DataFrame,
    text: str,
    out: str,
    factory: Callable[[], TextModel],
    batch_size: int = BATCH,
    returns: str = "string",
    retries: int = 0,
    wait: float = 0.5,
    texts_per_second: float | None = None,
) -> DataFrame:
    """Adds ``out``, of type ``returns``, and ``{out}_error`` from a model that reads lists of texts.

    ``factory`` runs once per Python worker. A failed call is repeated ``retries`` times,
    after ``wait`` seconds and then twice as long each time; then its texts are tried one by one, so
    a bad text only marks its own row. Answers may be text, numbers or arrays
    (an encoder's vectors). ``texts_per_second`` holds for each worker. Null texts are not sent.
    """

    @F.pandas_udf(f"struct<value: {returns}, error: string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _Patient(factory(), retries, wait, texts_per_second)

        def one(item: str) -> tuple:
            try:
                return model([item])[0], None
            except Exception as exc:
                return None, f"{type(exc).__name__}: {exc}"

        for texts in batches:
            answers: list[tuple] = []
            present = texts.dropna()
            for start in range(0, len(present), batch_size):
                chunk = present.iloc[start : start + batch_size].tolist()
                try:
                    answers.extend((a, None) for a in model(chunk))
                except Exception:
                    answers.extend(map(one, chunk))
            frame = pd.DataFrame({"value": pd.Series([a for a, _ in answers], present.index, object), "error": pd.Series([e for _, e in answers], present.index, object)})
            frame = frame.reindex(texts.index).astype(object)
            # Missing rows are None, not NaN, which an array column can't hold.
            yield pd.DataFrame({c: pd.Series([None if isinstance(v, float) and np.isnan(v) else v for v in frame[c]], frame.index, object) for c in frame})

    return (
        df.withColumn("_m", call(F.col(text)))
        .withColumn(out, F.col("_m.value"))
        .withColumn(f"{out}_error", F.col("_m.error"))
        .drop("_m")
    )


@dataclass(frozen=True)
class ModelEncoder:
    """An encoder that lives outside: a model from texts to vectors. It stands wherever a :class:`TextEncoder` does.

    A text that the model fails on gets no vector, so a later backfill asks for it again.
    """

    factory: Callable[[], TextModel]
    batch_size: int = BATCH
    retries: int = 2
    wait: float = 0.5
    texts_per_second: float | None = None

    def encode(self, df: DataFrame, text: str, out: str = "embedding", element: str = "float") -> DataFrame:
        """Adds ``out``, an array of ``element`` numbers; null text gives null."""
        asked = apply_text_model(
            df, text, out, self.factory, self.batch_size, f"array<{element}>", self.retries, self.wait, self.texts_per_second
        )
        # Called once per row, however often the vector is used.
        return with_computed(asked.drop(f"{out}_error"), **{out: F.col(out)})


def _buckets(text: Column, dims: int) -> Column:
    """Each token's bucket number, as text: the first 32 bits of its MD5, modulo ``dims``."""
    return F.transform(
        analyze(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims).cast("string")
    )


#: Rows whose tokens are counted at a time, and the fields of a stored sparse vector.
_COUNTED_ROWS, _SPARSE = 1024, "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def _bucket_counts(dims: int):
    """`_tokens` to the sparse vector of their buckets' counts; a token's bucket is found once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, _COUNTED_ROWS) for lo in range(0, batch.num_rows, _COUNTED_ROWS)):
                tokens = part.column("_tokens")
                words = tokens.flatten().dictionary_encode()
                bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims for t in words.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(part.num_rows), tokens.value_lengths().to_numpy())
                cells, n = np.unique(row * dims + bucket[words.indices.to_numpy()], return_counts=True)
                ends = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * dims), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((cells % dims, pa.int32()), (n, pa.float64()))]
                sizes = [pa.array(np.full(part.num_rows, x), t) for x, t in ((0, pa.int8()), (dims, pa.int32()))]
                counts = pa.StructArray.from_arrays([*sizes, *lists], names=["type", "size", "indices", "values"])
                names = [c for c in part.schema.names if c != "_tokens"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], counts], names=[*names, "_counts"])

    return run


class TextEncoder:
    """Text to a unit vector of hashed, idf-weighted token counts. One fit serves queries and documents."""

    def __init__(self, idf: IDFModel, dims: int):
        self.idf, self.dims = idf, dims

    @staticmethod
    def _counts(df: DataFrame, text: str, dims: int) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], "_buckets", "_counts")
        return counter.transform(df.withColumn("_buckets", _buckets(F.col(text), dims))).drop("_buckets")

    @staticmethod
    def fit(df: DataFrame, text: str, dims: int = DIMS) -> TextEncoder:
        counts = TextEncoder._counts(df.where(F.col(text).isNotNull()).select(text), text, dims)
        return TextEncoder(IDF(inputCol="_counts", outputCol="_weighted").fit(counts), dims)

    @staticmethod
    def fit_encode(
        df: DataFrame, text: str, out: str = "embedding", element: str = "float", dims: int = DIMS
    ) -> tuple[TextEncoder, DataFrame]:
        """An encoder fitted on the rows of ``df``, and these rows encoded, with ``out`` in place of ``text``.

        The same as ``fit`` and ``encode``, but the texts, whose analysis takes nearly all of
        the time, are analysed once: their counts are stored and serve both.
        """
        known = over_all_cores(df).withColumn("_known", F.col(text).isNotNull())
        others = known.drop(text).schema.fields
        tokens = known.select(*[f"`{f.name}`" for f in others], analyze(F.col(text)).alias("_tokens"))
        sparse = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], f"_counts {_SPARSE}"])
        path = scratch_path(df.sparkSession, "token-counts")
        tokens.mapInArrow(_bucket_counts(dims), sparse).write.parquet(path)
        # Stored as Spark stores its sparse vectors, and read as these.
        counts = df.sparkSession.read.schema(StructType([*others, StructField("_counts", VectorUDT())])).parquet(path)
        idf = IDF(inputCol="_counts", outputCol="_weighted").fit(counts.where("_known").select("_counts"))
        encoder = TextEncoder(idf, dims)
        return encoder, encoder._vectors(counts, F.col("_known"), out, element).drop("_known")

    def encode(self, df: DataFrame, text: str, out: str = "embedding", element: str = "float") -> DataFrame:
        """Adds ``out``, an array of ``element`` numbers; null text gives null."""
        return self._vectors(self._counts(df, text, self.dims), F.col(text).isNotNull(), out, element)

    def _vectors(self, counts: DataFrame, known: Column, out: str, element: str) -> DataFrame:
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit").transform(self.idf.transform(counts))
        numbers = vector_to_array(F.col("_unit")).cast(f"array<{element}>")
        return with_computed(unit, **{out: F.when(known, numbers)}).drop("_counts", "_weighted", "_unit")

    def save(self, path: str) -> None:
        self.idf.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> TextEncoder:
        idf = IDFModel.load(path)
        return TextEncoder(idf, idf.idf.size)


def term_weights(queries: DataFrame, index: TextIndex, field: str = "description") -> DataFrame:
    """`query_id, weights`: the distinct query terms with their idf in one field of the index."""
    tokens = queries.select(
        "query_id", F.lit(field).alias("field"), F.explode(F.array_distinct(analyze(F.col("query")))).alias("term")
    )
    df = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    return (
        tokens.join(index.terms, ["field", "term"], "left")
        .join(F.broadcast(index.stats), "field")  # as many rows as fields
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("weights"))
    )


def rerank_score(weights: Column, text: Column) -> Column:
    """Share of the query's idf weight whose terms occur in the text, 0..1."""

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, w: acc + w["idf"])

    def share(found: Column) -> Column:
        hit = F.filter(weights, lambda w: F.array_contains(found, w["term"]))
        return total(hit) / F.nullif(total(weights), F.lit(0.0))

    found = F.array_intersect(F.transform(weights, lambda w: w["term"]), analyze(text))
    return F.round(F.coalesce(once(found, share), F.lit(0.0)), SCORE_DECIMALS)


#: Where a general name ends: a measure, a dash between words, a bar, a size or a pack.
_NAME_END = r"(?i)\s+(?:\d+([.,]\d+)?\s?(?:kg|g|mg|lb|oz|l|ml|cl|cm|mm|m|in|w|v|gb|tb|pcs|pz|pzas|pack)\b|[-–—|]\s|size\b|talla\b|pack of\b|paquete\b).*$"


def summarize_title(title: Column) -> Column:
    """Short general name: without text after the last bar, a brand before a comma, and all from a measure, dash or size on."""
    no_shop = strip(F.regexp_replace(title, r"\|[^|]*$", ""))
    no_brand = strip(F.regexp_replace(no_shop, r"^[^,]*,\s*(?=\S)", ""))
    return F.regexp_replace(F.regexp_replace(no_brand, _NAME_END, ""), r"\s+", " ")


def generate_context(title: Column, description: Column) -> Column:
    """Context text made of the known columns; nothing is asked of a model."""
    return strip(fill(CONTEXT_TEMPLATE, title=title, description=description))


__all__ = [
    "BATCH",
    "DIMS",
    "ModelEncoder",
    "TextEncoder",
    "apply_text_model",
    "generate_context",
    "rerank_score",
    "summarize_title",
    "term_weights",
]
