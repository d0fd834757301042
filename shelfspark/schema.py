"""Table schemas."""

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()
_LIST = T.ArrayType(_S)

LIST_FIELDS = [
    "similar_purchases",
    "most_bought",
    "recommendations",
    "similar_products",
    "other_members_also_purchased",
]
TEXT_FIELDS = ["description", "price_without_discount", "price"]
ANSWER_KEYS = TEXT_FIELDS + LIST_FIELDS

#: Raw catalog file: every column is text until it is parsed.
RAW_CATALOG = T.StructType(
    [T.StructField(c, _S) for c in ["url", "title"] + TEXT_FIELDS + LIST_FIELDS + ["resumen_producto"]]
)
#: The raw file before a short summary was added.
RAW_CATALOG_NO_SUMMARY = T.StructType(RAW_CATALOG.fields[:-1])

#: The object a model answers with.
ANSWER = T.StructType(
    [T.StructField(c, _S) for c in TEXT_FIELDS] + [T.StructField(c, _LIST) for c in LIST_FIELDS]
)

PRODUCT = T.StructType(
    [
        T.StructField("url", _S),
        T.StructField("title", _S),
        T.StructField("description", _S),
        T.StructField("price_without_discount", _D),
        T.StructField("price", _D),
        *[T.StructField(c, _LIST) for c in LIST_FIELDS],
        T.StructField("product_resume", _S),
        T.StructField("product_context", _S),
        T.StructField("context_updated_at", T.TimestampType()),
        T.StructField("description_embedding", T.ArrayType(T.FloatType())),
    ]
)

#: Products as they are extracted from a page, and pages whose answer is unusable.
EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), *PRODUCT.fields[:10]])
QUARANTINE = T.StructType([T.StructField("page_id", T.LongType())] + [T.StructField(c, _S) for c in ("url", "answer", "error")])

FRONTIER = T.StructType(
    [
        T.StructField("url", _S),
        T.StructField("already_scraped", T.BooleanType()),
        T.StructField("first_seen", T.LongType()),
    ]
)

QUERY = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("query", _S), T.StructField("limit", T.IntegerType())]
)

HIT = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("title", _S),
        T.StructField("description", _S),
        T.StructField("price", _D),
        T.StructField("url", _S),
        T.StructField("resumen", _S),
        T.StructField("source", _S),
        T.StructField("original_score", _D),
        T.StructField("score", _D),
        T.StructField("rank", T.IntegerType()),
    ]
)

RUN = T.StructType(
    [
        T.StructField("job", _S),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("processed_count", T.LongType()),
        T.StructField("error", _S),
    ]
)
