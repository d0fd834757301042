"""Catalog CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfspark.schema import RAW_CATALOG

_FORMAT = {"header": "true", "quote": '"', "escape": '"'}


#: The text of a row whose cells don't fit the header; null in all other rows.
MALFORMED = "malformed_row"


def scan_with_malformed(
    spark: SparkSession, path: str, schema: StructType = RAW_CATALOG, multi_line: bool = True
) -> DataFrame:
    """Every row of the file, with the text of those that have too few or too many cells in ``MALFORMED``.

    Every column is text (no inference pass); quoted cells may span lines.

    A multi-line file cannot be split, so a large catalog should be many files, or be
    read with ``multi_line=False`` if no cell spans lines.
    Empty cells are null. All cells are parsed whatever columns are used later, or a row
    would look whole to a job that reads few of them.
    """
    rows = (
        spark.read.schema(StructType([*schema.fields, StructField(MALFORMED, StringType())]))
        .options(**_FORMAT, multiLine=str(multi_line).lower(), nullValue="", emptyValue="", mode="PERMISSIVE", enforceSchema="false")
        .options(columnNameOfCorruptRecord=MALFORMED, columnPruning="false")
        .csv(path)
    )
    # Spark reads no file for this column alone, so it hangs on a condition on a cell that always holds.
    always = F.coalesce(F.length(schema.names[0]), F.lit(0)) >= 0
    return rows.withColumn(MALFORMED, F.when(always, F.col(MALFORMED)))


def scan_catalog_csv(
    spark: SparkSession, path: str, schema: StructType = RAW_CATALOG, multi_line: bool = True
) -> DataFrame:
    """The well-formed rows of the file; :func:`scan_with_malformed` has the others too."""
    return scan_with_malformed(spark, path, schema, multi_line).where(F.col(MALFORMED).isNull()).drop(MALFORMED)


def write_catalog_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file per partition, header in each, no index column."""
    df.write.mode(mode).options(**_FORMAT, nullValue="", emptyValue='""', quoteAll="false").csv(path)
