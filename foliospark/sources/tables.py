"""Readers of the project's tables. A reader asks Parquet only for the columns and nested fields it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT_TYPES = {
    "label": T.StringType(),
    "text": T.StringType(),
    "bbox": T.ArrayType(T.DoubleType()),
    "padded_bbox": T.ArrayType(T.DoubleType()),
    "reading_order": T.IntegerType(),
    "figure_path": T.StringType(),
    "confidence": T.DoubleType(),
    "page_number": T.IntegerType(),
    "context_text": T.StringType(),
}
RECORD_TYPES = {"rec_id": T.LongType(), "source": T.StringType(), "source_file": T.StringType(), "ingested_at": T.TimestampType()}


def recognition_schema(fields: list[str] | None = None, columns: list[str] | None = None) -> T.StructType:
    """Schema of recognition_json with the given element fields and record columns (all by default)."""
    element = T.StructType([T.StructField(k, t) for k, t in ELEMENT_TYPES.items() if fields is None or k in fields])
    page = T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("elements", T.ArrayType(element))])
    head = [T.StructField(k, t) for k, t in RECORD_TYPES.items() if columns is None or k in columns]
    return T.StructType([*head, T.StructField("pages", T.ArrayType(page))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recognition(spark: SparkSession, sf_dir: str, fields: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """recognition_json, read with a pruned schema."""
    return spark.read.schema(recognition_schema(fields, columns)).parquet(f"{sf_dir}/recognition_json.parquet")


def explode_elements(records: DataFrame, fields: list[str]) -> DataFrame:
    """One row per element that is not null: the record's columns, page_number, elem_no (from 1) and the fields.

    Null or empty pages and pages with null or no elements give no row.
    """
    head = [c for c in records.columns if c != "pages"]
    pages = records.select(*head, F.explode("pages").alias("_page")).where(F.col("_page").isNotNull())
    kept = F.filter(F.col("_page.elements"), lambda e: e.isNotNull())
    rows = pages.select(*head, F.col("_page.page_number").alias("page_number"), F.posexplode(kept).alias("_pos", "_element"))
    return rows.select(*head, "page_number", (F.col("_pos") + 1).alias("elem_no"), *[F.col(f"_element.{f}").alias(f) for f in fields])
