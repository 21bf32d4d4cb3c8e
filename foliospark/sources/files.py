"""Files as tables: PDFs, recognition JSON, hierarchies, Markdown, raw text; listing and reading are Spark's own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.text import stem
from foliospark.operators.lines import lines_of, protocol_text, text_protocol
from foliospark.sources.tables import recognition_schema

PDF_MAGIC = bytearray(b"%PDF")


def pdf_files(spark: SparkSession, folder: str, any_case: bool = True) -> DataFrame:
    """(path, rel_dir, doc, length, is_pdf, content) of the PDFs below a folder; is_pdf: the content begins like one. Content is read only if it's used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]" if any_case else "*.pdf").load(folder)
    rel = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), r"^.*?" + re.escape(folder.rstrip("/")) + r"/?", "")
    return files.select("path", rel.alias("rel_dir"), stem(F.col("path")).alias("doc"), "length", (F.substring("content", 1, 4) == F.lit(PDF_MAGIC)).alias("is_pdf"), "content")


def single_page(pages: DataFrame, page: int) -> DataFrame:
    """One page of documents, under the name `<doc>_page#N`; documents without that page give nothing."""
    if page < 1:
        raise ValueError("pages are counted from 1")
    return pages.where(F.col("page_no") == page).withColumn("doc", F.concat("doc", F.lit(f"_page#{page}")))


def lacking_page(pages: DataFrame, page: int) -> DataFrame:
    """(doc, pages) of the documents that have fewer pages than the one asked for."""
    return pages.groupBy("doc").agg(F.max("page_no").alias("pages")).where(F.col("pages") < page)


def recognition_files(spark: SparkSession, folder: str, corrections: bool = False) -> DataFrame:
    """Recognition JSON files below a folder: doc, path, source_file, pages, bad (text of files that are no JSON). Internal folders and, unless asked for, correction logs are left out."""
    schema = recognition_schema(None, ["source_file"]).add("bad", "string")
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    files = read.json(folder).withColumn("path", F.col("_metadata.file_path"))
    kept = files.where(~F.col("path").contains("/_pipeline/"))
    if not corrections:
        kept = kept.where(~F.col("path").endswith("_corrections.json"))
    return kept.select(stem(F.col("path")).alias("doc"), "path", "source_file", "pages", "bad")


def whole_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), stem(F.col("_metadata.file_path")).alias("doc"), F.col("value").alias("text"))


def markdown_files(spark: SparkSession, folder: str, backups: bool = False) -> DataFrame:
    """(path, doc, text) of Markdown files below a folder, without backups."""
    files = whole_texts(spark, folder, "*.[mM][dD]")
    return files if backups else files.where(~F.col("path").endswith("_backup.md"))


def hierarchy_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc, hierarchy variant) of hierarchy JSON files; null where a file is no JSON."""
    return whole_texts(spark, folder, "*.json").select("path", "doc", F.try_parse_json("text").alias("hierarchy"))


def raw_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, page_no, line_no, line) of raw text files in the line protocol."""
    return text_protocol(lines_of(whole_texts(spark, folder, "*.txt"), "doc", "text"))


def raw_text_lines(spark: SparkSession, folder: str) -> DataFrame | None:
    """(doc, page_no, line_no, line) of what the raw text files say, line by line; None if there are none."""
    lines = raw_text_files(spark, folder)
    said = lines.select("doc", "page_no", "line_no", protocol_text(F.col("line")).alias("line")).where("line is not null")
    return None if said.isEmpty() else said


def first_match(left: DataFrame, right: DataFrame, on: str = "doc", order: str = "path") -> DataFrame:
    """Rows of left with the first row of right that has the same name; those without one are left out (see unmatched)."""
    one = right.withColumn("_rank", F.row_number().over(Window.partitionBy(on).orderBy(order))).where("_rank = 1").drop("_rank")
    return left.join(one.withColumnRenamed(order, f"matched_{order}"), on)


def unmatched(left: DataFrame, right: DataFrame, on: str = "doc") -> DataFrame:
    return left.join(right, on, "left_anti")


SPANS = "doc string, page int, page_height double, page_width double, block_no int, line_no int, line_bbox array<double>, span_no int, text string, size double, flags int, font string, color int"


def span_files(spark: SparkSession, folder: str) -> DataFrame:
    """Styled spans that were extracted before: Parquet or JSON lines below a folder, in the columns of SPANS; what a file lacks is null."""
    read = spark.read.schema(SPANS).option("recursiveFileLookup", True)
    return read.option("pathGlobFilter", "*.parquet").parquet(folder).unionByName(read.option("pathGlobFilter", "*.json*").json(folder))


def pdf_spans(files: DataFrame, extract: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Styled text spans of PDFs. extract: gets a document's name and bytes and gives rows of SPANS, by whatever PDF library there is."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"]):
                yield pd.DataFrame(extract(doc, bytes(content)), columns=names)

    return files.select("doc", "content").mapInPandas(run, SPANS)


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc, page_no, content): plain text of each page from its spans: spans of a line side by side, lines below each other."""
    lines = spans.groupBy("doc", "page", "block_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "line_no", "line")))
    return lines.groupBy("doc", F.col("page").alias("page_no")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def page_images(pages: DataFrame, files: DataFrame, templates: list[str]) -> DataFrame:
    """Pages with the first existing image among file name templates, which may hold {doc} and {page}."""
    names = F.array(*[F.struct(F.lit(i).alias("rank"), F.replace(F.replace(F.lit(t), F.lit("{doc}"), F.col("doc")), F.lit("{page}"), F.col("page_no").cast("string")).alias("name")) for i, t in enumerate(templates)])
    listed = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    found = pages.withColumn("_n", F.explode(names)).join(listed, F.col("_n.name") == F.col("name"))
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy("doc", "page_no").orderBy("_n.rank", "path"))).where("_rank = 1").drop("_n", "_rank", "name")


def recognised(files: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Layout recognition by a model from outside: a function from PDF files to a table of recognition JSON."""
    return model(files)
