"""Refine a folder of recognised documents: python -m foliospark [DATA_DIR] OUT [options].

Reads recognition JSON, Markdown and raw texts below the data folder, and styled spans of the PDFs from a folder of their
own, and writes the refined Markdown as a table by bucket, or as files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import headings
from foliospark.pipeline import RefineOptions, RunConfig, pending, refine
from foliospark.sources import files, sinks
from foliospark.sources.tables import explode_elements


def elements_of(records: DataFrame) -> DataFrame:
    fields = ["label", "text", "reading_order", "figure_path"]
    return explode_elements(records.select("doc", "pages"), fields)


def hierarchy_of(spans: DataFrame) -> DataFrame:
    """(doc, title, level) of the headings of styled spans."""
    lines = headings.candidates(headings.span_lines(spans))
    place = Window.partitionBy("doc").orderBy("page", "block_no", "line_no")
    levelled = headings.levelled(lines.withColumn("pos", F.row_number().over(place)))
    return headings.section_levels(headings.nested(levelled.select("doc", "pos", "level", F.col("text").alias("title"))))


def accurate_of(spans: DataFrame) -> DataFrame:
    """(doc, page_no, line_no, line) of the pages' own text."""
    lines = headings.span_lines(spans)
    place = Window.partitionBy("doc", "page").orderBy("block_no", "line_no")
    return lines.select("doc", F.col("page").alias("page_no"), F.row_number().over(place).alias("line_no"), F.col("text").alias("line"))


def run(spark: SparkSession, config: RunConfig, out: str, options: RefineOptions, spans: str | None = None, as_files: bool = False) -> DataFrame:
    """Refine what is below the data folder and write it; a resumed run leaves out documents that have their output. Returns (doc, text) of what was written."""
    records = files.recognition_files(spark, config.data_dir).where("pages is not null")  # files that are no JSON have none
    if config.resume and sinks.exists(spark, out):
        records = pending(records, sinks.read_texts(spark, out))
    elements = elements_of(records)
    documents = files.markdown_files(spark, config.data_dir).select("doc", "text")
    styled = files.span_files(spark, spans) if spans else None
    docs = documents.join(records.select("doc").distinct(), "doc", "left_semi")
    refined = refine(
        elements, docs if not docs.isEmpty() else None, accurate_of(styled) if styled is not None else files.raw_text_lines(spark, config.data_dir), hierarchy_of(styled) if styled is not None else None, options).select("doc", "text")
    sinks.write_texts(refined, out, mode="append" if config.resume else "overwrite")
    written = sinks.read_texts(spark, out)
    return sinks.export_texts(written, out) if as_files else written


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    parser.add_argument("out")
    parser.add_argument("--data-dir", help="folder of the documents; else the one in DATA_DIR")
    parser.add_argument("--spans", help="folder of styled spans, as Parquet or JSON lines")
    parser.add_argument("--segments", default="tab,catalogue", help="of tab, code, fig, catalogue")
    parser.add_argument("--start-from", type=int, default=5)
    parser.add_argument("--page", type=int)
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--files", action="store_true", help="write a Markdown file for each document, too")
    given = parser.parse_args(arguments)
    config = RunConfig.resolved(given.data_dir, start_from=given.start_from, resume=given.resume)
    options = RefineOptions(segments=tuple(filter(None, map(str.strip, given.segments.split(",")))), start_from=given.start_from, page=given.page)
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    print(run(spark, config, given.out, options, given.spans, given.files).count(), "documents")


if __name__ == "__main__":
    main()
