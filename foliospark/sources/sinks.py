"""Writers. Each writes a finished table once; nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.text import suffix

#: Suffixes of images.
FIGURE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")


#: Tables of documents are written in so many folders, by a hash of the document's name.
BUCKETS = 64


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the bucket of their document: the number of folders doesn't grow with that of documents."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int"))


def write_texts(texts: DataFrame, folder: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Texts (doc, text) as Parquet below folder/bucket=<k>/: Markdown, hierarchies, reports. mode `ignore` keeps what is there."""
    bucketed(texts.select("doc", "text"), buckets).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, on whatever storage its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(place)


def read_texts(spark: SparkSession, folder: str, docs: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc, text) as write_texts wrote them; of the named documents only their buckets are read."""
    rows = spark.read.parquet(folder)
    if docs is not None:
        names = spark.createDataFrame([(d,) for d in docs], "doc string")
        wanted = [r.bucket for r in bucketed(names, buckets).select("bucket").distinct().collect()]
        rows = rows.where(F.col("bucket").isin(wanted) & F.col("doc").isin(docs))
    return rows.select("doc", "text")


def export_texts(texts: DataFrame, folder: str, suffix: str = ".md") -> DataFrame:
    """Each text as a file of its own, folder/<doc><suffix>, where files are what is wanted; a file is written by the task that holds it. (doc, path) of the files.

    For folders that all executors share. doc must be a plain file name.
    """

    def run(batches):
        import os

        import pandas as pd

        for batch in batches:
            paths = []
            for doc, text in zip(batch["doc"], batch["text"]):
                if os.path.basename(str(doc)) != str(doc):
                    raise ValueError(f"not a file name: {doc}")
                path = os.path.join(folder, f"{doc}{suffix}")
                with open(path + ".part", "w", encoding="utf-8", newline="") as out:
                    out.write(text or "")
                os.replace(path + ".part", path)
                paths.append(path)
            yield pd.DataFrame({"doc": batch["doc"].astype(str), "path": paths})

    return texts.select("doc", "text").mapInPandas(run, "doc string, path string")


def with_backup(documents: DataFrame, column: str = "text") -> DataFrame:
    """Documents that keep their text of now as `original` beside later changes."""
    return documents.withColumn("original", F.col(column))


def write_raw_texts(spans: DataFrame, folder: str, force: bool = False, buckets: int = BUCKETS) -> None:
    """Raw page texts as a table by bucket of documents; what is there stays unless it is forced."""
    bucketed(spans, buckets).repartition("bucket").write.mode("overwrite" if force else "ignore").partitionBy("bucket").parquet(folder)


def raw_protocol(spans: DataFrame) -> DataFrame:
    """(doc, text): spans in the line protocol of raw texts: pages, their size, blocks and their texts.

    spans: doc, page, page_width, page_height, block_no, line_no, span_no, text. Blank spans are left out.
    """
    kept = spans.where(F.col("text").rlike(r"(?U)\S"))
    rule = F.lit("-" * 50)
    joined = lambda c: F.transform(F.array_sort(c), lambda x: x["text"])
    blocks = kept.groupBy("doc", "page", "page_width", "page_height", "block_no").agg(joined(F.collect_list(F.struct("line_no", "span_no", F.concat(F.lit("    Text: "), F.col("text")).alias("text")))).alias("_lines"))
    shown = F.concat_ws("\n", F.concat(F.lit("--- Block #"), F.col("block_no"), F.lit(" ---")), F.lit("Type: Text"), F.array_join("_lines", "\n"), rule)
    pages = blocks.groupBy("doc", "page", "page_width", "page_height").agg(joined(F.collect_list(F.struct("block_no", shown.alias("text")))).alias("_blocks"))
    page = F.concat_ws("\n", F.concat(F.lit("=== Page "), F.col("page"), F.lit(" ===")), F.concat(F.lit("Page Size: "), F.col("page_width"), F.lit(" x "), F.col("page_height")), F.array_join("_blocks", "\n"))
    return pages.groupBy("doc").agg(F.array_join(joined(F.collect_list(F.struct("page", page.alias("text")))), "\n").alias("text"))


def corrections_log(corrections: DataFrame) -> DataFrame:
    """(page, ocr_text, corrected_text, similarity) with doc, in order, as a log of corrections."""
    return corrections.select("doc", F.col("page_no").alias("page"), F.col("text").alias("ocr_text"), F.col("line").alias("corrected_text"), "similarity")


#: Names of a difference in a report.
DIFFERENCE_NAMES = {
    "difference_number": "difference_number", "kind": "difference_type", "position_a": "position_file1", "position_b": "position_file2", "text_a": "file1_text", "text_b": "file2_text",
    "before_a": "context_before_file1", "after_a": "context_after_file1", "before_b": "context_before_file2", "after_b": "context_after_file2", "words_a": "file1_words_affected", "words_b": "file2_words_affected",
}


def difference_report(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Word differences under the report's names."""
    return diff.select(*keys, *[F.col(a).alias(b) for a, b in DIFFERENCE_NAMES.items()])


def report_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): each row as a JSON report."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("text"))


def chosen_output(wanted: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """(doc, path): the output file of each document: the one of its own name, or else the first by path that is neither backup nor internal.

    files: doc (the run's document), path. kind: file suffix such as `.md`.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    exact = (name == F.concat("doc", F.lit(kind))).cast("int")
    usable = (suffix(F.col("path")) == kind) & ~F.col("path").contains("/_pipeline/") & ~name.contains("_backup")
    ranked = files.where(usable).withColumn("_rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(exact), "path")))
    return wanted.select("doc").join(ranked.where("_rank = 1").select("doc", "path"), "doc", "left")


def figure_files(files: DataFrame) -> DataFrame:
    """Files of a figures folder with an image's suffix."""
    return files.where(F.col("path").contains("/figures/") & suffix(F.col("path")).isin(*FIGURE_SUFFIXES))
