"""Documents, pages and lines: numbering of page breaks, slices, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import bullet_line, has_bullet

#: A separator line, with the blank lines that follow it, and a page marker.
SEPARATOR = r"(?m)^---\s*$"
MARKER = r"<!-- page_break_\d+ -->"


def numbered(markdown: Column) -> Column:
    """The nth separator line becomes the nth page marker; the blank lines after it but for the last go with it."""
    parts = F.split(markdown, SEPARATOR, -1)
    marked = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("<!-- page_break_"), i.cast("string"), F.lit(" -->"), p)))
    return F.array_join(marked, "")


def pages_of(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, page_no, content): a numbered document cut at its markers; content as it stands between them. Null texts have no pages."""
    return documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, MARKER, -1)).alias("_at", "content")).select("doc", (F.col("_at") + 1).alias("page_no"), "content")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc, text): pages put together again with their markers."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "content")))
    marked = F.transform(ordered, lambda p, i: F.when(i == 0, p["content"]).otherwise(F.concat(F.lit("<!-- page_break_"), i.cast("string"), F.lit(" -->"), p["content"])))
    return pages.groupBy("doc").agg(F.array_join(marked, "").alias("text"))


def lines_of(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, line), lines ending at the line feed."""
    return documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("_at", "line")).select("doc", (F.col("_at") + 1).alias("line_no"), "line")


def joined_lines(lines: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def page_of_line(lines: DataFrame, is_break: Column) -> DataFrame:
    """Lines with page_no: one more than the breaks before the line."""
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("page_no", 1 + F.coalesce(F.sum(is_break.cast("int")).over(before), F.lit(0)))


def bullets(markdown: Column) -> Column:
    """A document with all list marks in standard form. Line by line within the row, so nothing is shuffled."""
    return F.array_join(F.transform(F.split(markdown, "\n", -1), bullet_line), "\n")


def bullet_count(markdown: Column) -> Column:
    return F.size(F.filter(F.split(markdown, "\n", -1), has_bullet))


def blank_runs_limited(lines: DataFrame, most: int = 2) -> DataFrame:
    """Lines without the blank ones beyond `most` in a row (gaps and islands)."""
    order = Window.partitionBy("doc").orderBy("line_no")
    blank = F.col("line").rlike(r"(?U)^\s*$")
    marked = lines.withColumn("_run", F.sum((~blank).cast("int")).over(order)).withColumn("_blank", blank)
    rank = F.sum(F.col("_blank").cast("int")).over(Window.partitionBy("doc", "_run").orderBy("line_no"))
    return marked.withColumn("_rank", rank).where(~F.col("_blank") | (F.col("_rank") <= most)).drop("_run", "_blank", "_rank")


def text_protocol(lines: DataFrame) -> DataFrame:
    """(doc, page_no, line_no, line) of the raw-text line protocol: `=== Page N ===` begins a page; lines before the first one are dropped, and of pages given twice the last holds."""
    order = Window.partitionBy("doc").orderBy("line_no")
    number = F.regexp_extract("line", r"^=== Page (\d+) ===", 1)
    marked = lines.withColumn("_mark", F.when(number != "", number.cast("int"))).withColumn("_part", F.count("_mark").over(order))
    marked = marked.withColumn("page_no", F.last("_mark", True).over(order)).where(F.col("page_no").isNotNull() & F.col("_mark").isNull())
    last = F.max("_part").over(Window.partitionBy("doc", "page_no"))
    return marked.withColumn("_last", last).where(F.col("_part") == F.col("_last")).select("doc", "page_no", "line_no", "line")


def protocol_text(line: Column) -> Column:
    """The text that a protocol line gives: without its `Text: ` prefix; null for structural and empty lines."""
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    structural = line.startswith("---") | line.startswith("===") | line.startswith("Type:") | line.startswith("Page Size:")
    return F.when(line.startswith("Text: "), F.regexp_replace(line, "^Text: ", "")).when(~structural & (line != ""), line)


def assembled(elements: DataFrame) -> DataFrame:
    """(doc, text): Markdown of recognised records: element texts by reading order, blank lines between, `---` between pages.

    elements: doc, page_number, elem_no, reading_order, text. A null reading order counts as 0; null texts are left out.
    """
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("reading_order", F.lit(0)).alias("o"), "elem_no", "text")))
    pages = elements.where("text is not null").groupBy("doc", "page_number").agg(F.array_join(F.transform(order, lambda e: e["text"]), "\n\n").alias("content"))
    whole = F.array_sort(F.collect_list(F.struct("page_number", "content")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(whole, lambda p: p["content"]), "\n\n---\n\n").alias("text"))
