"""Running headers, footers and watermarks of recognised pages, and their removal from Markdown pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import header_form


def kind_of(label: Column) -> Column:
    """header, footer or watermark by what a label contains, in this order (so footnotes are footers); else null."""
    low = F.lower(label)
    return F.when(low.contains("header"), "header").when(low.contains("foot"), "footer").when(low.contains("watermark"), "watermark")


def furniture(elements: DataFrame) -> DataFrame:
    """(doc, page_number, kind, texts): header, footer and watermark texts of each page, in order; blank ones are dropped.

    elements: doc, page_number, elem_no, label, text.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    found = elements.withColumn("kind", kind_of(F.col("label"))).withColumn("text", text).where("kind is not null and text <> ''")
    return found.groupBy("doc", "page_number", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "text"))), lambda e: e["text"]).alias("texts"))


def applies(kind: Column, page: Column) -> Column:
    """Page 1 keeps its headers; everything else goes."""
    return (kind != "header") | (page != 1)


def lines_left(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines of pages without those equal to a header, footer or watermark of their page: a left anti join on the compared form.

    lines: doc, page_no, line_no, line; texts: doc, page_number, kind, texts. Heading lines stay.
    """
    gone = texts.where(applies(F.col("kind"), F.col("page_number"))).select("doc", F.col("page_number").alias("page_no"), F.explode("texts").alias("_text"))
    gone = gone.select("doc", "page_no", header_form(F.col("_text")).alias("_form")).distinct()
    formed = lines.withColumn("_form", F.when(~F.col("line").rlike(r"^\s*#+\s+"), header_form(F.col("line"))))
    return formed.join(gone, ["doc", "page_no", "_form"], "left_anti").drop("_form")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: Characters that headers are compared alike in, as a pattern for each.
ALIKE = {"-": "[-–—]", "'": "['‘’]", '"': '["“”]'}


def line_pattern(text: Column) -> Column:
    """A pattern for the lines that make up a text: its words in any case, over any number of lines, blank ones between them.

    A text that begins with the mark of a heading isn't found in a single line, as headings stay.
    """
    word = lambda w: reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(rf"\E{x[1]}\Q")), ALIKE.items(), F.replace(w, F.lit("\\"), F.lit("\\E\\\\\\Q")))
    words = F.transform(F.split(header_form(text), " "), lambda w: F.concat(F.lit("\\Q"), word(w), F.lit("\\E")))
    end = F.lit(r"[^\S\n]*(?:\n|\z)")
    own = F.when(F.get(words, F.lit(0)).rlike(r"^\\Q#+\\E$"), F.concat(F.lit(r"(?![^\S\n]*"), F.array_join(words, r"[^\S\n]+"), end, F.lit(")"))).otherwise("")
    return F.concat(F.lit("(?miuUd)^"), own, F.lit(r"[^\S\n]*"), F.array_join(words, r"\s+"), end)


def without(content: Column, text: Column) -> Column:
    """A page without a text: lines equal to it go, and runs of lines (blank ones between them aside) that make it up; headings that hold it stay.

    What is left is trimmed and has no more than one blank line in a row. A blank text takes nothing out.
    """
    left = F.regexp_replace(content, line_pattern(text), F.lit(""))
    closed = trimmed(F.regexp_replace(left, r"(?U)\n\s*\n\s*\n+", "\n\n"))
    return F.when((header_form(text) != "") & (content != ""), closed).otherwise(content)


def removed(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page_no, content, removals): pages with their headers, footers and watermarks taken out one after the other.

    pages: doc, page_no, content. Each text sees the result of the one before; order: headers, footers, watermarks, as
    they stand on the page. A page on which nothing applies stays as it is; otherwise it is trimmed and set between blank
    lines. One join on (doc, page); the pages of a document spread over tasks; a page's texts are folded in Catalyst.
    """
    rank = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "footer", 1).otherwise(2)
    wanted = texts.where(applies(F.col("kind"), F.col("page_number"))).groupBy("doc", F.col("page_number").alias("page_no"))
    wanted = wanted.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "texts"))), lambda x: x["texts"])).alias("_texts"))
    start = F.struct(trimmed(F.coalesce("content", F.lit(""))).alias("page"), F.lit(0).alias("n"))

    def take_out(so_far: Column, text: Column) -> Column:
        page = without(so_far["page"], text)
        return F.struct(page.alias("page"), (so_far["n"] + (page != so_far["page"]).cast("int")).alias("n"))

    joined = pages.join(wanted, ["doc", "page_no"], "left").withColumn("_r", F.aggregate(F.coalesce("_texts", F.array().cast("array<string>")), start, take_out))
    changed = F.col("_r.n") > 0
    last = F.max("page_no").over(Window.partitionBy("doc"))
    framed = F.concat(F.when(F.col("page_no") > 1, "\n\n").otherwise(""), F.col("_r.page"), F.when(F.col("page_no") < last, "\n\n").otherwise(""))
    return joined.select("doc", "page_no", F.when(changed, framed).otherwise(F.col("content")).alias("content"), F.col("_r.n").alias("removals"))
