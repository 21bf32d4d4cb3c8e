"""Correction of recognised lines by the accurate lines of the same page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.similarity import sm_ratio
from foliospark.functions.text import is_contents_entry, ratio_of_lengths, text_lines
from foliospark.runtime import spread

#: How like two lines must be, and how near in length.
MIN_SIMILARITY = 0.65
MIN_LENGTH_RATIO = 0.7


def recognised_lines(elements: DataFrame, skip: tuple[str, ...] = ("code", "tab")) -> DataFrame:
    """(doc, page_no, elem_no, part, text): lines of elements to be corrected: not of the skipped labels, no entries of contents, not blank.

    elements: doc, page_number, elem_no, label, text.
    """
    text = F.col("text")
    kept = elements.where(~F.coalesce(F.col("label").isin(*skip), F.lit(False)) & text.isNotNull() & ~is_contents_entry(text) & text.rlike(r"(?U)\S"))
    return kept.select("doc", F.col("page_number").alias("page_no"), "elem_no", F.posexplode(text_lines(text)).alias("part", "text"))


def best_lines(recognised: DataFrame, accurate: DataFrame, min_similarity: float = MIN_SIMILARITY, min_ratio: float = MIN_LENGTH_RATIO) -> DataFrame:
    """Each recognised line with the most similar accurate line of its page; the first of equals; none below the threshold.

    recognised: doc, page_no, elem_no, part, text; accurate: doc, page_no, line_no, line. The join is on the page, and
    only pairs of like length are compared, and none for lines that have an equal: those don't reach Python.
    """
    a, b = F.lower("text"), F.lower("line")
    pairs = spread(recognised.join(accurate.where(F.length("line") >= 3), ["doc", "page_no"]).where(ratio_of_lengths(F.col("text"), F.col("line")) >= min_ratio), "doc", "page_no", "elem_no", "part")
    line = Window.partitionBy("doc", "page_no", "elem_no", "part")
    marked = pairs.withColumn("_same", a == b).withColumn("_any", F.max("_same").over(line)).where(F.col("_same") | ~F.col("_any"))
    scored = marked.withColumn("similarity", F.coalesce(sm_ratio(F.when(~F.col("_same"), a), b), F.lit(1.0))).drop("_same", "_any")
    order = line.orderBy(F.desc("similarity"), "line_no")
    return scored.withColumn("_rank", F.row_number().over(order)).where((F.col("_rank") == 1) & (F.col("similarity") >= min_similarity)).drop("_rank")


def corrections(best: DataFrame) -> DataFrame:
    """Matches that correct something: the accurate line differs and isn't shorter."""
    line = F.trim("line")
    return best.where((F.trim("text") != line) & (F.length(line) >= F.length(F.trim("text"))))


def replaced_first(text: Column, old: Column, new: Column) -> Column:
    """Text with the first occurrence of old replaced; as it is if there is none."""
    place = F.call_function("locate", old, text)
    return F.when((place > 0) & (F.length(old) > 0), F.concat(text.substr(F.lit(1), place - 1), new, text.substr(place + F.length(old), F.length(text)))).otherwise(text)


def corrected_pages(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pages with the corrections applied in order, each to the result of the one before and at its first occurrence.

    pages: doc, page_no, content; fixes: doc, page_no, elem_no, part, text, line.
    """
    ordered = F.array_sort(F.collect_list(F.struct("elem_no", "part", F.trim("text").alias("old"), F.col("line").alias("new"))))
    lists = fixes.groupBy("doc", "page_no").agg(ordered.alias("_fixes"))
    folded = F.aggregate("_fixes", F.col("content"), lambda text, fix: replaced_first(text, fix["old"], fix["new"]))
    return pages.join(lists, ["doc", "page_no"], "left").withColumn("content", F.coalesce(folded, "content")).drop("_fixes")
