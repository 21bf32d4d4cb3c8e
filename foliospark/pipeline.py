"""The refinement of recognised documents as one lazily composed plan."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import code, figures, headers, headings, lines, ocr, tables


#: Steps of a run, by number.
STEPS = {1: "files", 2: "recognition", 3: "figures", 4: "raw texts", 5: "segments", 6: "page breaks", 7: "headers and footers", 8: "corrections", 9: "heading levels", 10: "list marks"}
#: Steps that are skipped if their output is there.
RESUMED = (1, 2, 3)


@dataclass(frozen=True)
class RunConfig:
    """Where a run reads and writes, from which step on, and whether it goes on where an earlier one stopped."""

    data_dir: str
    start_from: int = 1
    resume: bool = False

    @classmethod
    def resolved(cls, data_dir: str | None = None, environment: Mapping[str, str] | None = None, variable: str = "DATA_DIR", **options) -> RunConfig:
        """A folder that was given, or else the one named in the environment; neither is an error."""
        found = data_dir or (environment if environment is not None else os.environ).get(variable)
        if not found:
            raise ValueError(f"no data folder: give one or set {variable}")
        return cls(found.rstrip("/"), **options)

    def runs(self, step: int, done: bool = False) -> bool:
        """Whether a step runs. done: its output is there."""
        return step >= self.start_from and not (self.resume and done and step in RESUMED)


def pending(documents: DataFrame, outputs: DataFrame, on: str = "doc") -> DataFrame:
    """Documents that have no output yet: what a resumed run still has to do."""
    return documents.join(outputs.select(on).distinct(), on, "left_anti")


@dataclass
class RefineOptions:
    """What is refined: segments (tab, code, fig, catalogue), from which step on, and the thresholds of matching."""

    segments: tuple[str, ...] = ("tab", "catalogue")
    start_from: int = 5
    page: int | None = None
    min_similarity: float = ocr.MIN_SIMILARITY
    describe_figures: Callable[[DataFrame], DataFrame] | None = None
    max_context: int = figures.MAX_CONTEXT
    skip_labels: tuple[str, ...] = field(default=("code", "tab"))


def refine(elements: DataFrame, documents: DataFrame | None = None, accurate: DataFrame | None = None, hierarchy: DataFrame | None = None, options: RefineOptions | None = None) -> DataFrame:
    """(doc, text, original): refined Markdown.

    elements: doc, page_number, elem_no, label, text, reading_order; documents: doc, text (assembled from the elements if none
    are given); accurate: doc, page_no, line_no, line of the pages' own text, for corrections and code; hierarchy: doc, title,
    level. Steps, by number: 5 segments, 6 page breaks, 7 headers and footers, 8 corrections, 9 heading levels, 10 list marks;
    those before start_from are skipped. Steps without their input are skipped too. Nothing runs before the result is written.
    """
    opt = options or RefineOptions()
    if opt.page is not None:
        elements = elements.where(F.col("page_number") == opt.page)
    docs = documents if documents is not None else lines.assembled(elements)
    docs = docs.select("doc", "text", F.col("text").alias("original"))
    original = docs.select("doc", "original")
    text = docs.select("doc", "text")
    if opt.start_from <= 5:
        if "tab" in opt.segments:
            text = tables.tables_refined(text, elements)
        if "code" in opt.segments and accurate is not None:
            pages = accurate.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
            pieces = elements.where("label = 'code'").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.col("text").alias("code"))
            best = code.best_windows(pieces, pages)
            changes = best.select("doc", F.struct("page_no", "elem_no").alias("place"), code.format_code(F.col("code")).alias("old"), F.concat(F.lit("```\n"), "segment", F.lit("\n```")).alias("new"))
            text = code.blocks_replaced(text, changes).select("doc", "text")
        if "fig" in opt.segments and opt.describe_figures is not None:
            contexts = figures.figure_contexts(elements, opt.max_context).join(elements.select("doc", "page_number", "elem_no", "text"), ["doc", "page_number", "elem_no"])
            text = figures.described(text, contexts, opt.describe_figures)
        if "catalogue" in opt.segments:
            text = tables.catalogues_removed(text, elements)
    if opt.start_from <= 6:
        text = text.withColumn("text", lines.numbered(F.col("text")))
    pages = lines.pages_of(text, "doc", "text")
    if opt.start_from <= 7:
        pages = headers.removed(pages, headers.furniture(elements)).select("doc", "page_no", "content")
    if opt.start_from <= 8 and accurate is not None:
        best = ocr.best_lines(ocr.recognised_lines(elements, opt.skip_labels), accurate, opt.min_similarity)
        many = pages.groupBy("doc").agg(F.max("page_no").alias("_n")).where("_n > 1").select("doc")  # a document without page markers isn't corrected
        pages = ocr.corrected_pages(pages, ocr.corrections(best).join(many, "doc", "left_semi"))
    text = lines.joined_pages(pages)
    if opt.start_from <= 9 and hierarchy is not None:
        text = headings.texts_relevelled(text, hierarchy).select("doc", "text")
    text = text.withColumn("text", lines.bullets(F.col("text")))
    return text.join(original, "doc")
