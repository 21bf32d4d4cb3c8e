"""Tables of recognised pages: HTML to Markdown, and the replacement of what they were in a document."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TableReader(HTMLParser):
    """Rows of cells of the tables in an HTML text, and the text around them. Cells that span columns leave the others blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag, attributes):
        if tag == "table" and self.rows is None:
            self.rows = []
            self.parts.append(self.rows)
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []
            span = dict(attributes).get("colspan") or "1"
            self.span = min(max(int(span), 1), 100) if span.isdigit() else 1
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.end_cell()
        elif tag == "table":
            self.end_cell()
            self.rows = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.rows is None:
            self.parts.append(data)

    def end_cell(self):
        if self.cell is not None and self.rows:
            self.rows[-1] += [" ".join("".join(self.cell).split()).replace("|", "\\|")] + [""] * (self.span - 1)
        self.cell = None


def table_markdown(html: str) -> str:
    """Pipe tables for the tables of an HTML text, the first row as header; text around them stays; no markup gives the text itself."""
    reader = TableReader()
    reader.feed(html)
    reader.close()
    reader.end_cell()
    out = []
    for part in reader.parts:
        if isinstance(part, str):
            out.append(part.strip())
            continue
        rows = [r for r in part if r]
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
    return "\n\n".join(x for x in out if x)


def _convert(html: pa.Array) -> pa.Array:
    return pa.array([None if t is None else table_markdown(t) if "<" in t else t.strip() for t in html.to_pylist()], pa.string())


def html_table_to_md(html: Column) -> Column:
    """HTML tables as Markdown; null stays null."""
    return F.arrow_udf(_convert, "string")(html)


def replaced_all(text: Column, pairs: Column) -> Column:
    """Text with all occurrences of each pair's old replaced by its new, one pair after the other; empty olds do nothing."""
    return F.aggregate(pairs, text, lambda t, p: F.when(p["old"] != "", F.replace(t, p["old"], p["new"])).otherwise(t))


def tables_refined(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc, text): documents with the HTML of their table elements replaced by Markdown, everywhere it stands.

    documents: doc, text; elements: doc, page_number, elem_no, label, text.
    """
    tables = elements.where("label = 'tab' and text is not null").withColumn("new", html_table_to_md(F.col("text")))
    pairs = F.array_sort(F.collect_list(F.struct("page_number", "elem_no", F.col("text").alias("old"), "new")))
    lists = tables.groupBy("doc").agg(pairs.alias("_pairs"))
    return documents.join(lists, "doc", "left").withColumn("text", F.coalesce(replaced_all(F.col("text"), F.col("_pairs")), "text")).drop("_pairs")


def catalogues_removed(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc, text): documents without the texts of their `catalogue` elements: each is taken out wherever it stands, or else with its lines joined by spaces.

    The texts apply in page order, each to the result of the one before.
    """
    kept = elements.where("label = 'catalogue' and text <> ''")
    lists = kept.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "elem_no", "text"))), lambda e: e["text"]).alias("_gone"))
    flat = lambda g: F.replace(g, F.lit("\n"), F.lit(" "))
    folded = F.aggregate("_gone", F.col("text"), lambda t, g: F.when(t.contains(g), F.replace(t, g, F.lit(""))).otherwise(F.replace(t, flat(g), F.lit(""))))
    return documents.join(lists, "doc", "left").withColumn("text", F.coalesce(folded, "text")).drop("_gone")
