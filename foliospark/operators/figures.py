"""Figures: the section around them, their paths and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import figure_path, suffix

#: Labels that begin a section, that end one, and that give no context.
SECTION_STARTS = ("sec", "sub_sec", "sub_sub_sec", "header", "title")
SECTION_ENDS = ("sec", "sub_sec", "sub_sub_sec")
NO_CONTEXT = ("fig", "watermark", "page_header", "page_footer")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp")
MAX_CONTEXT = 5000


def ordered_elements(elements: DataFrame) -> DataFrame:
    """Elements with place: their position on the page by reading order (null as 0), then as written, from 0."""
    order = Window.partitionBy("doc", "page_number").orderBy(F.coalesce("reading_order", F.lit(0)), "elem_no")
    return elements.withColumns({"order": F.coalesce("reading_order", F.lit(0)), "place": F.row_number().over(order) - 1})


def figure_contexts(elements: DataFrame, max_chars: int = MAX_CONTEXT) -> DataFrame:
    """(doc, page_number, elem_no, section_start, section_end, context) of each figure: the texts of its section on the page.

    The section begins at the last section label of smaller reading order, or at the page's first element, and ends before the
    first one of greater order. Texts of more than 3 characters, trimmed, are joined by blank lines and cut at max_chars.
    One sort of the page's elements serves both bounds; the page's texts are one array beside each figure.
    """
    page = Window.partitionBy("doc", "page_number")
    by_order = page.orderBy("order")
    rows = ordered_elements(elements)
    start = F.max(F.when(F.col("label").isin(*SECTION_STARTS), F.col("place"))).over(by_order.rangeBetween(Window.unboundedPreceding, -1))
    end = F.min(F.when(F.col("label").isin(*SECTION_ENDS), F.col("place"))).over(by_order.rangeBetween(1, Window.unboundedFollowing))
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    usable = ~F.coalesce(F.col("label").isin(*NO_CONTEXT), F.lit(False)) & (F.length(text) > 3)
    texts = F.array_sort(F.collect_list(F.when(usable, F.struct("place", text.alias("text")))).over(page))
    figures = rows.withColumns({"section_start": F.coalesce(start, F.lit(0)), "section_end": F.coalesce(end, F.count(F.lit(1)).over(page).cast("int")), "_texts": texts}).where("label = 'fig'")
    inside = F.filter("_texts", lambda t: (t["place"] >= F.col("section_start")) & (t["place"] < F.col("section_end")))
    context = F.array_join(F.transform(inside, lambda t: t["text"]), "\n\n")
    cut = F.when(F.length(context) > max_chars, F.concat(F.substring(context, 1, max_chars), F.lit("..."))).otherwise(context)
    return figures.select("doc", "page_number", "elem_no", "section_start", "section_end", cut.alias("context"))


def neighbours(elements: DataFrame, window: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, page_number, elem_no, context) and `keep` of each code element: texts of up to `window` elements on either side, by reading order.

    Before it paragraphs, headers, titles and lists count, after it not lists.
    """
    order = Window.partitionBy("doc", "page_number").orderBy("place")
    pick = lambda labels: F.when(F.col("label").isin(*labels), F.coalesce("text", F.lit("")))
    before = F.collect_list(pick(("para", "header", "title", "list"))).over(order.rowsBetween(-window, -1))
    after = F.collect_list(pick(("para", "header", "title"))).over(order.rowsBetween(1, window))
    return ordered_elements(elements).withColumn("context", F.array_join(F.concat(before, after), " ")).where("label = 'code'").select("doc", "page_number", "elem_no", "context", *keep)


def figure_infos(elements: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Figures with their path (own, or from the reference in the text), whether its suffix is an image's and, given a listing (doc, path), whether the file is there."""
    own = F.when(F.coalesce("figure_path", F.lit("")) != "", F.col("figure_path")).otherwise(figure_path(F.coalesce("text", F.lit(""))))
    rows = elements.where("label = 'fig'").withColumn("path", own).withColumn("is_image", suffix(F.col("path")).isin(*IMAGE_SUFFIXES))
    if files is None:
        return rows
    there = files.select("doc", "path").distinct().withColumn("image_exists", F.lit(True))
    return rows.join(there, ["doc", "path"], "left").withColumn("image_exists", F.coalesce("image_exists", F.lit(False)) & F.col("is_image"))


def described(markdown: DataFrame, figures: DataFrame, describe=None) -> DataFrame:
    """Documents with figure texts replaced by descriptions. describe: a function from a DataFrame (doc, text, context) to one with a description; none leaves all as it is.

    markdown: doc, text; figures: doc, text, context.
    """
    if describe is None:
        return markdown
    said = describe(figures).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.trim("text").alias("old"), "description"))).alias("_d"))
    folded = F.aggregate("_d", F.col("text"), lambda t, d: F.when(d["old"] != "", F.replace(t, d["old"], d["description"])).otherwise(t))
    return markdown.join(said, "doc", "left").withColumn("text", F.coalesce(folded, "text")).drop("_d")


def crop_boxes(boxes: DataFrame, padding: int = 0, most: int = 1024) -> DataFrame:
    """Geometry of image crops: boxes as whole numbers, padded and clamped to the image, empty ones null, and the size after fitting into most x most.

    boxes: x0, y0, x1, y1, width, height of the image. Pixels are cut by whatever image library is given the result.
    """
    low = lambda c: F.greatest(F.lit(0), F.col(c).cast("int") - padding)
    x0, y0 = low("x0"), low("y0")
    x1, y1 = F.least(F.col("width"), F.col("x1").cast("int") + padding), F.least(F.col("height"), F.col("y1").cast("int") + padding)
    there = (x1 > x0) & (y1 > y0)
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(x1 - x0, y1 - y0))
    fit = lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int"))
    return boxes.withColumns({"crop": F.when(there, F.array(x0, y0, x1, y1)), "out_width": F.when(there, fit(x1 - x0)), "out_height": F.when(there, fit(y1 - y0))})
