"""Headings: from styled lines of PDFs, from Markdown, and their hierarchy.

The hierarchy is never built as a tree: with levels from 1 to MAX_LEVELS, a level l is open at a heading if its last
occurrence is later than that of every smaller level, so depth, parent and path come from window functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import is_heading_text, rounded

MAX_LEVELS = 6


def span_lines(spans: DataFrame) -> DataFrame:
    """Lines of styled spans: texts trimmed and joined by a space, with the style of the first span that isn't blank.

    spans: doc, page, page_height, block_no, line_no, line_bbox, span_no, text, size, flags, font, color.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    kept = spans.withColumn("text", text).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), " ")
    style = F.min_by(F.struct("size", "flags", "font", "color"), "span_no")
    lines = kept.groupBy("doc", "page", "page_height", "block_no", "line_no").agg(joined.alias("text"), style.alias("s"), F.first("line_bbox").alias("bbox"))
    return lines.select("doc", "page", "page_height", "block_no", "line_no", "text", rounded(F.col("s.size"), 2).alias("size"), "s.flags", "s.font", "s.color", F.get("bbox", F.lit(1)).alias("y0"))


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that may be headings, with is_bold (flag 16), is_header and is_footer (upper and lower tenth of the page)."""
    kept = lines.where(is_heading_text(F.col("text")))
    return kept.withColumns({"is_bold": F.col("flags").bitwiseAND(16) != 0, "is_header": F.col("y0") < F.col("page_height") * 0.1, "is_footer": F.col("y0") > F.col("page_height") * 0.9})


def font_histogram(lines: DataFrame, examples: int = 3) -> DataFrame:
    """(doc, size, n, examples): sizes of each document with their first texts."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "text"))), 1, examples)
    return lines.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"), F.transform(first, lambda x: x["text"]).alias("examples"))


def size_threshold(lines: DataFrame) -> DataFrame:
    """(doc, threshold): the size at place floor(0.75 n) of a document's sizes in order; 10 for none."""
    counts = lines.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("doc").orderBy("size"))
    total = F.sum("n").over(Window.partitionBy("doc"))
    ranked = counts.select("doc", "size", below.alias("below"), F.least(F.floor(total * 0.75), total - 1).alias("place"))
    return ranked.where(F.col("below") > F.col("place")).groupBy("doc").agg(F.min("size").alias("threshold"))


def levelled(lines: DataFrame, min_size: float | None = None, max_levels: int = MAX_LEVELS, bold_only: bool = False, no_furniture: bool = True) -> DataFrame:
    """Candidates that are headings, with level: the rank of their style (size to one decimal, bold first) among the document's.

    lines: doc, pos, text, size, is_bold, is_header, is_footer. Kept are sizes from the threshold on, and bold ones from nine
    tenths of it; styles that occur once only count from nine tenths of the largest size on; levels beyond max_levels are dropped.
    """
    kept = lines.where("not is_header and not is_footer") if no_furniture else lines
    if min_size is None:
        kept = kept.join(size_threshold(kept), "doc")
    else:
        kept = kept.withColumn("threshold", F.lit(float(min_size)))
    size = F.col("size")
    big = (size >= F.col("threshold")) | (F.col("is_bold") & (size >= F.col("threshold") * 0.9))
    kept = kept.where(big & F.col("is_bold") if bold_only else big).withColumn("style", rounded(F.col("size"), 1))
    styles = kept.groupBy("doc", "style", "is_bold").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("top"))
    styles = styles.withColumn("top", F.max("top").over(Window.partitionBy("doc"))).where((F.col("n") >= 2) | (F.col("style") >= F.col("top") * 0.9))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("style"), F.desc("is_bold")))
    levels = styles.select("doc", "style", "is_bold", rank.alias("level")).where(F.col("level") <= max_levels)
    return kept.join(levels, ["doc", "style", "is_bold"]).withColumn("heading_no", F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).drop("threshold")


def markdown_headings(lines: DataFrame) -> DataFrame:
    """(doc, pos, level, title): heading lines of Markdown; attributes in braces at the end are cut off.

    lines: doc, line_no, line. Code fences aren't looked at, as in what this follows.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    found = r"(?U)^(#{1,6})\s+(.+?)(?:\s*\{[^}]*\})?$"
    kept = lines.withColumn("_l", line).where(F.col("_l").rlike(found))
    return kept.select("doc", F.col("line_no").alias("pos"), F.length(F.regexp_extract("_l", found, 1)).alias("level"), F.regexp_replace(F.regexp_extract("_l", found, 2), r"(?U)^\s+|\s+$", "").alias("title"))


def nested(headings: DataFrame) -> DataFrame:
    """Headings with depth (1 for the outermost), parent_pos and path (array of titles from the outermost down).

    headings: doc, pos, level (1 to MAX_LEVELS), title. The parent is the nearest one before with a smaller level.
    """
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = headings
    for k in range(1, MAX_LEVELS):
        at = F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(before)
        rows = rows.withColumn(f"_p{k}", at)
    openings = []
    for k in range(1, MAX_LEVELS):
        smaller = [F.coalesce(F.col(f"_p{j}.pos"), F.lit(-1)) for j in range(1, k)]
        later = reduce(lambda a, b: a & b, [F.col(f"_p{k}.pos") > s for s in smaller], F.col(f"_p{k}").isNotNull())
        openings.append(F.when((F.col("level") > k) & later, F.col(f"_p{k}")))
    above = F.filter(F.array(*openings), lambda x: x.isNotNull())
    return rows.withColumn("_above", above).select(
        "doc", "pos", "level", "title", (F.size("_above") + 1).cast("int").alias("depth"),
        F.try_element_at("_above", F.lit(-1))["pos"].alias("parent_pos"),
        F.concat(F.transform("_above", lambda x: x["title"]), F.array("title")).alias("path"))


def section_levels(headings: DataFrame) -> DataFrame:
    """(doc, title, level): depth of each title in the hierarchy; of a title that stands in several places the last one holds.

    headings: as nested() gives them.
    """
    return headings.groupBy("doc", "title").agg(F.max_by("depth", "pos").alias("level"))


def sections(headings: DataFrame) -> DataFrame:
    """(doc, path, level): distinct paths joined by ` > `, with their level from 0 as the number of separators in it."""
    joined = F.array_join("path", " > ")
    level = (F.length(joined) - F.length(F.replace(joined, F.lit(" > "), F.lit("")))) / 3
    return headings.select("doc", joined.alias("path"), level.cast("int").alias("level")).distinct()


def hierarchy_json(headings: DataFrame) -> DataFrame:
    """(doc, hierarchy): the nested hierarchy as JSON text, equal siblings united; levels are folded from the innermost out."""
    rows = headings.groupBy("doc", "path").agg(F.max("pos").alias("last"), F.min("pos").alias("pos")).withColumn("json", F.lit("{}"))
    for depth in range(MAX_LEVELS, 1, -1):
        key = lambda c: F.concat(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit(": "))
        deep = rows.where(F.size("path") == depth)
        entry = F.concat(key(F.element_at("path", depth)), F.col("json"))
        folded = deep.groupBy("doc", F.slice("path", 1, depth - 1).alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ", "), F.lit("}")).alias("inner"))
        shallow = rows.where(F.size("path") < depth)
        rows = shallow.join(folded, ["doc", "path"], "left").withColumn("json", F.coalesce("inner", "json")).drop("inner")
    entry = F.concat(F.to_json(F.array(F.element_at("path", 1))).substr(F.lit(2), F.length(F.to_json(F.array(F.element_at("path", 1)))) - 2), F.lit(": "), F.col("json"))
    return rows.groupBy("doc").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ", "), F.lit("}")).alias("hierarchy"))


def relevelled(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """Lines with headings found in levels rewritten to their level; others stay. Adds is_heading and is_fixed.

    lines: doc, line_no, line; levels: doc, title, level.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    found = r"(?U)^(#{1,6})\s+(.+)$"
    marked = lines.withColumn("title", F.when(line.rlike(found), F.regexp_replace(F.regexp_extract(line, found, 2), r"(?U)^\s+|\s+$", "")))
    joined = marked.join(levels.select("doc", "title", "level"), ["doc", "title"], "left")
    new = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    return joined.select("doc", "line_no", F.when(F.col("level").isNotNull(), new).otherwise(F.col("line")).alias("line"), F.col("title").isNotNull().alias("is_heading"), F.col("level").isNotNull().alias("is_fixed"))


def texts_relevelled(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, text, n_headings, n_fixed): documents with their headings rewritten as relevelled() does, without a row for each line.

    documents: doc, text; levels: doc, title (unique in its document), level. A document's titles become one map beside its text:
    the only shuffle is that of titles, and the texts' own to meet them.
    """
    known = levels.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("title", F.col("level").cast("int").alias("level")))).alias("_levels"))
    found = r"(?U)^\s*(#{1,6})\s+(.+?)\s*$"
    title = lambda x: F.when(F.regexp_replace(x, r"(?U)^\s+|\s+$", "").rlike(r"(?U)^(#{1,6})\s+(.+)$"), F.regexp_extract(x, found, 2))
    level = lambda t: F.try_element_at(F.coalesce("_levels", F.create_map().cast("map<string,int>")), F.coalesce(t, F.lit("")))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), title(x).alias("title")))
    marked = documents.join(known, "doc", "left").withColumn("_lines", lines)
    marked = marked.withColumn("_lines", F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), x["title"].alias("title"), F.when(x["title"].isNotNull(), level(x["title"])).alias("level"))))
    new = F.transform("_lines", lambda x: F.when(x["level"].isNotNull(), F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["title"])).otherwise(x["line"]))
    return marked.select("doc", F.array_join(new, "\n").alias("text"), F.size(F.filter("_lines", lambda x: x["title"].isNotNull())).alias("n_headings"), F.size(F.filter("_lines", lambda x: x["level"].isNotNull())).alias("n_fixed"))
