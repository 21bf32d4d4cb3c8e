"""Queries of the document operators over the given tables, each beside the SQL that must give the same rows.

Inputs derived for a query (styled lines, a second hierarchy, accurate lines) are made by the same plain expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import similarity, text
from foliospark.operators import code, evaluate, figures, headers, headings, lines, ocr, tables
from foliospark.pipeline import RefineOptions, refine
from foliospark.sources.tables import explode_elements, recognition, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: White space as Unicode has it, for SQL patterns.
WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


EL = """r as (select rec_id, any_value(source_file) as source_file, any_value(pages) as pages from recognition_json group by rec_id),
pg as (select rec_id, source_file, unnest(pages) as p from r),
pe as (select rec_id, source_file, p.page_number as page_number, list_filter(p.elements, lambda e: e is not null) as es from pg),
el as (select rec_id as doc, source_file, page_number, i as elem_no, es[i].label as label, es[i].text as text, es[i].reading_order as reading_order, es[i].figure_path as figure_path
  from pe, unnest(range(1, len(es) + 1)) as t(i))"""
JL = """jl as (select job_id as doc, i as line_no, s[i] as line from (select job_id, string_split(markdown, chr(10)) as s from job_result where markdown is not null), unnest(range(1, len(s) + 1)) as t(i))"""
DL = """dl as (select doc_id as doc, i as line_no, s[i] as line from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null), unnest(range(1, len(s) + 1)) as t(i))"""
NUMBERED = """array_to_string(list_transform(string_split_regex(markdown, '(?m)^---\\s*$'), lambda p, i: case when i = 1 then p else '<!-- page_break_' || (i - 1) || ' -->' || p end), '')"""


def elements(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("label", "text", "reading_order")) -> DataFrame:
    """doc, page_number, elem_no and fields; records delivered twice count once."""
    records = recognition(spark, sf_dir, list(fields), ["rec_id", "source_file"]).dropDuplicates(["rec_id"])
    return explode_elements(records.withColumnRenamed("rec_id", "doc"), list(fields))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_result").where("markdown is not null").select(F.col("job_id").alias("doc"), F.col("markdown").alias("text"))


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# pages and lines


@query(f"select job_id as doc, md5({NUMBERED}) as text_md5, len(string_split_regex(markdown, '(?m)^---\\s*$')) - 1 as n_breaks from job_result where markdown is not null")
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = lines.numbered(F.col("text"))
    return markdown(spark, sf_dir).select("doc", F.md5(new).alias("text_md5"), (F.size(F.split("text", lines.SEPARATOR, -1)) - 1).cast("bigint").alias("n_breaks"))


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.pages_of(markdown(spark, sf_dir).withColumn("text", lines.numbered(F.col("text"))), "doc", "text")


@query(f"""with n as (select job_id as doc, string_split_regex({NUMBERED}, '<!-- page_break_\\d+ -->') as s from job_result where markdown is not null)
select doc, i as page_no, length({stripped('s[i]')}) as n_chars, md5({stripped('s[i]')}) as content_md5 from n, unnest(range(1, len(s) + 1)) as t(i)""")
def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    return numbered_pages(spark, sf_dir).select("doc", *big("page_no"), F.length(content).cast("bigint").alias("n_chars"), F.md5(content).alias("content_md5"))


@query(f"select job_id as doc, md5({NUMBERED}) as text_md5 from job_result where markdown is not null")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.joined_pages(numbered_pages(spark, sf_dir)).select("doc", F.md5("text").alias("text_md5"))


BULLET_SQL = """case when regexp_matches(x, '^(\\s*)-\\s*[•◦]') then regexp_replace(x, '^(\\s*)-\\s*[•◦]\\s*', '\\1- ')
 when regexp_matches(x, '^\\s*-\\s*\\d+\\.') then regexp_replace(x, '^(\\s*)-\\s*(\\d+\\.)\\s*', '\\1\\2 ')
 when regexp_matches(x, '^\\s*[•◦]') then regexp_replace(x, '^(\\s*)[•◦]\\s*', '\\1- ')
 when regexp_matches(x, '^\\s*-\\s*\\d+\\s') then regexp_replace(x, '^(\\s*)-\\s*(\\d+)\\s+', '\\1\\2. ')
 when regexp_matches(x, '^\\s*\\d+\\s') then regexp_replace(x, '^(\\s*)(\\d+)\\s+', '\\1\\2. ') else x end"""
HAS_BULLET = "regexp_matches(x, '^\\s*-\\s*[•◦]|^\\s*-\\s*\\d+\\.|^\\s*[•◦]|^\\s*-\\s*\\d+\\s|^\\s*\\d+\\s')"


@query(f"""with {EL} select doc, page_number::bigint as page_number, elem_no, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {BULLET_SQL}), chr(10))) as text_md5,
len(list_filter(string_split(text, chr(10)), lambda x: {HAS_BULLET})) as n_fixed from el where label = 'list' and text is not null""")
def bullets_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = elements(spark, sf_dir, ("label", "text")).where("label = 'list' and text is not null")
    return lists.select("doc", *big("page_number", "elem_no"), F.md5(lines.bullets(F.col("text"))).alias("text_md5"), lines.bullet_count(F.col("text")).cast("bigint").alias("n_fixed"))


@query(f"""with {JL}, b as (select *, regexp_matches(line, '^{WS}*$') as blank, lag(line) over (partition by doc order by line_no) as last from jl)
select doc, count(*) as n_lines, sum(line_no)::bigint as line_sum from b where not blank or last is null or not regexp_matches(last, '^{WS}*$') group by doc""")
def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.blank_runs_limited(lines.lines_of(markdown(spark, sf_dir), "doc", "text"), 1)
    return kept.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_no").cast("bigint").alias("line_sum"))


@query(f"""with {EL}, pc as (select doc, page_number, string_agg(text, chr(10) || chr(10) order by coalesce(reading_order, 0), elem_no) as content from el where text is not null group by doc, page_number)
select doc, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_number)) as text_md5 from pc group by doc""")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.assembled(elements(spark, sf_dir)).select("doc", F.md5("text").alias("text_md5"))


# headers and footers

def form_of(c: str) -> str:
    return f"lower(trim(regexp_replace(translate({c}, '–—‘’“”', '--''''\"\"'), '{WS}+', ' ', 'g')))"


KIND = "case when contains(lower(label), 'header') then 'header' when contains(lower(label), 'foot') then 'footer' when contains(lower(label), 'watermark') then 'watermark' end"
FURNITURE = f"fu as (select doc, page_number, elem_no, {KIND} as kind, {stripped('text')} as text from el where {KIND} is not null and {stripped('text')} <> '')"


@query(f"with {EL} select doc, page_number::bigint as page_number, elem_no, md5({form_of('text')}) as form_md5 from el where text is not null")
def header_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir, ("text",)).where("text is not null").select("doc", *big("page_number", "elem_no"), F.md5(text.header_form(F.col("text"))).alias("form_md5"))


@query(f"with {EL}, {FURNITURE} select doc, page_number::bigint as page_number, kind, count(*) as n, string_agg(text, '|' order by elem_no) as texts from fu group by doc, page_number, kind")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.furniture(elements(spark, sf_dir, ("label", "text"))).select("doc", *big("page_number"), "kind", F.size("texts").cast("bigint").alias("n"), F.array_join("texts", "|").alias("texts"))


@query(f"""with {EL}, {FURNITURE}, gone as (select distinct doc, page_number, {form_of('text')} as form from fu where kind <> 'header' or page_number <> 1),
ln as (select doc, page_number, line from (select doc, page_number, string_split(text, chr(10)) as s from el where text is not null), unnest(s) as t(line))
select doc, page_number::bigint as page_number, count(*) as n_lines, sum(length(line))::bigint as n_chars from ln
where regexp_matches(line, '^\\s*#+\\s+') or not exists (select 1 from gone where gone.doc = ln.doc and gone.page_number = ln.page_number and gone.form = {form_of('line')}) group by doc, page_number""")
def header_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir, ("label", "text"))
    split = rows.where("text is not null").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    left = headers.lines_left(split, headers.furniture(rows))
    return left.groupBy("doc", F.col("page_no").cast("bigint").alias("page_number")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"))


# correction of recognised lines

CONTENTS = f"""(regexp_matches({stripped('text')}, '\\d+\\s*$') or regexp_matches(text, '(?i)^Table of Contents|\\.{{3,}}|on page \\d+|see page \\d+'))"""


@query(f"with {EL} select coalesce(label, '') as label, count(*) as n, count(*) filter (where {CONTENTS}) as n_contents from el where text is not null group by 1")
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir, ("label", "text")).where("text is not null")
    return rows.groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_contents_entry(F.col("text"))).alias("n_contents"))


@query(f"""with {EL}, k as (select doc, page_number, elem_no, list_filter(list_transform(string_split_regex(regexp_replace(text, '-{WS}*\\n{WS}*', '', 'g'), '\\r\\n|\\n|\\r'), lambda x: {stripped('x')}), lambda x: length(x) > 1) as s
 from el where coalesce(label not in ('code', 'tab'), true) and text is not null and not {CONTENTS} and regexp_matches(text, '[^\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))
select doc, page_number::bigint as page_no, elem_no, i - 1 as part, s[i] as text from k, unnest(range(1, len(s) + 1)) as t(i)""")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.recognised_lines(elements(spark, sf_dir, ("label", "text"))).select("doc", *big("page_no", "elem_no", "part"), "text")


def accurate_lines(rows: DataFrame) -> DataFrame:
    """Stand-in for the pages' own text: the page's lines with misread digits and signs put right."""
    split = rows.where("text is not null and label <> 'tab'").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.select("doc", "page_no", (F.col("elem_no") * 1000 + F.col("at")).alias("line_no"), F.translate("line", "@!", "ai").alias("line"))


@query()
def ocr_best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir, ("label", "text"))
    seen = ocr.recognised_lines(rows)
    misread = F.when(F.crc32("text") % 3 == 0, F.translate("text", "eol", "c01")).otherwise(F.col("text"))  # a third of the lines
    best = ocr.best_lines(seen.withColumn("text", misread), accurate_lines(rows))
    return best.select("doc", "page_no", "elem_no", "part", "text", "line", F.round("similarity", 4).alias("similarity"))


@query()
def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    found = headings.nested(headings.markdown_headings(lines.lines_of(lines.assembled(rows), "doc", "text")))
    out = refine(rows, accurate=accurate_lines(rows), hierarchy=headings.section_levels(found), options=RefineOptions(segments=("tab", "catalogue")))
    return out.select("doc", F.length("original").alias("n_chars_before"), F.length("text").alias("n_chars_after"), F.md5("text").alias("text_md5"))


# headings

HEADING = f"""(not regexp_matches(line, '(?i)^(?:\\d{{4}}-\\d{{2}}-\\d{{2}}|Page\\s+\\d+|Copyright\\s*©|\\d+\\s*$|[A-Z]{{2,}}\\s*\\d{{4}}|[\\p{{L}}\\p{{N}}_]+@[\\p{{L}}\\p{{N}}_]+\\.[\\p{{L}}\\p{{N}}_]+|https?://|\\.\\.\\.|[\\d\\.\\s]+$)')
 and length(line) between 3 and 150 and length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 2 >= length(line))"""
STYLED = f"""st as (select doc, line_no as pos, line as text, 8.0 + length(line) % 9 as size, doc % 2 = 0 as is_bold, (line_no * 37) % 792 < 79.2 as is_header, (line_no * 37) % 792 > 712.8 as is_footer from dl where {HEADING})"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a style and place derived from their length and number."""
    rows = lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    y0 = (F.col("line_no") * 37) % 792
    made = rows.select("doc", F.col("line_no").alias("pos"), F.col("line").alias("text"), (8.0 + F.length("line") % 9).cast("double").alias("size"), F.when(F.col("doc") % 2 == 0, 16).otherwise(0).alias("flags"), y0.cast("double").alias("y0"), F.lit(792.0).alias("page_height"))
    return headings.candidates(made)


@query(f"with {DL} select doc, count(*) as n, sum(line_no)::bigint as line_sum from dl where {HEADING} group by doc")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").where(text.is_heading_text(F.col("line")))
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").cast("bigint").alias("line_sum"))


@query(f"with {DL}, {STYLED}, c as (select doc, size, text, row_number() over (partition by doc, size order by pos) as k from st) select doc, size::double as size, count(*) as n, string_agg(text, '|' order by k) filter (where k <= 3) as examples from c group by doc, size")
def font_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.font_histogram(styled(spark, sf_dir)).select("doc", "size", "n", F.array_join("examples", "|").alias("examples"))


@query(f"with {DL}, {STYLED}, l as (select doc, list_sort(list(size)) as s from st group by doc) select doc, s[floor(len(s) * 0.75)::int + 1]::double as threshold from l")
def size_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.size_threshold(styled(spark, sf_dir))


@query(f"""with {DL}, {STYLED}, f as (select * from st where not is_header and not is_footer and (size >= 12 or (is_bold and size >= 12 * 0.9))),
 g as (select doc, size, is_bold, count(*) as n, max(max(size)) over (partition by doc) as top from f group by doc, size, is_bold),
 lv as (select doc, size, is_bold, row_number() over (partition by doc order by size desc, is_bold desc) as level from g where n >= 2 or size >= top * 0.9)
select f.doc, f.pos, f.text, lv.level, row_number() over (partition by f.doc order by f.pos) - 1 as heading_no from f join lv on lv.doc = f.doc and lv.size = f.size and lv.is_bold = f.is_bold where lv.level <= 6""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.levelled(styled(spark, sf_dir), min_size=12).select("doc", *big("pos"), "text", *big("level", "heading_no"))


HD = f"""{JL}, hd as (select doc, line_no as pos, length(regexp_extract(x, '^(#{{1,6}})\\s', 1)) as level, {stripped("regexp_extract(x, '^#{1,6}\\s+(.+?)(?:\\s*\\{[^}]*\\})?$', 1)")} as title
 from (select doc, line_no, {stripped('line')} as x from jl) where regexp_matches(x, '^#{{1,6}}\\s+.+$'))"""


def tree_sql(source: str, name: str) -> str:
    """CTEs: parent of each heading, then depth and path from the outermost down."""
    return f"""{name}p as (select h.*, (select max(a.pos) from {source} a where a.doc = h.doc and a.pos < h.pos and a.level < h.level) as parent_pos from {source} h),
{name} as (select doc, pos, level, title, parent_pos, 1 as depth, title as path from {name}p where parent_pos is null
 union all select c.doc, c.pos, c.level, c.title, c.parent_pos, p.depth + 1, p.path || ' > ' || c.title from {name}p c join {name} p on p.doc = c.doc and p.pos = c.parent_pos)"""


def found_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.markdown_headings(lines.lines_of(markdown(spark, sf_dir), "doc", "text"))


@query(f"with recursive {HD}, {tree_sql('hd', 't')} select doc, pos, level::bigint as level, title, depth::bigint as depth, parent_pos, path from t")
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headings.nested(found_headings(spark, sf_dir))
    return rows.select("doc", *big("pos", "level"), "title", *big("depth", "parent_pos"), F.array_join("path", " > ").alias("path"))


@query(f"with recursive {HD}, {tree_sql('hd', 't')} select doc, title, arg_max(depth, pos)::bigint as level from t group by doc, title")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.section_levels(headings.nested(found_headings(spark, sf_dir))).select("doc", "title", *big("level"))


def nested_json_sql(deepest: int = 6) -> str:
    """CTEs from t (doc, pos, path as list) to each document's nested JSON, level by level from the innermost out."""
    listed = tree_sql("hd", "t").replace("title as path", "[title] as path").replace("p.path || ' > ' || c.title", "list_append(p.path, c.title)")
    steps = [listed, f"r{deepest} as (select doc, path, min(pos) as pos, '{{}}' as json from t group by doc, path)"]
    entry = "to_json(path[-1])::varchar || ': ' || json"
    for k in range(deepest, 1, -1):
        steps.append(f"i{k} as (select doc, path[:{k - 1}] as path, '{{' || string_agg({entry}, ', ' order by pos) || '}}' as inside from r{k} where len(path) = {k} group by 1, 2)")
        steps.append(f"r{k - 1} as (select r.doc, r.path, r.pos, coalesce(inside, json) as json from r{k} r left join i{k} i on i.doc = r.doc and i.path = r.path where len(r.path) < {k})")
    return ",\n".join(steps) + f"\nselect doc, '{{' || string_agg({entry}, ', ' order by pos) || '}}' as hierarchy from r1 group by doc"


@query(f"with recursive {HD}, {nested_json_sql()}")
def hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.hierarchy_json(headings.nested(found_headings(spark, sf_dir)))


@query(f"""with recursive {HD}, {tree_sql('hd', 't')}, lv as (select doc, title, arg_max(depth, pos) as level from t group by doc, title),
 w as (select jl.doc, jl.line_no, case when lv.level is null then jl.line else repeat('#', lv.level::int) || ' ' || lv.title end as line, lv.level from jl
  left join lv on lv.doc = jl.doc and regexp_matches({stripped('jl.line')}, '^#{{1,6}}\\s+.+$') and lv.title = {stripped(f"regexp_extract({stripped('jl.line')}, '^#{{1,6}}\\s+(.+)$', 1)")})
select doc, md5(string_agg(line, chr(10) order by line_no)) as text_md5, count(level) as n_fixed from w group by doc""")
def headings_relevelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(markdown(spark, sf_dir), "doc", "text")
    new = headings.relevelled(rows, headings.section_levels(headings.nested(headings.markdown_headings(rows))))
    fixed = new.groupBy("doc").agg(F.count_if("is_fixed").alias("n_fixed"))
    return lines.joined_lines(new).join(fixed, "doc").select("doc", F.md5("text").alias("text_md5"), "n_fixed")


@query(f"""with recursive {HD}, {tree_sql('hd', 't')}, lv as (select doc, title, arg_max(depth, pos) as level from t group by doc, title),
 w as (select jl.doc, jl.line_no, case when lv.level is null then jl.line else repeat('#', lv.level::int) || ' ' || lv.title end as line, lv.level, regexp_matches({stripped('jl.line')}, '^#{{1,6}}\\s+.+$') as is_heading from jl
  left join lv on lv.doc = jl.doc and regexp_matches({stripped('jl.line')}, '^#{{1,6}}\\s+.+$') and lv.title = {stripped(f"regexp_extract({stripped('jl.line')}, '^#{{1,6}}\\s+(.+)$', 1)")})
select doc, md5(string_agg(line, chr(10) order by line_no)) as text_md5, count(*) filter (where is_heading) as n_headings, count(level) as n_fixed, round(100.0 * count(level) / greatest(count(*) filter (where is_heading), 1), 4)::double as rate from w group by doc""")
def texts_relevelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    levels = headings.section_levels(headings.nested(headings.markdown_headings(lines.lines_of(docs, "doc", "text"))))
    out = headings.texts_relevelled(docs, levels)
    rate = F.round(F.lit(100.0) * F.col("n_fixed") / F.greatest("n_headings", F.lit(1)), 4)
    return out.select("doc", F.md5("text").alias("text_md5"), *big("n_headings", "n_fixed"), rate.alias("rate"))


# accuracy of sections

TWO = f"""{HD}, he as (select doc, pos, case when length(title) % 3 = 0 and level < 6 then level + 1 else level end as level, title from hd where length(title) % 5 <> 0),
{tree_sql('hd', 't')}, {tree_sql('he', 'e')}, gt as (select distinct doc, path, ((length(path) - length(replace(path, ' > ', ''))) / 3)::bigint as level from t),
ex as (select distinct doc, path, ((length(path) - length(replace(path, ' > ', ''))) / 3)::bigint as level from e)"""


def rates_sql(by: str) -> str:
    return f"""select {by}, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall,
 round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) as f1_score"""


def counts_sql(a: str, b: str, by: list[str], item: str) -> str:
    keys = [*by, item]
    using = ", ".join(keys)
    return f"""c as (select {', '.join(by)}, count(*) filter (where x and y) as tp, count(*) filter (where x is null) as fp, count(*) filter (where y is null) as fn
 from (select distinct {using}, true as x from {a}) full join (select distinct {using}, true as y from {b}) using ({using}) group by {', '.join(by)})"""


def two_hierarchies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The headings as they stand, and a version that lacks some and has others deeper."""
    truth = found_headings(spark, sf_dir)
    deeper = F.when((F.length("title") % 3 == 0) & (F.col("level") < 6), F.col("level") + 1).otherwise(F.col("level"))
    other = truth.where(F.length("title") % 5 != 0).withColumn("level", deeper)
    return headings.nested(truth), headings.nested(other)


@query(f"with recursive {TWO}, {counts_sql('t', 'e', ['doc'], 'title')} {rates_sql('doc')}, tp as true_positives, fp as false_positives, fn as false_negatives from c")
def section_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.set_accuracy(*two_hierarchies(spark, sf_dir), ["doc"], "title")


@query(f"with recursive {TWO}, {counts_sql('gt', 'ex', ['doc'], 'path')} {rates_sql('doc')}, tp as true_positives, fp as false_positives, fn as false_negatives from c")
def path_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_hierarchies(spark, sf_dir)
    return evaluate.set_accuracy(headings.sections(a), headings.sections(b), ["doc"], "path")


@query(f"with recursive {TWO}, {counts_sql('gt', 'ex', ['doc', 'level'], 'path')} {rates_sql('doc, level')}, tp + fn as count_gt, tp + fp as count_extracted from c")
def level_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_hierarchies(spark, sf_dir)
    return evaluate.level_accuracy(headings.sections(a), headings.sections(b)).withColumn("level", F.col("level").cast("bigint"))


@query(f"with recursive {TWO} select doc, path from gt except select doc, path from ex")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_hierarchies(spark, sf_dir)
    return evaluate.missing(headings.sections(a), headings.sections(b))


@query(f"with recursive {TWO} select doc, path from ex except select doc, path from gt")
def extra_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_hierarchies(spark, sf_dir)
    return evaluate.missing(headings.sections(b), headings.sections(a))


@query(f"with recursive {TWO} select doc, count(distinct title) as n_titles, count(distinct path) as n_paths from t group by doc")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = two_hierarchies(spark, sf_dir)
    return a.groupBy("doc").agg(F.count_distinct("title").alias("n_titles"), F.count_distinct("path").alias("n_paths"))


# accuracy of texts

WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"


@query(f"select doc_id, len({WORDS.format('text')}) as n_words from documents where text is not null")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.words(F.col("text"))).cast("bigint").alias("n_words"))


@query(f"""with w as (select doc_id, list_distinct({WORDS.format('lower(text)')}) as s from documents where text is not null)
select a.doc_id, round(case when len(a.s) + len(b.s) > 0 then len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) else 0 end, 4) as overlap from w a join w b on b.doc_id = a.doc_id + 1""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.words(F.lower("text")).alias("w"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return pairs.select("doc_id", F.round(similarity.jaccard(F.col("w"), F.col("v")), 4).alias("overlap"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code as it was found beside the same code with its signs put right."""
    found = table(spark, sf_dir, "code_match").where("pdf_text is not null")
    return found.select("match_id", F.translate("pdf_text", "01;.", "ol_ ").alias("truth"), F.col("pdf_text").alias("found"))


@query()
def text_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.text_accuracy(text_pairs(spark, sf_dir))
    return out.withColumns({"chars": F.round("chars", 4), "words": F.round("words", 4), "band": text.similarity_band(F.col("words"))})


@query()
def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.word_diff(text_pairs(spark, sf_dir), ["match_id"])


@query()
def difference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.difference_histogram(evaluate.word_diff(text_pairs(spark, sf_dir), ["match_id"]), ["match_id"])


# code


def marks_sql(marks: list[str]) -> str:
    return " + ".join("regexp_matches(x, '" + m.replace("'", "''") + "')::int" for m in marks)


CODE_EL = f"{EL}, ce as (select doc, page_number::bigint as page_number, elem_no, text, {stripped('text')} as s from el where label = 'code' and text is not null)"


@query(f"""with {CODE_EL}, k as (select *, {marks_sql(text.CODE_MARKS)} as a, {marks_sql(text.COMMAND_MARKS)} as b, {marks_sql(text.CONFIG_MARKS)} as c from (select *, lower(text[1:500]) as x from ce))
select doc, page_number, elem_no, case when length(trim(text)) < 3 then 'mixed' when greatest(a, b, c) >= 2 then case when a = greatest(a, b, c) then 'code' when b = greatest(a, b, c) then 'command' else 'config' end
 when greatest(a, b, c) > 0 then 'mixed' else 'natural_language' end as kind from k""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_elements(spark, sf_dir).select("doc", *big("page_number", "elem_no"), text.content_type(F.col("text")).alias("kind"))


def code_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir, ("label", "text")).where("label = 'code' and text is not null")


def form_sql(c: str) -> str:
    out = f"translate(lower({c}), '{text.CODE_SIGNS[0]}', '{text.CODE_SIGNS[1]}')"
    for a, b in text.CODE_FORMS:
        out = f"replace({out}, '{a}', '{b}')"
    kept = """[^\\p{L}\\p{N}\\s\\-_.,;:()\\[\\]{}="''<>/\\\\@#$%&*+|~`^?!]"""
    return f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '{WS}+', ' ', 'g'), '{kept}', ' ', 'g'), '{WS}+', ' ', 'g'))"


@query(f"with {CODE_EL} select doc, page_number, elem_no, md5({form_sql('s')}) as form_md5 from ce")
def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_elements(spark, sf_dir).select("doc", *big("page_number", "elem_no"), F.md5(text.code_form(F.col("text"))).alias("form_md5"))


def json_sql(c: str) -> str:
    out = f"replace(replace({c}, '''', '\"'), '\"\"', '\"')"
    for a, b in text.JSON_FORMS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({out}, '(\\w+)=([\\w\\-]+)', '\\1-\\2', 'g'), ',\\s*([}}\\]])', '\\1', 'g')"


@query(f"""with {CODE_EL} select doc, page_number, elem_no, case when s = '' then 'empty' when json_valid({json_sql('s')}) then 'json'
 when regexp_matches(s, '{text.PYTHON_WORDS}') or regexp_matches(s, '{text.PYTHON_SHAPES}') then 'python' when regexp_matches(s, '{text.DEVICE_CONFIG}') then 'config' when regexp_matches(s, '{text.DEVICE_OUTPUT}') then 'output'
 when regexp_matches(s, '{text.HTTP_REQUEST}') then 'http' when not regexp_matches(s, '{text.KEY_VALUE_STOP}') and (contains(s, ':') or regexp_matches(s, '\\s{{2,}}')) then 'key_value' else 'plain' end as class from ce""")
def code_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_elements(spark, sf_dir).select("doc", *big("page_number", "elem_no"), text.code_class(F.col("text")).alias("class"))


CLASS = f"""case when s = '' then 'empty' when json_valid({json_sql('s')}) then 'json'
 when regexp_matches(s, '{text.PYTHON_WORDS}') or regexp_matches(s, '{text.PYTHON_SHAPES}') then 'python' when regexp_matches(s, '{text.DEVICE_CONFIG}') then 'config' when regexp_matches(s, '{text.DEVICE_OUTPUT}') then 'output'
 when regexp_matches(s, '{text.HTTP_REQUEST}') then 'http' when not regexp_matches(s, '{text.KEY_VALUE_STOP}') and (contains(s, ':') or regexp_matches(s, '\\s{{2,}}')) then 'key_value' else 'plain' end"""
JUMP = "('continue', 'break', 'pass')"
GOES_ON = "^(?:(?:except|elif|else|finally|class|def):|(?:continue|break|pass|return)\\b)"


def folded(moves: str, step: str) -> str:
    """Lines with a running depth: moves are texts of `closes opens line`, the state is `depth text`; step: how many spaces a level has."""
    level = "greatest(string_split(t, chr(1))[1]::int - string_split(m, chr(1))[1]::int, 0)"
    line = f"case when string_split(m, chr(1))[3] = '' then '' else repeat('{step}', {level}) || string_split(m, chr(1))[3] end"
    return f"""regexp_replace(string_split(list_reduce(list_prepend('0' || chr(1), {moves}),
 lambda t, m: greatest({level} + string_split(m, chr(1))[2]::int, 0) || chr(1) || string_split(t, chr(1))[2] || {line} || chr(10)), chr(1))[2], '\\n$', '')"""


BY_SYNTAX = folded(f"""list_transform(bare, lambda x, i: regexp_matches(x, '^(?:except|elif|else|finally):')::int || chr(1) || ((x not in {JUMP} and ends_with(x, ':'))::int
 - (x in {JUMP} and coalesce(bare[i + 1], '') <> '' and not regexp_matches(coalesce(bare[i + 1], ''), '{GOES_ON}'))::int) || chr(1) || x)""", "    ")
BY_BLOCK = folded("""list_transform(list_filter(bare, lambda x: x <> ''), lambda x: (lower(x) in ('exit', 'end'))::int || chr(1) || regexp_matches(x, '(?i)^(?:configure terminal|interface|router|vlan|spbm)\\b')::int || chr(1) || x)""", "  ")
BY_STEP = "array_to_string(list_transform(bare, lambda x, i: case when x = '' then '' else repeat('    ', round_even((depth[i] - least) / step, 0)::int) || x end), chr(10))"
KEYED = """array_to_string(list_transform(bare, lambda x: case when contains(x, ':') and not regexp_matches(x, '^(?:if|elif|else|for|while|try|except|finally|with|def|class).*:')
 then trim(left(x, instr(x, ':') - 1)) || ': ' || trim(substr(x, instr(x, ':') + 1)) else x end), chr(10))"""


@query(f"""with {CODE_EL}, k as (select *, {CLASS} as class, string_split(s, chr(10)) as raw from ce), l as (select *, list_transform(raw, lambda x: {stripped('x')}) as bare, list_transform(raw, lambda x: length(regexp_extract(x, '^{WS}*'))) as depth from k),
 d as (select *, list_min(list_filter(depth, lambda v, i: bare[i] <> '')) as least from l), e as (select *, coalesce(list_min(list_filter(depth, lambda v, i: bare[i] <> '' and v > least)) - least, 4)::double as step from d)
select doc, page_number, elem_no, '```' || case class when 'python' then 'python' when 'http' then 'http' else '' end || chr(10) || case class when 'python' then regexp_replace(case when len(list_filter(raw, lambda x, i: bare[i] <> '' and regexp_matches(x, '^[ \\t]'))) > 0 then {BY_STEP} else {BY_SYNTAX} end, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')
 when 'config' then {BY_BLOCK} when 'key_value' then {KEYED} else s end || chr(10) || '```' as formatted from e""")
def code_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_elements(spark, sf_dir).select("doc", *big("page_number", "elem_no"), code.format_code(F.col("text")).alias("formatted"))


def code_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of code, and the pages' own text."""
    rows = elements(spark, sf_dir)
    accurate = accurate_lines(rows)
    pages = accurate.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return rows.where("label = 'code'").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.col("text").alias("code")), pages


@query()
def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = code.best_windows(*code_pages(spark, sf_dir))
    return best.select("doc", "page_no", "elem_no", "segment", F.round("score", 4).alias("score"))


@query()
def code_blocks_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = code_pages(spark, sf_dir)
    docs = pieces.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "elem_no", "code"))), lambda x: F.concat(F.lit("```\n"), x["code"], F.lit("\n```"))), "\n\n").alias("text"))
    changes = pieces.where("code is not null").select("doc", F.struct("page_no", "elem_no").alias("place"), F.upper("code").alias("old"), F.concat(F.lit("```text\n"), "code", F.lit("\n```")).alias("new"))
    return code.blocks_replaced(docs, changes).select("doc", "n_replaced", F.md5("text").alias("text_md5"))


@query()
def code_page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pages = code_pages(spark, sf_dir)
    pieces = figures.neighbours(elements(spark, sf_dir), keep=("text",)).where("text is not null")
    asked = pieces.select("doc", (F.col("page_number") * 100_000 + F.col("elem_no")).alias("elem_no"), F.col("text").alias("code"), "context", F.lit(None).cast("array<double>").alias("bbox"))
    best = code.distinct_matches(code.page_matches(asked, pages))
    return best.select("doc", "elem_no", "page_no", "strategy", F.round("confidence", 4).alias("confidence"), F.md5("pdf_text").alias("text_md5"))


@query(f"""with {EL}, o as (select *, row_number() over (partition by doc, page_number order by coalesce(reading_order, 0), elem_no) as place from el)
select c.doc, c.page_number::bigint as page_number, c.elem_no, coalesce(string_agg(coalesce(n.text, ''), ' ' order by n.place) filter (where (n.place < c.place and n.label in ('para', 'header', 'title', 'list')) or (n.place > c.place and n.label in ('para', 'header', 'title'))), '') as context
from o c left join o n on n.doc = c.doc and n.page_number = c.page_number and n.place between c.place - 3 and c.place + 3 and n.place <> c.place where c.label = 'code' group by c.doc, c.page_number, c.elem_no""")
def code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.neighbours(elements(spark, sf_dir)).select("doc", *big("page_number", "elem_no"), "context")


# segments: tables, catalogues, figures


@query(f"""with {EL}, pc as (select doc, page_number, string_agg(text, chr(10) || chr(10) order by coalesce(reading_order, 0), elem_no) as content from el where text is not null group by doc, page_number),
 a as (select doc, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_number) as text from pc group by doc), g as (select doc, list(text order by page_number, elem_no) as gone from el where label = 'catalogue' and text <> '' group by doc)
select a.doc, md5(case when gone is null then a.text else list_reduce(list_prepend(a.text, gone), lambda t, g: case when contains(t, g) then replace(t, g, '') else replace(t, replace(g, chr(10), ' '), '') end) end) as text_md5 from a left join g on g.doc = a.doc""")
def catalogues_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    return tables.catalogues_removed(lines.assembled(rows), rows).select("doc", F.md5("text").alias("text_md5"))


#: Tables whose tags have no attributes, as the ones given are, in Markdown.
CELLS = f"""list_transform(regexp_extract_all(text, '<tr>(.*?)</tr>', 1, 's'), lambda r: list_transform(regexp_extract_all(r, '<t[hd]>(.*?)</t[hd]>', 1, 's'), lambda c: replace(trim(regexp_replace(c, '{WS}+', ' ', 'g')), '|', '\\|')))"""
ROW = "'| ' || array_to_string(list_concat(c, list_transform(range(len(c), width), lambda i: '')), ' | ') || ' |'"
TABLES = f"""tc as (select *, list_filter({CELLS}, lambda c: len(c) > 0) as cs from el where label = 'tab' and text is not null), tw as (select *, list_max(list_transform(cs, lambda c: len(c))) as width from tc),
 tm as (select doc, page_number, elem_no, text, case when not contains(text, '<') then {stripped('text')} when len(cs) = 0 then '' else array_to_string(list_concat([list_transform(cs[1:1], lambda c: {ROW})[1], '|' || repeat(' --- |', width::int)], list_transform(cs[2:], lambda c: {ROW})), chr(10)) end as table_md from tw)"""


@query(f"with {EL}, {TABLES} select doc, page_number::bigint as page_number, elem_no, table_md from tm")
def tables_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir, ("label", "text")).where("label = 'tab' and text is not null")
    return rows.select("doc", *big("page_number", "elem_no"), tables.html_table_to_md(F.col("text")).alias("table_md"))


@query(f"""with {EL}, {TABLES}, pc as (select doc, page_number, string_agg(text, chr(10) || chr(10) order by coalesce(reading_order, 0), elem_no) as content from el where text is not null group by doc, page_number),
 a as (select doc, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_number) as text from pc group by doc), g as (select doc, list(text || chr(1) || table_md order by page_number, elem_no) as pairs from tm where text <> '' group by doc)
select a.doc, md5(case when pairs is null then a.text else list_reduce(list_prepend(a.text, pairs), lambda t, p: replace(t, string_split(p, chr(1))[1], string_split(p, chr(1))[2])) end) as text_md5 from a left join g using (doc)""")
def tables_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    return tables.tables_refined(lines.assembled(rows), rows).select("doc", F.md5("text").alias("text_md5"))


@query(f"""with {EL}, o as (select *, coalesce(reading_order, 0) as ord, row_number() over (partition by doc, page_number order by coalesce(reading_order, 0), elem_no) - 1 as place from el),
 f as (select f.doc, f.page_number, f.elem_no, coalesce((select max(s.place) from o s where s.doc = f.doc and s.page_number = f.page_number and s.ord < f.ord and s.label in ('sec', 'sub_sec', 'sub_sub_sec', 'header', 'title')), 0) as a,
  coalesce((select min(s.place) from o s where s.doc = f.doc and s.page_number = f.page_number and s.ord > f.ord and s.label in ('sec', 'sub_sec', 'sub_sub_sec')), (select count(*) from o s where s.doc = f.doc and s.page_number = f.page_number)) as b from o f where f.label = 'fig'),
 t as (select f.doc, f.page_number, f.elem_no, f.a, f.b, coalesce(string_agg({stripped('o.text')}, chr(10) || chr(10) order by o.place), '') as context from f left join o on o.doc = f.doc and o.page_number = f.page_number and o.place >= f.a and o.place < f.b
  and coalesce(o.label not in ('fig', 'watermark', 'page_header', 'page_footer'), true) and length({stripped('o.text')}) > 3 group by f.doc, f.page_number, f.elem_no, f.a, f.b)
select doc, page_number::bigint as page_number, elem_no, a as section_start, b as section_end, case when length(context) > 5000 then context[1:5000] || '...' else context end as context from t""")
def figure_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.figure_contexts(elements(spark, sf_dir)).select("doc", *big("page_number", "elem_no", "section_start", "section_end"), "context")


@query(f"""with {EL} select doc, page_number::bigint as page_number, elem_no, case when coalesce(figure_path, '') <> '' then figure_path else regexp_extract(coalesce(text, ''), '!\\[Figure\\]\\(([^)]+)\\)', 1) end as path,
 regexp_matches(lower(case when coalesce(figure_path, '') <> '' then figure_path else regexp_extract(coalesce(text, ''), '!\\[Figure\\]\\(([^)]+)\\)', 1) end), '\\.(png|jpg|jpeg|gif|bmp)$') as is_image from el where label = 'fig'""")
def figure_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.figure_infos(elements(spark, sf_dir, ("label", "text", "figure_path"))).select("doc", *big("page_number", "elem_no"), "path", "is_image")


@query("select job_id as doc, md5(regexp_replace(markdown, '!\\[([^\\]]*)\\]\\(figures/([^)]+)\\)', '![\\1](https://host/jobs/' || job_id || '/figures/\\2)', 'g')) as text_md5 from job_result where markdown is not null")
def figure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc", F.md5(text.figure_links(F.col("text"), F.concat(F.lit("https://host/jobs/"), "doc"))).alias("text_md5"))
