"""Queries of sources, sinks and page text over the given tables, each beside the SQL that must give the same rows.

Inputs that the tables don't hold (spans, protocol lines, damaged lines) are made from them by the same plain expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import evaluate, headers, headings, lines, ocr, records
from foliospark.plans.records import JOBS, jobs
from foliospark.plans.refine import DL, EL, FURNITURE, JL, NUMBERED, WS, big, elements, form_of, markdown, stripped, styled, two_hierarchies, STYLED, TWO, HAS_BULLET, code_elements, CODE_EL, accurate_lines
from foliospark.sources import files, sinks
from foliospark.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# lines and their protocols

PROTOCOL = "case when line_no % 9 = 1 then '=== Page ' || (line_no // 18 + 1) || ' ===' when line_no % 9 = 2 then 'Text: ' || line when line_no % 9 = 3 then '--- Block #1 ---' else line end"


def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with the marks of the raw-text protocol put over every ninth; pages come twice."""
    rows, n = lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), F.col("line_no") % 9
    mark = F.concat(F.lit("=== Page "), F.floor(F.col("line_no") / 18) + 1, F.lit(" ==="))
    return rows.withColumn("line", F.when(n == 1, mark).when(n == 2, F.concat(F.lit("Text: "), F.col("line"))).when(n == 3, "--- Block #1 ---").otherwise(F.col("line")))


@query(f"""with {DL}, p as (select doc, line_no, {PROTOCOL} as line from dl), m as (select *, try_cast(nullif(regexp_extract(line, '^=== Page (\\d+) ===', 1), '') as int) as mark from p),
 g as (select *, count(mark) over (partition by doc order by line_no) as part, last_value(mark ignore nulls) over (partition by doc order by line_no rows between unbounded preceding and current row) as page_no from m),
 k as (select *, max(part) over (partition by doc, page_no) as last from g where page_no is not null and mark is null), s as (select doc, page_no, {stripped('line')} as x from k where part = last)
select doc, page_no::bigint as page_no, count(*) as n, md5(string_agg(case when starts_with(x, 'Text: ') then x[7:] else x end, '|' order by x)) as text_md5 from s
where x <> '' and (starts_with(x, 'Text: ') or not (starts_with(x, '---') or starts_with(x, '===') or starts_with(x, 'Type:') or starts_with(x, 'Page Size:'))) group by doc, page_no""")
def protocol_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.text_protocol(protocol_lines(spark, sf_dir)).select("doc", "page_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("x"), lines.protocol_text(F.col("line")).alias("said")).where("said is not null")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "said"))), lambda r: r["said"]), "|")
    return rows.groupBy("doc", F.col("page_no").cast("bigint").alias("page_no")).agg(F.count(F.lit(1)).alias("n"), F.md5(said).alias("text_md5"))


@query(f"with {JL} select doc, 1 + coalesce(sum((regexp_full_match(line, '---\\s*'))::int) over (partition by doc order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as page_no, line_no, length(line)::bigint as n_chars from jl")
def pages_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.page_of_line(lines.lines_of(markdown(spark, sf_dir), "doc", "text"), F.col("line").rlike(r"^---\s*$"))
    return rows.select("doc", *big("page_no", "line_no"), F.length("line").cast("bigint").alias("n_chars"))


@query(f"""with {JL}, b as (select *, regexp_matches(line, '^{WS}*$') as blank, lag(line, 2) over w as two, lag(line) over w as one from jl window w as (partition by doc order by line_no))
select doc, count(*) as n_lines, sum(line_no)::bigint as line_sum from b where not (blank and coalesce(regexp_matches(one, '^{WS}*$') and regexp_matches(two, '^{WS}*$'), false)) group by doc""")
def blank_runs_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.blank_runs_limited(lines.lines_of(markdown(spark, sf_dir), "doc", "text"))
    return kept.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_no").cast("bigint").alias("line_sum"))


# spans

SPANS = f"""sp as (select doc, line_no // 40 + 1 as page, line_no // 8 as block_no, line_no, i - 1 as span_no, w[i] as text, 8.0 + length(w[i]) % 7 + (length(w[i]) % 3) / 8.0 as size, (doc % 2) * 16 as flags
 from (select doc, line_no, string_split(line, ' ') as w from dl where length(line) between 1 and 80), unnest(range(1, len(w) + 1)) as t(i))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents' lines as styled spans: pages of forty lines, blocks of eight."""
    rows = lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.length("line").between(1, 80))
    words = rows.select("doc", "line_no", F.posexplode(F.split("line", " ", -1)).alias("span_no", "text"))
    n = F.length("text")
    return words.select(
        "doc", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), F.lit(792.0).alias("page_height"), F.lit(612.0).alias("page_width"), F.floor(F.col("line_no") / 8).cast("int").alias("block_no"), "line_no",
        F.array(F.lit(0.0), F.col("line_no").cast("double"), F.lit(1.0), F.lit(2.0)).alias("line_bbox"), "span_no", "text", (8.0 + n % 7 + (n % 3) / 8.0).cast("double").alias("size"), (F.col("doc") % 2 * 16).cast("int").alias("flags"),
        F.lit("f").alias("font"), F.lit(0).alias("color"))


@query(f"""with {DL}, {SPANS}, k as (select *, {stripped('text')} as t from sp) select doc, page::bigint as page, block_no::bigint as block_no, line_no, string_agg(t, ' ' order by span_no) as text, round_even(arg_min(size, span_no), 2)::double as size, arg_min(flags, span_no)::bigint as flags
 from k where t <> '' group by doc, page, block_no, line_no""")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headings.span_lines(spans(spark, sf_dir))
    return rows.select("doc", *big("page", "block_no", "line_no"), "text", "size", *big("flags"))


@query(f"""with {DL}, {SPANS}, l as (select doc, page, block_no, line_no, string_agg(text, '' order by span_no) as line from sp group by all) select doc, page::bigint as page_no, md5(string_agg(line, chr(10) order by block_no, line_no)) as content_md5 from l group by doc, page""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_texts(spans(spark, sf_dir)).select("doc", *big("page_no"), F.md5("content").alias("content_md5"))


@query(f"""with {DL}, {SPANS}, k as (select * from sp where regexp_matches(text, '[^\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')),
 b as (select doc, page, block_no, '--- Block #' || block_no || ' ---' || chr(10) || 'Type: Text' || chr(10) || string_agg('    Text: ' || text, chr(10) order by line_no, span_no) || chr(10) || repeat('-', 50) as shown from k group by doc, page, block_no),
 p as (select doc, page, '=== Page ' || page || ' ===' || chr(10) || 'Page Size: 612.0 x 792.0' || chr(10) || string_agg(shown, chr(10) order by block_no) as shown from b group by doc, page)
select doc, md5(string_agg(shown, chr(10) order by page)) as text_md5 from p group by doc""")
def raw_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.raw_protocol(spans(spark, sf_dir)).select("doc", F.md5("text").alias("text_md5"))


# headings with other options


@query(f"""with {DL}, {STYLED}, f as (select * from st where not is_header and not is_footer), h as (select doc, list_sort(list(size)) as s from f group by doc), th as (select doc, s[floor(len(s) * 0.75)::int + 1] as t from h),
 b as (select f.* from f join th using (doc) where is_bold and size >= t * 0.9), g as (select doc, size, is_bold, count(*) as n, max(max(size)) over (partition by doc) as top from b group by doc, size, is_bold),
 lv as (select doc, size, row_number() over (partition by doc order by size desc) as level from g where n >= 2 or size >= top * 0.9)
select b.doc, b.pos, lv.level, row_number() over (partition by b.doc order by b.pos) - 1 as heading_no from b join lv on lv.doc = b.doc and lv.size = b.size where lv.level <= 6""")
def heading_levels_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.levelled(styled(spark, sf_dir), bold_only=True).select("doc", *big("pos", "level", "heading_no"))


@query("select doc_id, round_even(length(coalesce(text, '')) % 4000 / 32.0, 1)::double as one, round_even(length(coalesce(text, '')) % 4000 / 32.0, 2)::double as two from documents")
def sizes_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit(""))) % 4000 / 32.0
    return table(spark, sf_dir, "documents").select("doc_id", text.rounded(size, 1).alias("one"), text.rounded(size, 2).alias("two"))


@query(f"with recursive {TWO}, m as (select doc, path from gt except select doc, path from ex), k as (select doc, path, row_number() over (partition by doc order by path) as r from m) select doc, count(*) as n, string_agg(path, '|' order by path) filter (where r <= 10) as paths from k group by doc")
def missing_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_hierarchies(spark, sf_dir)
    return evaluate.listed(evaluate.missing(headings.sections(a), headings.sections(b)), ["doc"], "path").select("doc", "n", F.array_join("items", "|").alias("paths"))


# headers, corrections, counts

MARK = f"{form_of('t')}"
WORD = """replace(replace(replace(w, '-', '\\E[-–—]\\Q'), '''', '\\E[''‘’]\\Q'), '"', '\\E["“”]\\Q')"""
SPACE = r"[ \t\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""with recursive {EL}, {FURNITURE}, pc as (select doc, page_number, string_agg(text, chr(10) || chr(10) order by coalesce(reading_order, 0), elem_no) as content from el where text is not null group by doc, page_number),
 a as (select doc as job_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_number) as markdown from pc group by doc),
 n as (select job_id as doc, string_split_regex({NUMBERED}, '<!-- page_break_\\d+ -->') as s from a), pg2 as (select doc, i as page_no, s[i] as content, len(s) as last from n, unnest(range(1, len(s) + 1)) as t(i)),
 tx as (select doc, page_number as page_no, row_number() over (partition by doc, page_number order by case kind when 'header' then 0 when 'footer' then 1 else 2 end, elem_no) as k, text as t from fu where kind <> 'header' or page_number <> 1),
 pt as (select doc, page_no, k, '(?mi)^{SPACE}*' || array_to_string(list_transform(string_split({MARK}, ' '), lambda w: '\\Q' || {WORD} || '\\E'), '{WS}+') || '{SPACE}*(?:\\n|\\z)' as pattern from tx),
 f as (select doc, page_no, 0 as k, {stripped('content')} as page, 0 as n from pg2
  union all select f.doc, f.page_no, f.k + 1, x.page, f.n + (x.page <> f.page)::int from f join pt on pt.doc = f.doc and pt.page_no = f.page_no and pt.k = f.k + 1,
   lateral (select case when f.page = '' then '' else {stripped("regexp_replace(regexp_replace(f.page, pt.pattern, '', 'g'), '\\n' || '" + WS + "*\\n" + WS + "*\\n+', chr(10) || chr(10), 'g')")} end as page) x),
 l as (select doc, page_no, arg_max(page, k) as page, max(n) as n from f group by doc, page_no)
select doc, page_no::bigint as page_no, n::bigint as removals, md5(case when n > 0 then case when page_no > 1 then chr(10) || chr(10) else '' end || page || case when page_no < last then chr(10) || chr(10) else '' end else content end) as content_md5 from l join pg2 using (doc, page_no)""")
def header_texts_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    pages = lines.pages_of(lines.assembled(rows).withColumn("text", lines.numbered(F.col("text"))), "doc", "text")
    return headers.removed(pages, headers.furniture(rows)).select("doc", *big("page_no", "removals"), F.md5("content").alias("content_md5"))


FIXED = "translate(x, '@!', 'ai')"


@query(f"""with {EL}, pc as (select doc, page_number, string_agg(text, chr(10) order by elem_no) as content from el where text is not null group by doc, page_number),
 w as (select doc, page_number, elem_no, i, trim(s[i]) as x from (select doc, page_number, elem_no, string_split(text, ' ') as s from el where text is not null and label = 'para'), unnest(range(1, len(s) + 1)) as t(i)),
 k as (select doc, page_number, list(x order by elem_no, i) as old, list({FIXED} order by elem_no, i) as new from w where x <> '' and x <> {FIXED} group by doc, page_number)
select pc.doc, pc.page_number::bigint as page_no, coalesce(len(old), 0)::bigint as n_fixes, md5(case when old is null then content else list_reduce(list_prepend(content, list_transform(old, lambda o, i: o || chr(1) || new[i])),
 lambda t, f: case when instr(t, string_split(f, chr(1))[1]) > 0 then left(t, instr(t, string_split(f, chr(1))[1]) - 1) || string_split(f, chr(1))[2] || substr(t, instr(t, string_split(f, chr(1))[1]) + length(string_split(f, chr(1))[1])) else t end) end) as content_md5 from pc left join k using (doc, page_number)""")
def pages_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of single words, each at its first occurrence in what the ones before left."""
    rows = elements(spark, sf_dir, ("label", "text")).where("text is not null")
    pages = rows.groupBy("doc", F.col("page_number").alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "text"))), lambda e: e["text"]), "\n").alias("content"))
    words = rows.where("label = 'para'").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.posexplode(F.split("text", " ", -1)).alias("part", "text")).withColumn("text", F.trim("text"))
    fixes = words.withColumn("line", F.translate("text", "@!", "ai")).where("text <> '' and text <> line")
    counts = fixes.groupBy("doc", "page_no").agg(F.count(F.lit(1)).alias("n_fixes"))
    return ocr.corrected_pages(pages, fixes).join(counts, ["doc", "page_no"], "left").select("doc", *big("page_no"), F.coalesce("n_fixes", F.lit(0)).alias("n_fixes"), F.md5("content").alias("content_md5"))


@query(f"""with {EL}, al as (select doc, page_number as page_no, elem_no * 1000 + i - 1 as line_no, translate(s[i], '@!', 'ai') as line, s[i] as text, i from (select doc, page_number, elem_no, string_split(text, chr(10)) as s from el where text is not null and label <> 'tab'), unnest(range(1, len(s) + 1)) as t(i))
select doc, page_no::bigint as page, text as ocr_text, line as corrected_text, 1.0::double as similarity from al where trim(text) <> trim(line) and length(trim(line)) >= length(trim(text))""")
def corrections_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of corrections of lines whose accurate line is known by its place."""
    rows = elements(spark, sf_dir, ("label", "text"))
    seen = rows.where("text is not null and label <> 'tab'").select("doc", F.col("page_number").alias("page_no"), "elem_no", F.posexplode(F.split("text", "\n", -1)).alias("part", "text"))
    best = seen.withColumns({"line_no": F.col("elem_no") * 1000 + F.col("part"), "similarity": F.lit(1.0)}).join(accurate_lines(rows), ["doc", "page_no", "line_no"])
    log = sinks.corrections_log(ocr.corrections(best))
    return log.select("doc", *big("page"), "ocr_text", "corrected_text", "similarity")


@query(f"""with {EL}, f as (select coalesce(label, '') as label, text is null as failed, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {HAS_BULLET})) as n from el)
select label, count(*) as n, count(*) filter (where not failed and n > 0) as n_changed, count(*) filter (where not failed and n = 0) as n_skipped, count(*) filter (where failed) as n_failed, sum(case when failed then 0 else n end)::bigint as total,
 round((count(*) - count(*) filter (where failed)) / count(*) * 100, 4) as rate from (select label, failed, n from f) group by label""")
def bullet_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a batch of list marks went, by label; elements without text count as failed."""
    rows = elements(spark, sf_dir, ("label", "text")).withColumn("label", F.coalesce("label", F.lit("")))
    out = evaluate.outcomes(rows, ["label"], F.col("text").isNull(), lines.bullet_count(F.coalesce("text", F.lit(""))))
    return out.withColumn("total", F.col("total").cast("bigint"))


def hard_form_sql(c: str) -> str:
    out = f"translate(lower({c}), '{text.CODE_SIGNS[0]}', '{text.CODE_SIGNS[1]}')"
    for a, b in text.CODE_FORMS + text.DIGRAPHS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '{WS}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s\\-_]', ' ', 'g'), '{WS}+', ' ', 'g'))"


@query(f"with {CODE_EL} select doc, page_number, elem_no, md5({hard_form_sql('s')}) as form_md5 from ce")
def code_forms_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_elements(spark, sf_dir).select("doc", *big("page_number", "elem_no"), F.md5(text.code_form(F.col("text"), True)).alias("form_md5"))


# files and names

MEDIA = "case {} when '.png' then 'image/png' when '.jpg' then 'image/jpeg' when '.jpeg' then 'image/jpeg' when '.gif' then 'image/gif' when '.bmp' then 'image/bmp' when '.webp' then 'image/webp' when '.svg' then 'image/svg+xml' when '.pdf' then 'application/pdf' when '.md' then 'text/markdown' when '.json' then 'application/json' when '.txt' then 'text/plain' else 'image/png' end"
SUFFIX = "lower(regexp_extract({}, '(\\.[^./\\\\]+)$', 1))"
STEM = "regexp_extract({}, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1)"


@query(f"with {JOBS} select id, {MEDIA.format(SUFFIX.format('pdf_key'))} as pdf_media, {MEDIA.format(SUFFIX.format('markdown_key'))} as markdown_media, url_encode(filename) as filename_part, coalesce(nullif({STEM.format('filename')}, ''), nullif({STEM.format('pdf_key')}, '')) as name, 'data:text/plain;base64,' || base64(encode(filename)) as link from j")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir, "filename", "pdf_key", "markdown_key")
    return rows.select(
        "id", text.media_type(F.col("pdf_key")).alias("pdf_media"), text.media_type(F.col("markdown_key")).alias("markdown_media"), text.url_part(F.col("filename")).alias("filename_part"),
        text.document_name(F.col("filename"), F.col("pdf_key")).alias("name"), text.data_url(F.encode("filename", "UTF-8"), F.lit("text/plain")).alias("link"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each job: its own keys, and for two of three the files that a run leaves."""
    n = F.length("filename")
    made = lambda path: F.when(n % 3 < 2, F.concat(*path))
    paths = F.array("pdf_key", "markdown_key", "segments_key", made([F.lit("out/"), F.col("id"), F.lit(".md")]), made([F.lit("out/"), F.col("id"), F.lit("_backup.md")]), made([F.lit("out/_pipeline/"), F.col("id"), F.lit(".md")]), made([F.lit("out/figures/"), F.col("id"), F.lit(".PNG")]))
    return jobs(spark, sf_dir, "filename", "pdf_key", "markdown_key", "segments_key").select(F.col("id").alias("doc"), F.explode(paths).alias("path")).where("path is not null")


MADE = "case when length(filename) % 3 < 2 then {} end"
FILES = f"o as (select * from (select id as doc, unnest([pdf_key, markdown_key, segments_key, {', '.join(MADE.format(x) for x in (chr(39) + 'out/' + chr(39) + ' || id || ' + chr(39) + '.md' + chr(39), chr(39) + 'out/' + chr(39) + ' || id || ' + chr(39) + '_backup.md' + chr(39), chr(39) + 'out/_pipeline/' + chr(39) + ' || id || ' + chr(39) + '.md' + chr(39), chr(39) + 'out/figures/' + chr(39) + ' || id || ' + chr(39) + '.PNG' + chr(39)))}]) as path from j) where path is not null)"


@query(f"""with {JOBS}, {FILES}, u as (select doc, path, regexp_extract(path, '([^/]+)$', 1) as name from o where {SUFFIX.format('path')} = '.md' and not contains(path, '/_pipeline/')),
 k as (select doc, path, row_number() over (partition by doc order by (name = doc || '.md') desc, path) as r from u where not contains(name, '_backup')) select j.id as doc, k.path as path from j left join k on k.doc = j.id and k.r = 1""")
def outputs_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chosen_output(jobs(spark, sf_dir).select(F.col("id").alias("doc")), outputs(spark, sf_dir), ".md")


@query(f"with {JOBS}, {FILES} select doc, path from o where contains(path, '/figures/') and {SUFFIX.format('path')} in ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp')")
def figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.figure_files(outputs(spark, sf_dir))


# tables of jobs


@query(f"with {JOBS}, n as (select id || '-new' as id, filename from j where page = 1) select id, filename, page::bigint as page from j union all select id, filename, null from n")
def jobs_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = jobs(spark, sf_dir, "filename", "page")
    new = old.where("page = 1").select(F.concat("id", F.lit("-new")).alias("id"), "filename")
    return records.added(old, new).select("id", "filename", *big("page"))


@query(f"with {JOBS} select id, coalesce(page, 0)::bigint as page, 'none' as hint from j")
def jobs_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.migrated(jobs(spark, sf_dir, "page"), {"page": ("bigint", 0), "hint": ("string", "none")})


@query(f"""with {JOBS}, s as (select job_id, coalesce(max(try_cast(nullif(regexp_extract(line, '(?i)\\bSTEP\\s+(\\d+)', 1), '') as int)), 0) as step from log_events where job_id is not null group by job_id)
select id, status, coalesce(step, 0)::bigint as step from j left join s on s.job_id = j.id""")
def jobs_with_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.streaming import logs

    steps = logs.last_steps(table(spark, sf_dir, "log_events")).select(F.col("job_id").alias("id"), "step")
    return jobs(spark, sf_dir, "status").join(steps, "id", "left").select("id", "status", F.coalesce("step", F.lit(0)).cast("bigint").alias("step"))


@query(f"with {JOBS}, k as (select id from j order by created_at desc nulls last, id limit 20 offset 30) select id from k")
def jobs_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(jobs(spark, sf_dir, "created_at"), "created_at", 20, offset=30, tie="id").select("id")
