"""Queries of the training-data operators, by problem, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import boilerplate, lookalike, markup, matching, mixing, repetition, scanned, tokens, truncation
from foliospark.sources.tables import explode_elements, recognition, table


def p1_boilerplate(spark: SparkSession, sf_dir: str) -> boilerplate.Boilerplate:
    return boilerplate.Boilerplate(recognition(spark, sf_dir, ["label", "text"], ["rec_id", "source"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_boilerplate(spark, sf_dir).found()


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_boilerplate(spark, sf_dir).described()


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_boilerplate(spark, sf_dir).cleaned()


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "job_result").select(F.lit("job_result").alias("table_name"), F.col("job_id").alias("row_key"), F.col("markdown").alias("text"))
    records = repetition.record_texts(recognition(spark, sf_dir, ["text"], ["rec_id"]))
    records = records.select(F.lit("recognition_json").alias("table_name"), F.col("rec_id").cast("string").alias("row_key"), "text")
    return repetition.repetition(jobs.unionByName(records), ["table_name", "row_key"]).dropDuplicates(["table_name", "row_key"])


def p2_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_shares(spark, sf_dir).select("table_name", "row_key", F.round("repeated_share", 6).alias("repeated_share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the field doesn't retain, where the exact share confirms it."""
    return p2_shares(spark, sf_dir).where(~F.col("retained") & (F.col("repeated_share") >= repetition.MIN_SHARE)).select("table_name", "row_key")


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(table(spark, sf_dir, "job_result").withColumnRenamed("markdown", "text"), ["job_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_texts(spark, sf_dir).where("n_markup > 0").select("job_id")


def p4_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text) of code matches and elements."""
    matches = table(spark, sf_dir, "code_match").select(F.concat(F.lit("c"), "match_id").alias("key"), F.col("pdf_text").alias("text"))
    elements = explode_elements(recognition(spark, sf_dir, ["text"], ["rec_id"]), ["text"])
    return matches.unionByName(elements.select(F.concat(F.lit("r"), F.concat_ws("-", "rec_id", "page_number", "elem_no")).alias("key"), "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking(p4_given(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.classes(p4_given(spark, sf_dir))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.unified(p4_given(spark, sf_dir))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition(spark, sf_dir, ["label", "text", "reading_order"], ["rec_id", "source_file"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in whose reading a hyphen was dropped or a confusion undone, and running headers and page numbers."""
    cases = scanned.repaired(p5_records(spark, sf_dir), "elements").where("kind <> 'text' or breaks > 0 or confusions > 0")
    return cases.select("rec_id", "page_number", "elem_no")


def p5_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(p5_records(spark, sf_dir), "elements")


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(p5_records(spark, sf_dir), "paragraphs")


def p7_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Code matches as queries, code elements as documents."""
    queries = table(spark, sf_dir, "code_match").select(
        F.col("match_id").cast("string").alias("q"), F.col("pdf_text").alias("text"), F.col("pdf_name").alias("name"), F.col("page_number").alias("page"), F.col("context_text").alias("context"), F.col("bbox").alias("box"),
        F.col("confidence_score").alias("score"))
    fields = ["label", "text", "bbox", "confidence", "context_text"]
    elements = explode_elements(recognition(spark, sf_dir, fields, ["rec_id", "source_file"]), fields).where("label = 'code'")
    documents = elements.select(
        F.concat_ws("-", "rec_id", "page_number", "elem_no").alias("d"), "text", F.col("source_file").alias("name"), F.col("page_number").alias("page"), F.col("context_text").alias("context"), F.col("bbox").alias("box"),
        F.col("confidence").alias("score"))
    return queries, documents


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(*p7_sides(spark, sf_dir))
    key = F.split("d", "-")
    return found.select(key[0].cast("bigint").alias("rec_id"), key[1].cast("int").alias("page_number"), key[2].cast("int").alias("elem_no"), F.col("q").cast("bigint").alias("match_id"), "score", "confidence")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).select("rec_id", "page_number", "elem_no", "match_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: what every document's ids say, as a digest of their bytes."""
    ids = p8_ids(spark, sf_dir)
    return ids.select("doc_id", F.md5(tokens.decoded(F.col("ids"))).alias("text_md5"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixture(spark, sf_dir).chosen()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixture(spark, sf_dir).shares()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.Truncation(table(spark, sf_dir, "documents")).found()


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.Truncation(table(spark, sf_dir, "documents")).limits().drop("v")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.Truncation(table(spark, sf_dir, "documents")).sources()


QUERIES = {f.__name__: f for f in (p1_found, p1_blocks, p1_cleaned, p2_found, p2_shares, p2_repeated, p3_found, p3_texts, p4_found, p4_classes, p4_texts, p5_found, p5_elements, p5_paragraphs, p7_found, p7_pairs, p8_ids, p8_decoded, p9_chosen, p9_shares, p10_found, p10_limits, p10_sources)}

#: Records once, their elements that aren't null, and the elements' lines.
ELEMENTS = """r as (select rec_id, any_value(source) as source, any_value(pages) as pages from recognition_json group by rec_id),
pg as (select rec_id, source, unnest(pages) as p from r),
pe as (select rec_id, source, p.page_number as page_number, list_filter(p.elements, lambda e: e is not null) as es from pg),
el as (select rec_id, source, page_number, i as elem_no, es[i].label as label, es[i].text as text from pe, unnest(range(1, len(es) + 1)) as t(i))"""

#: Lines with their form, and the forms of enough support; strong: of high support.
LINES = """sp as (select *, string_split(text, chr(10)) as s from el where source is not null and text is not null and coalesce(label, '') <> 'code'),
 ln as (select source, rec_id, page_number, elem_no, i as line_no, trim(regexp_replace(lower(s[i]), '[^\\p{L}]+', ' ', 'g')) as form from sp, unnest(range(1, len(s) + 1)) as t(i)),
 n as (select source, count(distinct rec_id) as n from r where source is not null group by source),
 k as (select source, form, m, m * 10 >= n as strong from (select source, form, count(distinct rec_id) as m from ln where length(replace(form, ' ', '')) >= 8 group by source, form having count(distinct rec_id) >= 4) join n using (source) where m * 40 >= n)"""

#: Words of each text, and how many of them stand in a stretch of five that was said before.
REPEATED = """tx as (select 'job_result' as table_name, job_id as row_key, markdown as text from job_result where markdown is not null
  union all select 'recognition_json', rec_id::varchar, string_agg(text, chr(10) order by page_number, elem_no) from el where text is not null group by rec_id),
 w as (select table_name, row_key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as ws from tx),
 g as (select table_name, row_key, i, array_to_string(ws[i:i + 4], ' ') as gram from w, unnest(range(1, len(ws) - 3)) as t(i)),
 a as (select table_name, row_key, i, row_number() over (partition by table_name, row_key, gram order by i) > 1 as again from g),
 m as (select distinct table_name, row_key, i + d as i from a, (select unnest([0, 1, 2, 3, 4]) as d) where again),
 c as (select table_name, row_key, count(*) as n from m group by table_name, row_key)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with {ELEMENTS}, {LINES} select ln.rec_id, ln.page_number, ln.elem_no::int as elem_no, ln.line_no::int as line_no from ln join k using (source, form) where strong""",
    "p1_blocks": f"""with recursive {ELEMENTS}, {LINES}, fo as (select *, row_number() over (partition by rec_id, page_number order by elem_no, line_no) - 1 as spot, lead(form) over (partition by rec_id, page_number order by elem_no, line_no) as next from ln where length(replace(form, ' ', '')) >= 8),
 w as (select source, form, next, count(distinct rec_id) as m from fo where next is not null group by source, form, next having count(distinct rec_id) >= 4),
 e as (select w.source, w.form as a, w.next as b from w join k x on x.source = w.source and x.form = w.form join k y on y.source = w.source and y.form = w.next where w.m * 2 >= least(x.m, y.m)),
 u as (select source, a, b from e union select source, b, a from e), t as (select source, form, form as other from k union select t.source, t.form, u.b from t join u on u.source = t.source and u.a = t.other),
 c as (select source, form, min(other) as block from t group by source, form), pl as (select source, form, avg(spot) as place from fo group by source, form),
 o as (select * from c join k using (source, form) join pl using (source, form))
select source, block, string_agg(form, ' | ' order by place, form) as lines, count(*) as n_lines, count(*) filter (where not strong) as n_weak, max(m) as most_records from o group by source, block having bool_or(strong)""",
    "p1_cleaned": f"""with {ELEMENTS}, {LINES}, g as (select rec_id, page_number, elem_no, list(line_no) as gone from ln join k using (source, form) where strong group by all)
select el.rec_id, el.page_number, el.elem_no::int as elem_no, label, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as text from el left join g using (rec_id, page_number, elem_no)""",
    "p2_found": f"""with {ELEMENTS}, {REPEATED} select table_name, row_key from c join w using (table_name, row_key) where c.n >= 0.3 * len(w.ws)""",
    "p2_repeated": f"""with {ELEMENTS}, {REPEATED}, ids as (select 'job_result' as table_name, job_id as row_key from job_result union all select 'recognition_json', rec_id::varchar from r)
select table_name, row_key, round(coalesce(c.n / nullif(len(w.ws), 0), 0), 6)::double as repeated_share from ids left join w using (table_name, row_key) left join c using (table_name, row_key)""",
    "p8_decoded": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
