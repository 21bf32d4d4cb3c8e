"""Queries over jobs, users and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import records
from foliospark.plans.refine import EL
from foliospark.sources.tables import recognition, table
from foliospark.streaming import logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STATUSES = ["queued", "running", "done", "failed"]
JOBS = "j as (select distinct on (id) * from job)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def jobs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Jobs with the columns asked for; rows delivered twice count once."""
    return records.once(table(spark, sf_dir, "job").select("id", *columns), ["id"])


@query(f"with {JOBS} select id, filename from j order by created_at desc nulls last, id limit 50")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(jobs(spark, sf_dir, "filename", "created_at"), "created_at", 50, tie="id").select("id", "filename")


@query(f"with {JOBS}, d as (select unnest(['queued', 'running', 'done', 'failed']) as status), c as (select status, count(*) as n from j where status is not null group by status) select status, coalesce(n, 0) as n from d full join c using (status)")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.counts(jobs(spark, sf_dir, "status"), "status", STATUSES)


SECONDS = "round((epoch_us(updated_at) - epoch_us(created_at)) / 1000000.0)::bigint"


@query(f"with {JOBS} select id, {SECONDS} as seconds, case when {SECONDS} < 60 then {SECONDS} || 's' else floor({SECONDS} / 60)::bigint || 'm ' || ({SECONDS} % 60) || 's' end as elapsed from j")
def job_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = records.seconds_between(F.col("created_at"), F.col("updated_at"))
    return jobs(spark, sf_dir, "created_at", "updated_at").select("id", seconds.alias("seconds"), text.elapsed_text(seconds).alias("elapsed"))


@query(f"with {JOBS}, u as (select distinct lower(user_email) as email from j where user_email is not null) select u.email, coalesce(q.page_quota, 10)::bigint as page_quota, coalesce(q.pages_used, 0)::bigint as pages_used from u left join user_quota q on q.email = u.email")
def users_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = jobs(spark, sf_dir, "user_email").where("user_email is not null").select(F.lower("user_email").alias("email")).distinct()
    out = records.with_defaults(users, table(spark, sf_dir, "user_quota"), "email", {"page_quota": 10, "pages_used": 0})
    return out.select("email", F.col("page_quota").cast("bigint").alias("page_quota"), F.col("pages_used").cast("bigint").alias("pages_used"))


@query(f"""with {JOBS}, c as (select distinct lower(user_email) as email, (100 + length(user_email))::bigint as new_quota from j where user_email is not null)
select coalesce(q.email, c.email) as email, coalesce(c.new_quota, q.page_quota)::bigint as page_quota, (case when q.email is null then 0 else q.pages_used end)::bigint as pages_used from user_quota q full join c on c.email = q.email""")
def users_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = jobs(spark, sf_dir, "user_email").where("user_email is not null").select(F.lower("user_email").alias("email"), (100 + F.length("user_email")).alias("page_quota"), F.lit(0).alias("pages_used")).distinct()
    out = records.upserted(table(spark, sf_dir, "user_quota"), new, "email", ["page_quota"])
    return out.select("email", F.col("page_quota").cast("bigint").alias("page_quota"), F.col("pages_used").cast("bigint").alias("pages_used"))


@query(f"with {JOBS} select id, coalesce(error_message, '-') as error_message from j where id not in (select job_id from job_result)")
def jobs_without_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "job_result").select(F.col("job_id").alias("id"))
    left = records.deleted(jobs(spark, sf_dir, "error_message"), results, ["id"])
    return records.updated(left, F.col("error_message").isNull(), {"error_message": F.lit("-")})


@query(f"""with {JOBS}, s as (select id, list_filter(list_transform(string_split(coalesce(array_to_string(segments_to_refine, ', '), '') || ', other ,', ','), lambda x: trim(x)), lambda x: x <> '') as parts from j)
select id, array_to_string(parts, '|') as parts, array_to_string(list_sort(list_distinct(list_filter(parts, lambda x: x not in ('code', 'fig', 'tab', 'catalogue')))), '|') as unknown from s""")
def segment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.coalesce(F.array_join("segments_to_refine", ", "), F.lit("")), F.lit(", other ,"))
    parts, unknown = records.listed_segments(given, ["code", "fig", "tab", "catalogue"])
    return jobs(spark, sf_dir, "segments_to_refine").select("id", F.array_join(parts, "|").alias("parts"), F.array_join(unknown, "|").alias("unknown"))


LOGS = "e as (select distinct * from log_events where job_id is not null and line is not null)"
SEVERITY = """case when contains(line, '[ERROR]') or contains(line, '✗') then 'error' when contains(line, '[WARNING]') or contains(line, '[WARN]') then 'warning'
 when regexp_matches(line, '(?i)={3,}.*STEP\\s+\\d+|STEP\\s+\\d+.*={3,}') then 'step' when contains(line, '✓') then 'success' else 'plain' end"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.once(table(spark, sf_dir, "log_events").where("job_id is not null and line is not null"), ["job_id", "ts", "line", "received_at"])


@query(f"with {LOGS} select job_id, {SEVERITY} as severity, count(*) as n from e group by 1, 2")
def log_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("job_id", text.log_severity(F.col("line")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


BANNER = "(?i)={3,}\\s*STEP\\s+(\\d+):\\s*(.+?)\\s*=*\\s*$"
SHORT = "trim(regexp_replace(regexp_replace(line, '(?i)^\\[(INFO|WARNING|WARN|ERROR)\\]\\s*', ''), '(?:/[^\\s/]+)+/([\\w.\\-]+\\.(?:pdf|json|md|txt|py|log))', '\\1', 'g'))"


@query(f"""with {LOGS}, c as (select job_id, case when regexp_matches(line, '^\\s*={{5,}}\\s*$') or regexp_matches(line, '(?i)\\[(INFO|WARNING|WARN|ERROR)\\]\\s+(Running command|Output directory):') then null
 when regexp_matches(line, '{BANNER}') then 'Step ' || regexp_extract(line, '{BANNER}', 1) || ': ' || trim(regexp_extract(line, '{BANNER}', 2)) else nullif({SHORT}, '') end as shown from e)
select job_id, shown, count(*) as n from c where shown is not null group by 1, 2""")
def log_lines_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = events(spark, sf_dir).select("job_id", text.log_line(F.col("line")).alias("shown")).where("shown is not null")
    return shown.groupBy("job_id", "shown").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select job_id, coalesce(max(try_cast(nullif(regexp_extract(line, '(?i)\\bSTEP\\s+(\\d+)', 1), '') as int)), 0) as step from log_events where job_id is not null group by job_id)
select job_id, step::bigint as step, least(100.0, (step - 1) / 10 * 100.0)::double as percent from s""")
def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = logs.last_steps(table(spark, sf_dir, "log_events"))
    return steps.select("job_id", F.col("step").cast("bigint").alias("step"), text.progress(F.col("step")).cast("double").alias("percent"))


@query(f"""with {LOGS}, t as (select job_id, min(row(ts, received_at, line)) as stop from e where line in ('__DONE__', '__ERROR__', '__TIMEOUT__') group by job_id)
select e.job_id, count(*) as n_lines from e left join t on t.job_id = e.job_id where stop is null or row(ts, received_at, line) <= stop group by e.job_id""")
def log_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.until_terminal_table(table(spark, sf_dir, "log_events")).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""with {EL}, s as (select distinct doc, lower(regexp_extract(source_file, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1)) as stem from el where source_file is not null)
select match_id, count(doc) as n_records, min(doc) as first_record from (select match_id, lower(regexp_extract(pdf_name, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1)) as stem from code_match where pdf_name is not null) m left join s using (stem) group by match_id""")
def names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = lambda c: F.lower(text.stem(F.col(c)))
    files = recognition(spark, sf_dir, ["label"], ["rec_id", "source_file"]).where("source_file is not null and exists(pages, p -> exists(p.elements, e -> e is not null))").select(F.col("rec_id").alias("doc"), stem("source_file").alias("stem")).distinct()
    names = table(spark, sf_dir, "code_match").where("pdf_name is not null").select("match_id", stem("pdf_name").alias("stem"))
    by_stem = files.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_record"))  # one row for each stem, so no names meet many files
    return names.join(by_stem, "stem", "left").select("match_id", F.coalesce("n", F.lit(0)).alias("n_records"), "first_record")
