"""Queries of the flattening operator, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators import nested
from foliospark.sources.tables import recognition, table

#: Element fields each flat table needs; others are not read.
FIELDS = {"found": ["label"], "pages": ["label"], "records": ["label"], "elements": ["label", "text", "reading_order", "confidence", "figure_path", "context_text"], "boxes": ["bbox", "padded_bbox"]}


def flat(part: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = recognition(spark, sf_dir, FIELDS[part], ["rec_id", "source", "source_file"])
        return nested.flat_table(records, table(spark, sf_dir, "recognition_raw"), part)

    return query


QUERIES = {f"p6_{part}": flat(part) for part in ("found", "records", "pages", "elements", "boxes")}


def opened(v: str) -> str:
    """JSON that stands in a string."""
    return f"case when json_type({v}) = 'VARCHAR' then try_cast({v} ->> '$' as json) else {v} end"


def listed(v: str, child: bool) -> str:
    """Children of a value: a list's, an object's numbered ones, or the one object itself (pages: an object's values unless it is a page)."""
    single = f"not list_aggregate(list_transform(json_keys({v}), lambda k: regexp_full_match(k, '\\s*\\d+\\s*')), 'bool_and')" if child else f"list_contains(json_keys({v}), 'elements')"
    return f"case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then case when {single} then [{v}] else json_extract({v}, '$.*') end end"


#: Payloads: holder of the pages, pages by place, nodes with the path of places that leads to them.
RAW = f"""w as (select rec_id, any_value(source_file) as source_file, any_value(case when json_valid(payload) then payload::json end) as j from recognition_raw group by rec_id),
ho as (select rec_id, source_file, j, case when json_exists(j, '$.pages') then j when json_exists(j, '$.result.layout.pages') then j -> '$.result.layout' when json_exists(j, '$[0].pages') then j -> '$[0]' end as h from w),
ps as (select rec_id, source_file, j, h, {opened("(h -> '$.pages')")} as v from ho),
pl as (select *, coalesce({listed('v', False)}, []) as own, case when json_type(v) = 'OBJECT' and not list_contains(json_keys(v), 'elements') then json_keys(v) end as names from ps),
rp as (select rec_id, i as page_pos, coalesce(try_cast(own[i] ->> '$.page_number' as int), try_cast(names[i] as int)) as page_number, {opened("(own[i] -> '$.elements')")} as es from pl, unnest(range(1, len(own) + 1)) as t(i)),
nd as (select rec_id, page_pos, page_number, [i] as path, es[i] as e from (select rec_id, page_pos, page_number, {listed('es', True)} as es from rp), unnest(range(1, len(es) + 1)) as t(i) where json_type(es[i]) = 'OBJECT'
 union all select rec_id, page_pos, page_number, list_append(path, i), es[i] from (select rec_id, page_pos, page_number, path, {listed('v', True)} as es from (select nd.*, {opened("(e -> '$.elements')")} as v from nd)), unnest(range(1, len(es) + 1)) as t(i) where json_type(es[i]) = 'OBJECT'),
nn as (select *, row_number() over (partition by rec_id, page_pos order by path) as node_no from nd),
nk as (select nn.*, coalesce(up.node_no, 0) as parent_no, len(nn.path) as depth from nn left join nn up on up.rec_id = nn.rec_id and up.page_pos = nn.page_pos and up.path = nn.path[:-2])"""
#: Typed records in the same form.
TYPED = """r as (select rec_id, any_value(source) as source, any_value(source_file) as source_file, any_value(pages) as pages from recognition_json group by rec_id),
tp as (select rec_id, list_filter(pages, lambda p: p is not null) as ps from r), tq as (select rec_id, i as page_pos, ps[i].page_number as page_number, list_filter(ps[i].elements, lambda e: e is not null) as es from tp, unnest(range(1, len(ps) + 1)) as t(i)),
tn as (select rec_id, page_pos, page_number, i as node_no, es[i] as e from tq, unnest(range(1, len(es) + 1)) as t(i))"""


def json_text(k: str) -> str:
    return f"case json_type(e -> '$.{k}') when 'NULL' then null else e ->> '$.{k}' end as {k}"


#: Names of a box's corners.
CORNERS = [("x0", "y0", "x1", "y1"), ("x_min", "y_min", "x_max", "y_max"), ("left", "top", "right", "bottom")]


def first_four(v: str) -> str:
    """The first four numbers of a box as a list, a string of numbers or named corners."""
    named = " ".join(f"when json_exists({v}, '$.{n[0]}') then [" + ", ".join(f"try_cast({v} ->> '$.{x}' as double)" for x in n) + "]" for n in CORNERS)
    return f"""(case json_type({v}) when 'ARRAY' then list_transform(json_extract({v}, '$[*]'), lambda x: try_cast(x ->> '$' as double))
 when 'VARCHAR' then list_transform(string_split_regex(trim(replace({v} ->> '$', ',', ' ')), '\\s+'), lambda x: try_cast(x as double)) when 'OBJECT' then case {named} end end)[1:4]"""


CORNERED = " or ".join(f"json_exists(v, '$.{n[0]}')" for n in CORNERS)
TEXTS = ("label", "text", "figure_path", "context_text")
ORACLE = {
    "p6_found": f"with recursive {RAW}, {TYPED} select rec_id, page_number, node_no::int as node_no, 0::int as parent_no from tn union all select rec_id, page_number, node_no::int, parent_no::int from nk",
    "p6_records": f"""with {RAW.split("nd as (")[0].rstrip().rstrip(",")}, {TYPED} select 'typed' as origin, rec_id, source, source_file, coalesce(len(pages), 0)::int as n_pages, true as complete from r
 union all select 'payload', rec_id, null, coalesce(source_file, h ->> '$.source_file'), len(own)::int, j is not null from pl""",
    "p6_pages": f"""with recursive {RAW}, {TYPED} select 'typed' as origin, rec_id, page_pos::int as page_pos, page_number, coalesce(len(es), 0)::int as n_nodes from tq
 union all select 'payload', rec_id, page_pos::int, page_number, (select count(*) from nk where nk.rec_id = rp.rec_id and nk.page_pos = rp.page_pos)::int from rp""",
    "p6_elements": f"""with recursive {RAW}, {TYPED} select 'typed' as origin, rec_id, page_pos::int as page_pos, page_number, node_no::int as node_no, 0::int as parent_no, 1::int as depth, {', '.join(f'e.{k} as {k}' for k in TEXTS)}, e.reading_order as reading_order, e.confidence as confidence from tn
 union all by name select 'payload' as origin, rec_id, page_pos::int as page_pos, page_number, node_no::int as node_no, parent_no::int as parent_no, depth::int as depth, {', '.join(map(json_text, TEXTS))}, trunc(try_cast(e ->> '$.reading_order' as double))::int as reading_order, try_cast(e ->> '$.confidence' as double) as confidence from nk""",
    "p6_boxes": f"""with recursive {RAW}, {TYPED}, bx as (select rec_id, page_pos, page_number, node_no, k as kind, e -> ('$.' || k) as v from nk, (values ('bbox'), ('padded_bbox')) as t(k)),
 bo as (select * replace (case when json_type(v) = 'VARCHAR' and left(v ->> '$', 1) in ('[', '{{') then try_cast(v ->> '$' as json) else v end as v) from bx),
 bu as (select rec_id, page_pos, page_number, node_no, kind, v from bo where json_type(v) <> 'OBJECT' or {CORNERED} union all
  select rec_id, page_pos, page_number, node_no, kind || '_' || lower(ks[i]), vs[i] from (select *, json_keys(v) as ks, json_extract(v, '$.*') as vs from bo where json_type(v) = 'OBJECT' and not ({CORNERED})), unnest(range(1, len(ks) + 1)) as t(i)),
 bf as (select *, {first_four('v')} as f from bu),
 tb as (select rec_id, page_pos, page_number, node_no, 'bbox' as kind, e.bbox as f from tn union all select rec_id, page_pos, page_number, node_no, 'padded_bbox', e.padded_bbox from tn)
select 'typed' as origin, rec_id, page_pos::int as page_pos, page_number, node_no::int as node_no, kind, f[1] as x0, f[2] as y0, f[3] as x1, f[4] as y1 from tb where len(f) > 0
 union all select 'payload', rec_id, page_pos::int, page_number, node_no::int, kind, f[1], f[2], f[3], f[4] from bf where len(list_filter(f, lambda x: x is not null)) > 0""",
}
