import json
import random

from pyspark.sql import functions as F

from foliospark.operators import evaluate, headings, lines, records
from foliospark.pipeline import RefineOptions, refine


def stack(rows):
    """Depth, parent and path by a stack of open headings."""
    out, open_ = [], []
    for pos, level, title in rows:
        while open_ and open_[-1][1] >= level:
            open_.pop()
        out.append((pos, len(open_) + 1, open_[-1][0] if open_ else None, [o[2] for o in open_] + [title]))
        open_.append((pos, level, title))
    return out


def nested_dict(rows):
    root = {}
    open_ = [(0, root)]
    for _, level, title in rows:
        while open_[-1][0] >= level:
            open_.pop()
        open_[-1][1][title] = {}
        open_.append((level, open_[-1][1][title]))
    return root


def test_nesting_against_a_stack(spark):
    rng = random.Random(4)
    docs = {d: [(i + 1, rng.randint(1, 6), f"t{i}") for i in range(rng.randint(0, 12))] for d in range(40)}
    docs[99] = [(1, 1, "a"), (2, 3, "b"), (3, 3, "c"), (4, 2, "d")]
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc int, pos int, level int, title string")
    got = {(r.doc, r.pos): (r.depth, r.parent_pos, r.path) for r in headings.nested(df).collect()}
    assert got == {(d, p): (depth, parent, path) for d, rows in docs.items() for p, depth, parent, path in stack(rows)}
    assert [got[99, p][0] for p in (1, 2, 3, 4)] == [1, 2, 2, 2]
    trees = {r.doc: json.loads(r.hierarchy) for r in headings.hierarchy_json(headings.nested(df)).collect()}
    assert trees == {d: nested_dict(rows) for d, rows in docs.items() if rows}


def test_markdown_headings(spark):
    text = "# A\n## B {#id}\n####### C\n#NoSpace\n  ### D  \nplain"
    rows = headings.markdown_headings(lines.lines_of(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), "d", "t")).collect()
    assert sorted((r.pos, r.level, r.title) for r in rows) == [(1, 1, "A"), (2, 2, "B"), (5, 3, "D")]
    levels = spark.createDataFrame([(1, "A", 2), (1, "D", 7)], "doc int, title string, level int")
    new = lines.joined_lines(headings.relevelled(lines.lines_of(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t"), levels)).first().text
    assert new == "## A\n## B {#id}\n####### C\n#NoSpace\n####### D\nplain"


def test_threshold_and_levels(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", s, b, False, False) for i, (s, b) in enumerate([(1.0, False), (2.0, False), (3.0, True), (4.0, False)])], "doc int, pos int, text string, size double, is_bold boolean, is_header boolean, is_footer boolean")
    assert headings.size_threshold(df).first().threshold == 4.0
    assert [(r.text, r.level) for r in headings.levelled(df).collect()] == [("t3", 1)]
    assert sorted((r.text, r.level) for r in headings.levelled(df, min_size=1.0).collect()) == [("t3", 1)]
    spans = spark.createDataFrame([(1, 1, 100.0, 1, 1, [0.0, 5.0, 1.0, 6.0], n, t, 12.345, 16 * n, "f", 0) for n, t in ((0, " "), (1, " Big "), (2, "title"))], "doc int, page int, page_height double, block_no int, line_no int, line_bbox array<double>, span_no int, text string, size double, flags int, font string, color int")
    line = headings.candidates(headings.span_lines(spans)).first()
    assert (line.text, line.size, line.is_bold, line.is_header, line.is_footer) == ("Big title", 12.35, True, True, False) or line.size == 12.34


def test_accuracy(spark):
    side = lambda names: spark.createDataFrame([(1, n, 0) for n in names], "doc int, path string, level int")
    r = evaluate.set_accuracy(side("ABC"), side("BCD"), ["doc"], "path").first()
    assert (r.precision, r.recall, r.f1_score, r.true_positives, r.false_positives, r.false_negatives) == (0.6667, 0.6667, 0.6667, 2, 1, 1)
    pairs = spark.createDataFrame([(1, "a b c d", "a x c"), (2, None, "x"), (3, "", None)], "id int, truth string, found string")
    diff = [(r.difference_number, r.kind, r.text_a, r.text_b, r.before_a, r.after_a) for r in evaluate.word_diff(pairs.where("id = 1"), ["id"]).collect()]
    assert diff == [(1, "replace", "b", "x", "a", "c d"), (2, "delete", "d", "", "a b c", "")]
    assert {r.id: r.words for r in evaluate.text_accuracy(pairs).collect()} == {1: 50.0, 2: 0.0, 3: 0.0}


def test_lines(spark):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(["", "", "", "a", " ", "", "", "b"])], "doc int, line_no int, line string")
    assert [r.line_no for r in sorted(lines.blank_runs_limited(df).collect(), key=lambda r: r.line_no)] == [1, 2, 4, 5, 6, 8]
    raw = "x\n=== Page 2 ===\nold\n=== Page 1 ===\nText: a\n=== Page 2 ===\nnew\n---"
    got = lines.text_protocol(lines.lines_of(spark.createDataFrame([(1, raw)], "d int, t string"), "d", "t")).withColumn("t", lines.protocol_text(F.col("line")))
    assert sorted((r.page_no, r.line, r.t) for r in got.collect()) == [(1, "Text: a", "a"), (2, "---", None), (2, "new", "new")]


def test_records(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, v int, w int")
    new = spark.createDataFrame([("b", 9, 9), ("c", 7, 0)], "k string, v int, w int")
    assert sorted(map(tuple, records.upserted(rows, new, "k", ["v"]).collect())) == [("a", 1, 2), ("b", 9, 4), ("c", 7, 0)]
    assert sorted(map(tuple, records.with_defaults(new.select("k"), rows, "k", {"v": 0}).collect())) == [("b", 3), ("c", 0)]
    assert {tuple(r) for r in records.counts(rows, "k", ["a", "z"]).collect()} == {("a", 1), ("b", 1), ("z", 0)}
    assert records.migrated(rows, {"v": ("bigint", 0), "n": ("string", "x")}).first().n == "x"
    assert records.added(rows, new.drop("w")).count() == 4 and records.deleted(rows, new, ["k"]).count() == 1


def test_refine(spark):
    rows = [(1, p, e, label, t, e) for p, els in ((1, [("title", "# Title"), ("header", "Head"), ("list", "• one"), ("tab", "<table><tr><td>x</td></tr></table>")]), (2, [("header", "Head"), ("para", "Bodi text is here"), ("catalogue", "A .... 1"), ("foot", "2")])) for e, (label, t) in enumerate(els)]
    els = spark.createDataFrame(rows, "doc int, page_number int, elem_no int, label string, text string, reading_order int")
    accurate = spark.createDataFrame([(1, 2, 1, "Body text is here")], "doc int, page_no int, line_no int, line string")
    levels = spark.createDataFrame([(1, "Title", 2)], "doc int, title string, level int")
    out = refine(els, accurate=accurate, hierarchy=levels).first()
    assert out.text == "## Title\n\nHead\n\n- one\n\n| x |\n| --- |\n\n<!-- page_break_1 -->\n\nBody text is here" and "---" in out.original
    assert refine(els, options=RefineOptions(page=2, start_from=10)).first().text.startswith("Head\n\nBodi")


def test_long_protocol_text(spark):
    got = spark.range(1).select(lines.protocol_text(F.concat(F.lit("Text: "), F.expr("repeat('ab', 600000)"), F.lit(" Text: c"))).alias("t")).first().t
    assert got == "ab" * 600_000 + " Text: c"
