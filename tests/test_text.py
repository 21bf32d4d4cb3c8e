import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import search, similarity, text
from foliospark.functions.search import Lanes, PageLines, Seeds, at_most, best_run, best_window, blocks, likeness, likeness_from, run_from
from foliospark.operators import code, figures, headers, lines, ocr, tables


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_page_breaks(spark):
    cases = {"a\n---\n\n\nfoo\n--- \n": "a\n<!-- page_break_1 -->\nfoo\n<!-- page_break_2 -->", "no break": "no break", "---": "<!-- page_break_1 -->", "": "", "a --- b": "a --- b"}
    assert column(spark, [*cases, None], lines.numbered) == [*cases.values(), None]


def test_bullets(spark):
    cases = {
        "- • foo": "- foo", "  - ◦ x": "  - x", "◦b": "- b", "-•y": "- y", "- 1. a": "1. a", "- 3 items": "3. items", "12 monkeys": "12. monkeys", "- 1.5 kg": "1. 5 kg",
        "▪ x": "▪ x", "5": "5", "- plain": "- plain", "- • • x": "- • x", "• 12 x": "- 12 x", "": "",
    }
    assert column(spark, cases, text.bullet_line) == list(cases.values())
    assert column(spark, ["a\n- • b\n3 c"], lines.bullet_count) == [2]


def test_predicates(spark):
    assert column(spark, ["Intro .... 5", "Released in 2024", "See page 9 for", "table of contents", "plain text"], text.is_contents_entry) == [True, True, True, True, False]
    assert column(spark, ["A – “B”  c"], text.header_form) == ['a - "b" c']
    assert column(spark, ["infor-\n  mation\rab\rc\n\nde", None], text.text_lines) == [["information", "ab", "de"], None]
    assert column(spark, ["Page 3", "2024-01-01 x", "Copyright © x", "AB 2022", "a@b.de", "...", "1.2", "ok", "A heading", "x" * 151, "!!!!a"], text.is_heading_text) == [False] * 8 + [True, False, False]
    assert column(spark, ["in/a.b.PDF", "x", "d\\e.md", None], text.stem) == ["a.b", "x", "e", None]
    assert column(spark, ["=====", "[INFO] Running command: x", "=== STEP 3: Read all ===", "[ERROR] see /a/b/c.pdf now", "", None], text.log_line) == [None, None, "Step 3: Read all", "see c.pdf now", None, None]
    assert column(spark, ["[ERROR] x", "x [WARN]", "=== step 1", "✓ ok", "x"], text.log_severity) == ["error", "warning", "step", "success", "plain"]
    assert column(spark, ["![a](figures/x.png) ![](y.png)"], lambda c: text.figure_links(c, F.lit("https://h/$1"))) == ["![a](https://h/$1/figures/x.png) ![](y.png)"]
    assert column(spark, ["59", "60", "3661"], lambda c: text.elapsed_text(c.cast("int"))) == ["59s", "1m 0s", "61m 1s"]


SAMPLES = ["", "  ", "def f(x):\n  return x.y", "git commit -m x --all", "port = 80\n[server]", "# c", "Just some words here", "a=b", "ﬁne – “x” × 3…", "rn ii cl vni", None, "x" * 600 + "{", "SELECT a FROM b;"]


def test_code_forms(spark):
    cases = {"  A–b…\n x = {1} ": "a-b... x = {1}", "ﬁle ÷ 2°": "file / 2deg", "a\u3000b ¶ c": "a b c", "": "", "\t": ""}
    assert column(spark, [*cases, None], text.code_form) == [*cases.values(), None]
    assert column(spark, ["Corn: x_1;", "clarity", "a.b-c"], lambda c: text.code_form(c, True)) == ["com x_1", "danty", "a b-c"]
    kinds = {"def f(x): return {1}": "code", "git commit -m x --all": "command", "[a]\nport = 80": "config", "The pump was drained": "natural_language", "a.b": "mixed", "x": "mixed", None: "mixed"}
    assert column(spark, kinds, text.content_type) == list(kinds.values())


def test_similarity(spark):
    there = [s for s in SAMPLES if s is not None]
    pairs = [(a, b) for a in there for b in there[:8]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    hard = text.content_type(F.col("a")).isin("code", "command", "config")
    forms = [F.when(hard, text.code_form(F.col(c), True)).otherwise(text.code_form(F.col(c))).alias(f"f{c}") for c in "ab"]
    rows = similarity.with_similarity(df, F.col("a"), F.col("b"), "s").join(df.select("i", *forms, (text.content_type(F.col("a")) == "natural_language").alias("natural")), "i").orderBy("i").collect()
    assert [r.s for r in rows] == pytest.approx([likeness(r.fa, r.fb, r.natural) for r in rows])
    assert all(at_most(r.fa, r.fb, r.natural) >= r.s - 1e-12 for r in rows)


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("the qu1ck brown fox", "the quick brown fox"), (None, "x")], "a string, b string")
    assert [r.x and round(r.x, 4) for r in df.select(similarity.sm_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [0.25, 0.5, 0.9474, None]


def test_bounded_search_finds_the_first_best():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc=()", k=4))
    for _ in range(25):
        rows = [" ".join(word() for _ in range(rng.randint(0, 4))) for _ in range(12)]
        wanted = [" ".join(word() for _ in range(3)) for _ in range(3)]
        whole, natural, marked = " ".join(wanted), rng.random() < 0.5, [rng.random() < 0.2 for _ in rows]
        runs = [(i, n) for n in (3, 5, 2) for i in range(len(rows) - n + 1) if any(rows[i : i + n])]
        score = lambda r: likeness(whole, " ".join(filter(None, rows[r[0] : r[0] + r[1]])), natural) * (1.1 if r[1] == 3 else 1.0) * (1.05 if any(marked[r[0] : r[0] + r[1]]) else 1.0)  # noqa: B023, E731
        best = max(runs, key=score)
        assert best_window(3, whole, natural, rows, [not x for x in rows], marked) == (*best, pytest.approx(score(best)))
        page = [{"form": x, "hard": rng.random() < 0.5, "natural": rng.random() < 0.5} for x in rows]
        asked = [{"plain": x, "hard": x.replace("a", "b")} for x in wanted]
        mean = lambda i: sum(likeness(p["form"], w["hard" if p["hard"] else "plain"], p["natural"]) for p, w in zip(page[i:], asked)) / 3  # noqa: B023, E731
        at = max(range(10), key=mean)
        assert best_run(asked, page) == (at, pytest.approx(mean(at)))
    assert likeness("", "x", True) == at_most("x", "", False) == 0.0 and best_run([{"plain": "a", "hard": "a"}], [{}, {}]) is None and best_window(1, "x", False, [""], [True], [False]) is None


def test_search_from_a_bar_equals_the_matcher():
    rng = random.Random(5)
    for signs, most in (("ab", 40), ("abc=(", 300), ("abcdefghijklmnopqrstuvwxyz0123456789 ()_", 600)) * 12:
        shared = "".join(rng.choices(signs, k=30))
        a, b = ["".join(rng.choices(signs, k=rng.randint(0, most))) + shared + "".join(rng.choices(signs, k=rng.randint(0, most))) for _ in "ab"]
        matcher = difflib.SequenceMatcher(None, a, b)
        size = sum(m.size for m in matcher.get_matching_blocks())
        assert blocks(a, Seeds(b)) == blocks(a, Seeds(b), size) == size and blocks(a, Seeds(b), size + 1) in (-1, size)
        assert size <= Lanes(["x", a, "", b]).common(b)[1] and Lanes(["x", a, "", b]).common(b)[2:] == [0, len(b)]
        for natural in (False, True):
            value = likeness(a, b, natural)
            assert likeness_from(Lanes([a]), Seeds(b), natural, value) == value and likeness_from(Lanes([a]), Seeds(b), natural, value + 1e-9) is None
    assert likeness_from(Lanes([""]), Seeds("x"), False, 0.1) is None and likeness_from(Lanes(["b a"]), Seeds("a b"), True, 0.6) == 0.8


def test_unlike_lines_cost_no_matcher(monkeypatch):
    used = []
    monkeypatch.setattr(search, "SequenceMatcher", lambda *a: used.append(a) or difflib.SequenceMatcher(*a))
    unlike = [chr(97 + i % 3) * 5 + " zzzz yyyy " * (i % 2) for i in range(30)]
    page = PageLines([*unlike, "def f(x):", "return x"], [i % 2 == 0 for i in range(32)], [False] * 32)
    assert run_from(["def f(x):", "return x"], ["def f(x):", "return x"], page, 0.4) == (30, 1.0) and not used
    assert run_from(["qqq www", "uuu ooo"], ["qqq www", "uuu ooo"], page, 0.4) is None and not used
    assert likeness_from(Lanes(["abc " * 40]), Seeds("qwe " * 40), False, 0.4) is None and not used


def test_content_type_finds_each_mark_once(spark):
    cases = ["print(x)", "strong interest", "a.b = c", "x\n[a]", "  [a] b", "#x", "a --b", "{x: 1}", "run -v", "  git push --all", "from a import b", "class Abc", "const x = [1]", "def f (", "a:  7", "ls", "Every pump. Then", "é.é = é", "x"]
    marks = [text.CODE_MARKS, text.COMMAND_MARKS, text.CONFIG_MARKS]
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select("x", text.content_type(F.col("x")).alias("kind"), *[F.array(*[F.lower("x").rlike("(?U)" + m).cast("int") for m in ms]).alias(f"m{k}") for k, ms in enumerate(marks)]).collect()
    for r in rows:
        n = [sum(r[f"m{k}"]) for k in range(3)]
        assert r.kind == ("mixed" if len(r.x.strip()) < 3 else ("code", "command", "config")[n.index(max(n))] if max(n) >= 2 else "mixed" if max(n) else "natural_language"), r
    plan = spark.range(1).select(F.transform(F.array(F.lit("x")), text.content_type).alias("kind"))._jdf.queryExecution().analyzed().toString()
    assert all(plan.count(f"(?U){m})") + plan.count(f"(?U){m},") <= 1 for ms in marks for m in ms)


def test_code_search(spark):
    pages = spark.createDataFrame([(1, 1, "The page begins\n\n  def f(x):\n    return x + 1\n\nThe page ends"), (1, 2, "Nothing like it"), (2, 1, None)], "doc int, page_no int, content string")
    pieces = [(1, 1, 1, "def f(x):\nreturn x+1"), (1, 1, 2, None), (1, 2, 1, "a = [1, 2, 3]\nb = 5"), (2, 1, 1, "x = 1"), (3, 1, 1, "y = 2")]
    best = code.best_windows(spark.createDataFrame(pieces, "doc int, page_no int, elem_no int, code string"), pages)
    got = {(r.doc, r.page_no, r.elem_no): (r.segment, r.score is not None) for r in best.collect()}
    assert got == {(1, 1, 1): ("def f(x):\n    return x + 1", True), (1, 1, 2): (None, False), (1, 2, 1): ("a = [1, 2, 3]\nb = 5", False), (2, 1, 1): ("x = 1", False), (3, 1, 1): ("y = 2", False)}
    asked = spark.createDataFrame([(1, 7, "def f(x):\nreturn x+1", "The page begins", None)], "doc int, elem_no int, code string, context string, bbox array<double>")
    found = code.page_matches(asked, pages).collect()
    assert {(r.strategy, r.page_no) for r in found} >= {("lines", 1)} and [r.pdf_text for r in found if r.strategy == "lines" and r.page_no == 1] == ["def f(x):\nreturn x + 1"]
    assert code.best_windows(spark.createDataFrame([], "doc int, page_no int, elem_no int, code string"), pages).count() == 0


def test_code_format(spark):
    cases = {
        "{'a': 1,}": '```json\n{\n  "a": 1\n}\n```',
        "def f(x):\nif x:\nreturn 1\nelse:\npass\ny = 2": "```python\ndef f(x):\n    if x:\n        return 1\n    else:\n        pass\n    y = 2\n```",
        "for a in b:\n  c\n    d\n\n\n\n\ne": "```python\nfor a in b:\n    c\n        d\n\n\ne\n```",
        "configure terminal\ninterface x\nshutdown\nexit\nend": "```\nconfigure terminal\n  interface x\n    shutdown\n  exit\nend\n```",
        "GET /x HTTP": "```http\nGET /x HTTP\n```", "a :b\n\nc": "```\na: b\n\nc\n```", "plain": "```\nplain\n```", "": "```\n\n```", None: "```\n\n```", "sw# show x": "```\nsw# show x\n```",
    }
    assert column(spark, cases, code.format_code) == list(cases.values())


def test_header_removal(spark):
    without = lambda page, t: spark.createDataFrame([(page, t)], "p string, t string").select(headers.without(F.col("p"), F.col("t"))).first()[0]
    page = "Intro\n# Intro\nkept\nA long\n\nheader text\nend\n\n\n\nlast"
    assert without(page, "intro") == "# Intro\nkept\nA long\n\nheader text\nend\n\nlast"
    assert without(page, "A long header  text") == "Intro\n# Intro\nkept\nend\n\nlast"
    assert without(page, "A long header") == re.sub("\n\n\n+", "\n\n", page) and without("", "x") == "" and without("x", " ") == "x"
    assert without("a\n# Intro\nb\n#\nintro\nc", "# intro") == "a\n# Intro\nb\nc"
    assert without("keep\n  The ‘new’ — \\E(x).* \nRULE\nthe 'new' - \\E(x).* rules", "the 'NEW' – \\E(x).* rule") == "keep\nthe 'new' - \\E(x).* rules"
    assert without("x\nx\ny\nx", "X") == "y"


def brute_removal(content, text):
    """By definition: from each line on, the shortest run of lines whose joined form is the text's is dropped."""
    plain = lambda t: " ".join(t.translate(str.maketrans("–—‘’“”", "--''\"\"")).split()).lower()
    target, lines, kept, i = plain(text), content.split("\n"), [], 0
    while i < len(lines):
        ends = [j for j in range(i + 1, len(lines) + 1) if plain(lines[i]) and plain("\n".join(lines[i:j])) == target]
        heading = re.match(r"\s*#+\s", lines[i]) and target in plain(lines[i])
        if ends and not heading:
            i = ends[0]
        else:
            kept.append(lines[i])
            i += 1
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(kept)).strip() if target and content else content


def test_header_removal_against_brute_force(spark):
    rng = random.Random(6)
    rows = [("\n".join(rng.choice(["A b", "a  B c", "c", "b", "", " ", "# a b", "A", "a b c", "“b” - c"]) for _ in range(rng.randint(1, 9))), rng.choice(["a b c", "A b", "b", "# a b", "\"b\" – c", " ", "a b c c"])) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string").orderBy("i").select(headers.without(F.col("p"), F.col("t"))).collect()]
    assert got == [brute_removal(*r) for r in rows]


def test_header_rules(spark):
    rows = [(1, p, i, label, t) for p in (1, 2) for i, (label, t) in enumerate([("page_header", " H "), ("foot", "F"), ("watermark", "W"), ("para", "H"), ("header", ""), (None, "x"), ("header", None)])]
    texts = headers.furniture(spark.createDataFrame(rows, "doc int, page_number int, elem_no int, label string, text string"))
    pages = spark.createDataFrame([(1, 1, "H\nF\nW\na\n"), (1, 2, "\nH\nF\nW\nb"), (2, 1, "H")], "doc int, page_no int, content string")
    got = {(r.doc, r.page_no): (r.content, r.removals) for r in headers.removed(pages, texts).collect()}
    assert got == {(1, 1): ("H\na\n\n", 2), (1, 2): ("\n\nb", 3), (2, 1): ("H", 0)}


def test_ocr(spark):
    rec = spark.createDataFrame([(1, 1, 1, 0, "the qu1ck fox"), (1, 1, 1, 1, "same line"), (1, 1, 2, 0, "nothing alike here"), (1, 2, 1, 0, "other page")], "doc int, page_no int, elem_no int, part int, text string")
    acc = spark.createDataFrame([(1, 1, 1, "the quick fox"), (1, 1, 2, "the quick fox"), (1, 1, 3, "same line"), (1, 1, 4, "xy")], "doc int, page_no int, line_no int, line string")
    best = ocr.best_lines(rec, acc)
    assert sorted((r.text, r.line_no, round(r.similarity, 2)) for r in best.collect()) == [("same line", 3, 1.0), ("the qu1ck fox", 1, 0.92)]
    pages = spark.createDataFrame([(1, 1, "a the qu1ck fox, the qu1ck fox"), (2, 1, "z")], "doc int, page_no int, content string")
    assert sorted(r.content for r in ocr.corrected_pages(pages, ocr.corrections(best)).collect()) == ["a the quick fox, the qu1ck fox", "z"]


def test_tables(spark):
    html = "<table><tr><th>a</th><th>b | c</th></tr><tr><td colspan=2>x<br>y</td></tr><tr><td>1</td></tr></table>"
    assert tables.table_markdown(html) == "| a | b \\| c |\n| --- | --- |\n| x y |  |\n| 1 |  |"
    assert tables.table_markdown("<p>x</p>") == "x" and tables.table_markdown("<table></table>") == ""
    docs = spark.createDataFrame([(1, f"{html}\nand {html} one\ntwo one two"), (2, "z")], "doc int, text string")
    els = spark.createDataFrame([(1, 1, 1, "tab", html), (1, 1, 2, "catalogue", "one\ntwo"), (1, 1, 3, "catalogue", None)], "doc int, page_number int, elem_no int, label string, text string")
    out = {r.doc: r.text for r in tables.catalogues_removed(tables.tables_refined(docs, els), els).collect()}
    assert out == {1: f"{tables.table_markdown(html)}\nand {tables.table_markdown(html)}  one two", 2: "z"}


def test_code_blocks(spark):
    docs = spark.createDataFrame([(1, "t\n```\nalpha beta gamma\n```\n```\nalpha beta gamma\n```"), (2, "no blocks")], "doc int, text string")
    changes = spark.createDataFrame([(1, 1, "```\nalpha beta gamma\n```", "```\nNEW\n```"), (1, 2, "Alpha beta gamna", "```\nTWO\n```"), (2, 1, "x", "y")], "doc int, place int, old string, new string")
    assert {r.doc: (r.text, r.n_replaced) for r in code.blocks_replaced(docs, changes).collect()} == {1: ("t\n```\nNEW\n```\n```\nTWO\n```", 2), 2: ("no blocks", 0)}


def test_figures(spark):
    rows = [(1, 1, 1, "title", "T title", 0), (1, 1, 2, "para", "before it", 1), (1, 1, 3, "sec", "Section", 2), (1, 1, 4, "fig", "![Figure](figures/a.PNG)", 3), (1, 1, 5, "para", "after", 4), (1, 1, 6, "sub_sec", "Next", 5), (1, 1, 7, "para", "far", 6), (1, 2, 1, "fig", None, None)]
    els = spark.createDataFrame(rows, "doc int, page_number int, elem_no int, label string, text string, reading_order int")
    got = {(r.page_number, r.elem_no): (r.section_start, r.section_end, r.context) for r in figures.figure_contexts(els).collect()}
    assert got == {(1, 4): (2, 5, "Section\n\nafter"), (2, 1): (0, 1, "")}
    assert figures.figure_contexts(els, 7).where("page_number = 1").first().context == "Section..."
    infos = figures.figure_infos(els.withColumn("figure_path", F.lit(None).cast("string"))).collect()
    assert sorted((r.path, r.is_image) for r in infos) == [("", False), ("figures/a.PNG", True)]
    box = spark.createDataFrame([(-1.5, 0.0, 2047.9, 10.0, 3000, 100), (5.0, 5.0, 5.0, 9.0, 10, 10)], "x0 double, y0 double, x1 double, y1 double, width int, height int")
    crops = figures.crop_boxes(box, 3).collect()
    assert crops[0].crop == [0, 0, 2050, 13] and (crops[0].out_width, crops[0].out_height) == (1024, 6)
