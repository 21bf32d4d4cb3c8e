import json

import pandas as pd
from pyspark.sql import functions as F

from foliospark.operators import headings
from foliospark.sources import files, sinks
from foliospark.streaming import logs


def test_files(spark, tmp_path):
    (tmp_path / "a/_pipeline").mkdir(parents=True)
    (tmp_path / "a/x.PDF").write_bytes(b"%PDF-1.7 data")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    record = {"source_file": "x.pdf", "pages": [{"page_number": 1, "elements": [{"label": "para", "text": "t", "bbox": [1, 2, 3, 4]}]}]}
    (tmp_path / "a/x.json").write_text(json.dumps(record))
    (tmp_path / "a/bad.json").write_text("{")
    (tmp_path / "a/x_corrections.json").write_text("[]")
    (tmp_path / "a/_pipeline/x.json").write_text('{"T": {"S": {}}}')
    (tmp_path / "a/x.md").write_text("# T\n\ntext")
    (tmp_path / "a/x_backup.md").write_text("old")
    (tmp_path / "a/x.txt").write_text("=== Page 1 ===\nText: hello")
    base = str(tmp_path)
    assert sorted((r.doc, r.rel_dir, r.is_pdf) for r in files.pdf_files(spark, base).collect()) == [("x", "a", True), ("y", "", False)]
    assert [r.doc for r in files.pdf_files(spark, base, any_case=False).collect()] == ["y"]
    found = {r.doc: r for r in files.recognition_files(spark, base).collect()}
    assert set(found) == {"x", "bad"} and found["x"].pages[0].elements[0].text == "t" and found["bad"].bad == "{"
    assert [r.text for r in files.markdown_files(spark, base).collect()] == ["# T\n\ntext"]
    tree = files.hierarchy_files(spark, str(tmp_path / "a/_pipeline")).select(F.to_json("hierarchy").alias("h")).first().h
    assert json.loads(tree) == {"T": {"S": {}}}
    assert [(r.page_no, r.line) for r in files.raw_text_files(spark, base).collect()] == [(1, "Text: hello")]
    md, pdf = files.markdown_files(spark, base).select("doc", "text"), files.pdf_files(spark, base).select("doc", "path")
    assert files.first_match(md, pdf).count() == 1 and files.unmatched(pdf, md).count() == 1
    spans = files.pdf_spans(files.pdf_files(spark, base), lambda doc, data: [(doc, 1, 800.0, 600.0, 1, 1, [0.0, 9.0, 1.0, 2.0], 0, data[:4].decode(), 12.0, 0, "f", 0)])
    assert sorted(r.content for r in files.page_texts(spans).collect()) == ["%PDF", "noth"] and headings.span_lines(spans).count() == 2
    pages = spark.createDataFrame([("x", 1)], "doc string, page_no int")
    assert files.page_images(pages, files.pdf_files(spark, base), ["{doc}_{page}.png", "{doc}.PDF"]).first().path.endswith("x.PDF")
    assert files.single_page(pages, 1).first().doc == "x_page#1"
    outputs = spark.createDataFrame([("x", "/o/_pipeline/x.md"), ("x", "/o/a_backup.md"), ("x", "/o/b.md"), ("x", "/o/x.md"), ("z", "/o/q.md"), ("x", "/o/figures/f.PNG")], "doc string, path string")
    assert {r.doc: r.path for r in sinks.chosen_output(outputs.select("doc").distinct(), outputs, ".md").collect()} == {"x": "/o/x.md", "z": "/o/q.md"}
    assert sinks.figure_files(outputs).count() == 1


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\n\ny"), ("b", "")], "doc string, text string")
    sinks.write_texts(docs, str(tmp_path / "out"))
    assert sorted((r.doc, r.text) for r in sinks.read_texts(spark, str(tmp_path / "out")).collect()) == [("a", "x\n\ny"), ("b", "")]
    assert sinks.with_backup(docs).first().original == "x\n\ny"
    report = sinks.report_json(spark.createDataFrame([("a", 1, 0.5)], "doc string, n int, v double"), ["doc"]).first()
    assert json.loads(report.text) == {"n": 1, "v": 0.5}


def test_command(spark, tmp_path):
    """A folder refined by the command: headers out, marks in standard form, corrections from spans, and resumed for what is new."""
    from foliospark.__main__ import main, run
    from foliospark.pipeline import RefineOptions, RunConfig

    (tmp_path / "in").mkdir()
    (tmp_path / "spans").mkdir()

    def document(name):
        el = lambda label, text, order: {"label": label, "text": text, "reading_order": order}
        pages = [{"page_number": n, "elements": [el("page_header", "The Manual", 0), el("title", "# Pumps", 1), el("para", "The pump was dra1ned by the crew", 2), el("list", "• one\n• two", 3)]} for n in (1, 2)]
        (tmp_path / f"in/{name}.json").write_text(json.dumps({"source_file": f"{name}.pdf", "pages": pages}))
        rows = [{"doc": name, "page": n, "page_height": 800.0, "page_width": 600.0, "block_no": 1, "line_no": k, "line_bbox": [0.0, 200.0 + k, 1.0, 2.0], "span_no": 0, "text": t, "size": size, "flags": 0, "font": "f", "color": 0} for n in (1, 2) for k, (t, size) in enumerate([("Pumps", 20.0), ("The pump was drained by the crew", 10.0)])]
        (tmp_path / f"spans/{name}.json").write_text("\n".join(map(json.dumps, rows)))

    document("a")
    out, config = str(tmp_path / "out"), RunConfig(str(tmp_path / "in"), resume=True)
    (text,) = [r.text for r in run(spark, config, out, RefineOptions(), str(tmp_path / "spans")).collect()]
    assert text.count("The Manual") == 1 and text.count("was drained") == 2 and text.count("- one") == 2 and "page_break_1" in text and text.count("# Pumps") == 2
    document("b")
    assert sorted(r.doc for r in run(spark, config, out, RefineOptions(), str(tmp_path / "spans"), as_files=True).collect()) == ["a", "b"]
    assert "was drained" in (tmp_path / "out/b.md").read_text()
    main([str(tmp_path / "plain"), "--data-dir", str(tmp_path / "in"), "--page", "2"])
    assert {r.doc for r in sinks.read_texts(spark, str(tmp_path / "plain")).collect()} == {"a", "b"}
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc string, page_no int")
    assert [tuple(r) for r in files.lacking_page(pages, 2).collect()] == [("b", 1)]


def test_log_streams(spark, tmp_path):
    rows = [("a", 1, "Step 1/3: x"), ("a", 2, "Step 12 finished"), ("a", 3, "__DONE__"), ("a", 4, "late"), ("b", 1, "Step 2/3"), (None, 1, "x"), ("b", 2, None), ("a", 1, "Step 1/3: x")]
    df = spark.createDataFrame(rows, "job_id string, s int, line string").select("job_id", F.timestamp_seconds("s").alias("ts"), "line", F.timestamp_seconds("s").alias("received_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert {(r.job_id, r.step) for r in logs.last_steps(df).collect()} == {("a", 12), ("b", 2)}
    table = sorted((r.job_id, r.line) for r in logs.until_terminal_table(df).collect())
    assert table == [("a", "Step 1/3: x"), ("a", "Step 12 finished"), ("a", "__DONE__"), ("b", "Step 2/3")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = logs.until_terminal(logs.log_stream(spark, str(tmp_path / "in")))
    logs.publish(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted({(r.job_id, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()}) == table
    seen = []
    logs.run_batches(logs.log_stream(spark, str(tmp_path / "in")), lambda b, i: seen.append(b.count()), str(tmp_path / "ck2")).awaitTermination(120)
    assert sum(seen) == len(rows)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    steps = logs.steps_alive(logs.last_steps(df), F.timestamp_seconds(F.lit(86400 + 2)))
    assert {r.job_id for r in steps.collect()} == {"a", "b"}


class State:
    """A job's state as a stream keeps it."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.timeout = value, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_ended_jobs_stay_ended():
    """A job ends once, by its terminal line or by time; what comes later isn't shown, however late."""
    def batch(*given):
        return [pd.DataFrame({"ts": range(len(given)), "received_at": 0, "line": given})]

    def step(state, batches, timed_out=False):
        state.hasTimedOut = timed_out
        out = [x for frame in logs.follow_job(("a",), iter(batches), state, 50) for x in frame["line"]]
        state.hasTimedOut = False
        return out

    state = State()
    assert step(state, batch("x", "y")) == ["x", "y"] and state.timeout == 50
    assert step(state, batch("z", "__DONE__", "late")) == ["z", "__DONE__"] and state.timeout is None
    assert step(state, batch("later")) == [] and state.value == (True,)
    silent = State()
    assert step(silent, batch("x")) == ["x"] and step(silent, [], True) == ["__TIMEOUT__"] and step(silent, batch("late")) == [] and step(silent, [], True) == []
