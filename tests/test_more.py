import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import sql, text
from foliospark.operators import evaluate, records
from foliospark.pipeline import RunConfig, pending
from foliospark.plans import registry
from foliospark.runtime import BROADCAST_BYTES, TABLES, materialize, measured_join, release, size_of
from foliospark.sources import sinks


def test_rounded(spark):
    rng = random.Random(3)
    values = [12.25, 12.35, 80.875, 0.5, 0.125, 2.675, 1.005, 1999.995, 0.0, *(rng.uniform(0, 2000) for _ in range(300)), *(round(rng.uniform(1, 99), 2) for _ in range(300)), *(rng.randrange(64000) / 32 for _ in range(300))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = df.select(text.rounded(F.col("v"), 1).alias("a"), text.rounded(F.col("v"), 2).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(round(v, 1), round(v, 2)) for v in values]
    assert spark.createDataFrame([(None,)], "v double").select(text.rounded(F.col("v"), 1)).first()[0] is None


def test_names(spark):
    df = spark.createDataFrame([("a/b c&d.pdf", "x/y.json", b"\x00\xff" * 60), (None, "x/y.json", None), ("", None, b"")], "f string, p string, c binary")
    rows = df.select(text.url_part(F.col("f")).alias("u"), text.document_name(F.col("f"), F.col("p")).alias("n"), text.data_url(F.col("c"), F.lit("image/png")).alias("d")).collect()
    assert [(r.u, r.n) for r in rows] == [("a%2Fb%20c%26d.pdf", "b c&d"), (None, "y"), ("", None)]
    assert rows[0].d.startswith("data:image/png;base64,AP8A") and "\n" not in rows[0].d and rows[1].d is None


def test_listed_and_outcomes(spark):
    df = spark.createDataFrame([("a", f"p{i:02d}") for i in range(30)] + [("b", "x"), ("b", "x"), ("b", None)], "k string, item string")
    got = {r.k: (r.n, r["items"]) for r in evaluate.listed(df, ["k"], "item", 3).collect()}
    assert got == {"a": (30, ["p00", "p01", "p02"]), "b": (2, ["x"])}
    runs = spark.createDataFrame([("a", False, 3), ("a", None, 0), ("a", True, 9), ("b", True, None)], "k string, bad boolean, n int")
    assert {tuple(r) for r in evaluate.outcomes(runs, ["k"], F.col("bad"), F.col("n")).collect()} == {("a", 3, 1, 1, 1, 3, 66.6667), ("b", 1, 0, 0, 1, 0, 0.0)}
    assert evaluate.outcomes(runs.limit(0), ["k"], F.col("bad"), F.col("n")).count() == 0


def test_rows(spark):
    df = records.stamped(records.keyed(spark.range(50).withColumnRenamed("id", "n")), "updated_at")
    rows = df.collect()
    assert len({r.id for r in rows}) == 50 and all(len(r.id) == 36 for r in rows) and dict(df.dtypes)["updated_at"] == "timestamp_ntz" and len({r.updated_at for r in rows}) == 1


def test_run_config(spark):
    with pytest.raises(ValueError):
        RunConfig.resolved(None, {})
    config = RunConfig.resolved(None, {"DATA_DIR": "/d/"}, start_from=2, resume=True)
    assert config.data_dir == "/d" and [config.runs(n, True) for n in (1, 2, 3, 5)] == [False, False, False, True] and config.runs(3) and RunConfig.resolved("/x").runs(1, True)
    docs = spark.createDataFrame([("a",), ("b",), (None,)], "doc string")
    assert [r.doc for r in pending(docs, docs.where("doc = 'a'")).orderBy("doc").collect()] == [None, "b"]


def test_texts_by_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"text {i}\n\nline") for i in range(200)] + [("empty", ""), ("null", None)], "doc string, text string")
    sinks.write_texts(docs, str(tmp_path / "t"), buckets=8)
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("bucket=")]) == 8
    back = {r.doc: r.text for r in sinks.read_texts(spark, str(tmp_path / "t"), buckets=8).collect()}
    assert back == {r.doc: r.text for r in docs.collect()}
    assert {r.doc for r in sinks.read_texts(spark, str(tmp_path / "t"), ["d3", "d150", "none"], 8).collect()} == {"d3", "d150"}
    sinks.write_texts(docs.limit(1), str(tmp_path / "t"), mode="ignore", buckets=8)
    assert sinks.read_texts(spark, str(tmp_path / "t"), buckets=8).count() == 202
    (tmp_path / "md").mkdir()
    paths = sinks.export_texts(docs.where("doc in ('d1', 'null')"), str(tmp_path / "md")).collect()
    assert {r.doc for r in paths} == {"d1", "null"} and (tmp_path / "md/d1.md").read_text() == "text 1\n\nline" and (tmp_path / "md/null.md").read_text() == ""


def test_registered(spark):
    assert len(sql.register(spark)) == 6
    row = spark.sql("select sm_ratio('tide', 'diet') a, matched_share('abcd', 'abxx') b, html_table_to_md('<table><tr><td>x</td></tr></table>') c, format_code_as('config', 'interface x\nshutdown', '') d, word_diff(array('a', 'b'), array('a', 'c')) e, round_as_read(12.25D, 1) f, sm_ratio(null, 'x') g").first()
    assert (row.a, row.b, row.f, row.g) == (0.25, 50.0, 12.2, None) and "| x |" in row.c and row.d == "```\ninterface x\n  shutdown\n```" and (row.e[0].kind, row.e[0].text_b) == ("replace", "c")


def test_tables_are_released(spark):
    kept = materialize(spark.range(10).withColumn("t", F.lit("x")))
    assert kept.count() == 10 and TABLES
    wide = materialize(spark.range(3000).withColumn("t", F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(64)])))
    assert size_of(wide) > BROADCAST_BYTES > size_of(kept)
    joins = ["BroadcastHashJoin" in measured_join(spark.range(10), side, ["id"])._jdf.queryExecution().toString() for side in (wide, kept)]
    assert joins == [False, True]
    release(spark)
    assert not TABLES


def test_registry():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 70
