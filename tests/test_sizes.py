"""Queries over tables of several files and over larger ones."""

from pyspark.sql import functions as F

from recordsmith.plans.catalogue import QUERIES
from recordsmith.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stream_of_a_table_of_many_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["t4_stream_redaction"](spark, str(tmp_path))
    want = QUERIES["t4_stream_redaction"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == docs.count() > 0


def test_stream_of_a_table_of_one_file(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    (file,) = (p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    file.rename(tmp_path / "a.parquet")
    rows = jobs.run_available(spark, jobs.read_stream(spark, str(tmp_path), "a", spark.range(1).schema), str(tmp_path / "out"))
    assert rows.agg(F.sum("id")).first()[0] == 10


def test_written_files_are_bounded(spark, tmp_path):
    rows = spark.range(1201).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["s1_scan_archives"](spark, str(tmp_path))
    assert len(got.inputFiles()) == 3
    assert got.where("same").agg(F.count_distinct("doc_id")).first()[0] == 1201


def test_undo_of_accept_all_has_records_of_every_kind(spark):
    undone = {r[0] for r in QUERIES["e5_accept_all_undo"](spark, SF).select("book_id").collect()}
    assert {4, 8, 16, 44} <= undone and not undone & {9, 10, 36, 40}


def test_only_references_leave_the_jvm(spark):
    import html

    from recordsmith.functions.html import clean_html, decode_entities

    texts = ["a &amp;lt; b&copy&notit;&nosuch; &#x1F600;&#128;&#0;&#xD800;&#1114112; &", "&&amp&amp;;&lt" + "x" * 40, "none", "", None, "&é\U0001f600&eacute;\n&#x;&#65", "&" + "\U0001f600" * 40 + ";&gt;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2)
    got = df.select("i", decode_entities(F.col("t")).alias("d"))
    assert {r["i"]: r["d"] for r in got.collect()} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    for c in (decode_entities(F.col("t")), clean_html(F.col("t"), 100)):
        plan = df.select(c)._jdf.queryExecution().optimizedPlan().toString()
        udf = plan[plan.index("ArrowEvalPython") :]
        assert "regexp_extract_all" in udf or "array_distinct" in udf
    assert df.where("i = 1").select(clean_html(F.concat(F.lit("<p>"), "t"), 100).alias("c")).first()["c"] == "<p>" + html.escape(html.unescape(texts[1])) + "</p>"


def test_an_address_is_taken_apart_once(spark):
    from recordsmith.functions.urls import valid_evidence_url

    df = spark.createDataFrame([(["https://a.example/1", "http://10.1.1.1/", "http://[2001:20::1]/", "http://[::1]/", "http://me:pw@a.example/", "nothing", None],)], "urls array<string>")
    got = df.select(F.transform("urls", lambda u: valid_evidence_url(u)).alias("v"))
    assert got.first()["v"] == [True, False, True, False, False, False, False]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parse_url") <= 3


def test_manifests_are_judged_once(spark):
    for name in ("s10_manifest_accepted", "s10_manifest_rejected"):
        assert "json" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower().replace("manifests", "")


def test_members_are_handed_on_many_at_a_time(spark):
    from recordsmith.sources import archives

    made = archives.explode_members(spark.createDataFrame([(f"/a/{i}", bytearray(b"none")) for i in range(50)], "path string, content binary").repartition(1))
    assert made.where("status = 'unreadable'").count() == 50
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_packages_unpack_their_members_once(spark):
    plan = QUERIES["s4_package_fields"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan


def test_only_package_documents_are_read_for_a_document_type(spark):
    from recordsmith.sources import archives

    rows = [("/a", "META-INF/container.xml", bytearray(b"<rootfile full-path='p.opf'/>")), ("/a", "p.opf", bytearray(b"<p/>")), ("/a", "x", bytearray(b"text"))]
    found = archives.package_documents(spark.createDataFrame(rows, "path string, name string, content binary"))
    assert [tuple(r) for r in found.collect()] == [("/a", "p.opf", "<p/>")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    own = plan[plan.index(":- ") :]
    assert "<!ENTITY" not in own[: own.index("LogicalRDD")]


def test_chunks_of_a_request_are_gathered_once(spark):
    from recordsmith.operators.enrich import combine_partials

    rows = [(1, 0, "m0", "a", "x"), (1, 1, "m1", "a", None), (1, 1, "m2", "b", "y"), (2, None, "m", "a", "z"), (2, 0, "n", "a", "w"), (3, 7, "q", "a", "v")]
    expected = spark.createDataFrame([(0, ["a"]), (1, ["b", "c"])], "chunk int, fields array<string>")
    got = combine_partials(spark.createDataFrame(rows, "request_id int, chunk int, match string, field string, value string"), expected)
    assert sorted(map(tuple, got.collect())) == [(1, "m0", {"a": None, "b": "y"}, 1), (2, "n", {"a": "w"}, 1), (3, "q", {"a": "v"}, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [request_id") == 1


def test_requests_of_one_file_are_asked_in_many_tasks(spark, tmp_path):
    import pandas as pd

    from recordsmith.operators import enrich
    from recordsmith.sources import staging

    def ask(parts):
        from pyspark import TaskContext

        for part in parts:
            yield pd.DataFrame({"request_id": part["request_id"], "body": "", "estimated_cost_usd": float(TaskContext.get().partitionId())})

    spark.range(400).selectExpr("id AS request_id", "id AS book_id", "false AS force_refresh", "concat('m', id) AS model", "id % 7 AS job_id", "'t' AS title", "'a' AS authors_text", "'i' AS isbn_raw", "'p' AS publisher").coalesce(1).write.parquet(f"{tmp_path}/requests")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written, stage = [], staging.staged
    enrich.staged = lambda df, name: written.append(name) or stage(df, name)
    try:
        out = enrich.enrich(spark.read.parquet(f"{tmp_path}/requests"), spark.createDataFrame([], enrich.CACHE), ask, ["title"])
        records = out["records"].select("request_id", "cost").collect()
    finally:
        enrich.staged = stage
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r[0] for r in records) == list(range(400)) and out["lookups"].count() == 400
    assert len({r["cost"] for r in records}) > 1 and "fields" not in written
