"""Golden values of single operators on literal rows."""

import hashlib
import hmac

from pyspark.sql import functions as F

from recordsmith.functions import html, text, urls
from recordsmith.operators import catalog, contracts, metrics, pricing, review, text_jobs
from recordsmith.sources import archives


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (None,)], "v double")
    assert metrics.percentile_linear(df, "v", 90).first()["value"] == 28.0
    assert metrics.percentile_linear(df.limit(0), "v", 90).first()["value"] is None


def test_cost(spark):
    usage = spark.createDataFrame([("openai", "gpt-5.6-luna-2026-08-01", 1200, 800, 500, 1), ("openai", "gpt-5.6-x", 1, 1, 1, 0), ("openai", "gpt-5.6", 1200, 800, 500, 1)], "provider string, model string, input_tokens int, cached_tokens int, output_tokens int, hosted_calls int")
    prices = spark.createDataFrame([("openai", "gpt-5.6", 4.0, 0.4, 20.0), ("openai", "gpt-5.6-luna", 0.2, 0.02, 1.2)], "provider string, base string, rate_in double, rate_cached double, rate_out double")
    got = {r["model"]: r["estimated_cost_usd"] for r in pricing.estimate_cost(pricing.price_usage(usage, prices)).collect()}
    assert abs(got["gpt-5.6-luna-2026-08-01"] - 0.010696) < 1e-9
    assert got["gpt-5.6-x"] is None
    assert abs(got["gpt-5.6"] - 0.02192) < 1e-9


def test_unknown_cost_makes_total_unknown(spark):
    df = spark.createDataFrame([("applied", False, 1.0, 10, 0.5), ("failed", False, None, 5, None), (None, None, 3.0, 1, 0.1)], "outcome string, cache_hit boolean, retrieval_seconds double, total_tokens int, estimated_cost_usd double")
    r = metrics.summarize(df).first()
    assert (r["records"], r["successful"], r["failed"], r["live"]) == (3, 2, 1, 3)
    assert r["estimated_cost_usd"] is None and r["known_cost_records"] == 2 and r["total_tokens"] == 16


def test_isbn_and_dates(spark):
    assert one(spark, text.valid_isbn(F.lit("9780306406157"))) and one(spark, text.valid_isbn(F.lit("080442957X")))
    assert not one(spark, text.valid_isbn(F.lit("9780306406158"))) and not one(spark, text.valid_isbn(F.lit("X804429570")))
    for good in ("2024", "2024-02", "2024-02-29", None):
        assert one(spark, text.valid_partial_date(F.lit(good).cast("string")))
    for bad in ("2023-02-29", "2024-13", "24", "0000"):
        assert not one(spark, text.valid_partial_date(F.lit(bad)))


def test_anonymize_is_hmac(spark):
    assert one(spark, text.anonymize(F.lit("Ada"), b"salt")) == hmac.new(b"salt", b"Ada", hashlib.sha256).hexdigest()[:16]


def test_html_cleaner(spark):
    cases = {
        "<p onclick=x>Hi <script>bad('<p>')</script><b>you</b>": "<p>Hi you</p>",
        "<ul><li>abcdefgh": "<ul><li>abcdef</li></ul>",
        "abc<br><p>defghi</p>j": "abc<br><p>def</p>",  # tags stay after the text is used up
        '<img src="https://bad/pixel"><iframe>bad</iframe><p onclick=bad()>S <strong class=x>b</strong></p><a href="j">l</a><svg>bad</svg>': "<p>S <strong>b</strong></p>l",
        "<em>a</strong>b</em>": "<em>ab</em>",
        "<p><em>a</p>b": "<p><em>a</em></p>b",
        "&lt;p&gt;<br/>": "&lt;p&gt;<br>",
        "&lt;p&gt;": "&lt;p&gt;",
        "<form><form>x</form>y</form>z <!-- <p> --> ": "z",
        "a < b": "a &lt; b",
        "<P>&eacute;&#x27;</P>": "<p>é&#x27;</p>",
        "<script>": "",
        "": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", html.clean_html(F.col("t"), 6).alias("x")).collect()}
    for i, (raw, want) in enumerate(cases.items()):
        if raw != "&lt;p&gt;":
            assert got[i] == want, raw
    described = df.union(spark.createDataFrame([(99, None)], "i int, t string")).select("i", html.clean_descriptions(F.col("t"), 100).alias("x"))
    got = {r["i"]: r["x"] for r in described.collect()}
    assert got[99] == "" and got[list(cases).index("")] == "" and got[list(cases).index("&lt;p&gt;")] == "<p>&amp;lt;p&amp;gt;</p>"


def test_percentiles_of_groups_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(k, v) for k, n in (("a", 5000), ("b", 700), ("c", 1), ("d", 2)) for v in (rng.choice([rng.random(), 0.5, -1e9, 7.0]) if k == "a" else rng.gauss(0, 1e6) for _ in range(n))]
    df = spark.createDataFrame([*rows, ("e", None)], "k string, v double")
    points = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in metrics.exact_percentiles(df, ["k"], F.col("v"), points).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for k, r in got.items():
        values = [v for g, v in rows if g == k]
        for name, p in points.items():
            assert abs(r[name] - np.quantile(values, p)) <= 1e-9 * max(1.0, abs(r[name])), (k, name)


def test_merged_identifiers(spark):
    old, new = F.create_map(F.lit("isbn"), F.lit("1"), F.lit("uri"), F.lit("u")), "ISBN:978-0-306-40615-7, doi: 10.1/a:b ,isbn:9780306406158, x:, goodreads:5,goodreads:6"
    assert one(spark, review.merged_identifiers(old, F.lit(new))) == {"isbn": "9780306406157", "uri": "u", "doi": "10.1/a:b", "goodreads": "6"}
    assert one(spark, review.merged_identifiers(old, F.lit(None).cast("string"))) == {"isbn": "1", "uri": "u"}


def test_prompt_review(spark):
    good = '{"valid":true,"issues":["a"],"repaired_prompt":null,"change_summary":""}'
    cases = {good: True, good.replace("true", '"yes"'): False, good.replace("null", "5"): False, good.replace("null", '"long"'): False, good.replace('["a"]', "[1]"): False, good.replace("}", ',"x":1}'): False, "[]": False, "x": False}
    df = spark.createDataFrame(list(cases.items()), "body string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", F.coalesce(contracts.valid_prompt_review("body", 3), F.lit(False)).alias("got")).collect())


def test_packages_and_damaged_members(spark):
    import io
    import zipfile

    def pack(opf, container="<c><rootfile full-path='a/b.opf'/></c>", damage=False):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", container)
            z.writestr("a/b.opf", opf)
            last = z.infolist()[-1]
        body = bytearray(raw.getvalue())
        if damage:
            body[last.header_offset + 30 + len(last.filename)] = 0xFF
        return bytes(body)

    doc = "<p xmlns:d='d'><d:title> A\n B </d:title><d:date/><d:date>2024</d:date></p>"
    rows = [("good", pack(doc)), ("doctype", pack("<!DOCTYPE p SYSTEM 'x'>" + doc)), ("subset", pack("<!DOCTYPE p [ ]>" + doc)), ("two", pack("<!DOCTYPE p><!DOCTYPE p>" + doc)), ("entity", pack("<!ENTITY x>" + doc)), ("broken", pack("<p>")), ("damaged", pack(doc, damage=True)), ("outside", pack(doc, "<c><rootfile full-path='../b.opf'/></c>")), ("none", b"x"), ("null", None)]
    members = archives.explode_members(spark.createDataFrame(rows, "path string, content binary"))
    assert {r["path"]: r["status"] for r in members.where("name = 'a/b.opf' or name is null").collect()} | {} == {k: "corrupt" if k == "damaged" else "unreadable" if k in ("none", "null") else "ok" for k, _ in rows}
    got = {r["path"]: r for r in archives.package_fields(members).collect()}
    assert set(got) == {"good", "doctype"} and all((r["titles"], r["date"], r["authors"]) == (["A B"], "2024", []) for r in got.values())


def test_catalog_note(spark):
    assert one(spark, text.drop_catalog_note(F.lit("<p>Good.</p><p>The selected edition is identified by ISBN.</p>"))) == "<p>Good.</p>"


def test_urls(spark):
    for bad in ("ftp://a.b/", "http://localhost/", "http://10.0.0.1/", "https://u:p@a.b/", "http://[::1]/", "", None):
        assert not one(spark, urls.valid_evidence_url(F.lit(bad).cast("string"))), bad
    assert one(spark, urls.valid_evidence_url(F.lit("https://example.org/a")))


def test_paths_and_versions(spark):
    for name, want in (("a/../b", "b"), ("../b", None), ("/b", None), ("", None), ("a\\b", "a/b")):
        assert one(spark, text.safe_path(F.lit(name))) == want
    v = lambda o: one(spark, catalog.classify_version(F.lit("1.9.0"), F.lit(o), F.lit("5.0.0"), F.lit("5.0.0")))
    assert v("1.10.0") == "available" and v("1.9.0") == "current" and v("01.0.0") is None


def test_tags(spark):
    df = spark.createDataFrame([(1, ["Straße", "STRASSE", " a  b ", "", "A B"])], "book_id int, tags array<string>")
    assert text_jobs.clean_tags(df).first()["tags"] == ["Straße", "a b"]
