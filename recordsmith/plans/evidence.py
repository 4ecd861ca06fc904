"""Queries over pages, members and search results: F8, W4-W6, W8, W9, S5, S8, S9, J3, J9, A14, A16, F13."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.urls import valid_result_url
from ..operators import enrich, evidence, journal, text_jobs
from ..sources import tables
from .registry import add


def _pages(v):
    p = v.pages
    name = F.when(F.col("page_id") % 5 == 0, "text/titlepage.xhtml").when(F.col("page_id") % 5 == 1, "text/copyright.xhtml").when(F.col("page_id") % 5 == 2, "text/chapter-1.xhtml").otherwise("text/p.xhtml")
    text = F.concat(html_to_text(F.col("html")), F.when(F.col("page_id") % 3 == 0, " Copyright 2024. All rights reserved. ISBN 1").otherwise(""))
    title = evidence.page_title(F.col("html"))
    return p.select((F.col("page_id") % 50).alias("book_id"), "page_id", name.alias("name"), F.col("html").alias("raw"), text.alias("text"), F.floor(F.col("page_id") / 50).cast("int").alias("position"), F.array(F.when(F.col("page_id") % 11 == 0, "copyright").otherwise("toc")).alias("guide_kinds"), F.array(F.substring(title, 1, 12)).alias("titles"), F.array(F.when(F.col("page_id") % 2 == 0, "zzzz").otherwise(F.substring(title, 1, 5))).alias("authors"))


_WS = r"[\s\x{A0}\x0B]+"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '" + _WS + "', ' ', 'g'))"
for _raw, _to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):  # all that the pages hold
    _PLAIN = f"replace({_PLAIN}, '{_raw}', '{_to}')"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"
_PAGES = rf"""pg AS (SELECT page_id % 50 AS book_id, page_id, CAST(page_id // 50 AS INT) AS position, concat(trim(regexp_replace({_PLAIN}, '{_WS}', ' ', 'g')), CASE WHEN page_id % 3 = 0 THEN ' Copyright 2024. All rights reserved. ISBN 1' ELSE '' END) AS text, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages),
fl AS (SELECT *, replace(lower(text), 'ß', 'ss') AS low, regexp_matches(text, '(?i)\bcopyright\b|©|&#169;') AS marked, regexp_matches(text, '(?i)\bISBN(-1[03])?\b|\ball rights reserved\b|\bpublished by\b|\b(first|revised|updated) edition\b|\bimprint\b') AS supported, replace(lower(substr(title, 1, 12)), 'ß', 'ss') AS t, CASE WHEN page_id % 2 = 0 THEN 'zzzz' ELSE replace(lower(substr(title, 1, 5)), 'ß', 'ss') END AS a FROM pg),
kd AS (SELECT *, ((page_id % 11 = 0 OR page_id % 5 = 1) AND (marked OR supported)) OR (page_id % 5 <> 2 AND marked AND supported) AS is_copyright,
 (page_id % 5 = 0 AND position < 8 AND length(text) <= 5000 AND length(t) >= 3 AND contains(low, t)) OR (page_id % 5 <> 2 AND position < 8 AND length(text) <= 3000 AND length(t) >= 3 AND contains(low, t) AND length(a) >= 3 AND contains(low, a)) AS is_title FROM fl)"""
_KINDS = "concat_ws(',', CASE WHEN is_copyright THEN 'copyright' END, CASE WHEN is_title THEN 'title' END)"
add(
    "f8_classify_pages",
    lambda v: evidence.classify_pages(_pages(v)).select("page_id", F.array_join("kinds", ",").alias("kinds")),
    f"WITH {_PAGES} SELECT page_id, {_KINDS} AS kinds FROM kd",
)
_FIRST = f"""{_PAGES}, each_ AS (SELECT book_id, page_id, position, 'copyright' AS kind FROM kd WHERE is_copyright UNION ALL SELECT book_id, page_id, position,
    'title' FROM kd WHERE is_title), fp AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY position, page_id) = 1), fk
    AS (SELECT book_id, page_id, position, string_agg(kind, ',' ORDER BY kind) AS kinds FROM fp GROUP BY 1, 2, 3)"""
_first = lambda v: evidence.first_page_per_kind(evidence.classify_pages(_pages(v)))
add("w4_first_page_per_kind", lambda v: _first(v).withColumn("kinds", F.array_join("kinds", ",")), f"WITH {_FIRST} SELECT * FROM fk")
add(
    "w5_bounded_evidence",
    lambda v: evidence.bounded_evidence(_first(v).join(_pages(v).select("page_id", "text"), "page_id"), 600),
    f"""WITH {_FIRST}, n AS (SELECT k.book_id, k.position, substr(concat('[', replace(kinds, ',', ' and '), ' page]', chr(10), text), 1, CAST(greatest(1, 600
    // count(*) OVER (PARTITION BY k.book_id)) AS BIGINT)) AS c FROM fk k JOIN kd ON kd.page_id = k.page_id) SELECT book_id, substr(string_agg(c,
    concat(chr(10), chr(10)) ORDER BY position), 1, 600) AS evidence FROM n GROUP BY 1""",
)
_NAMES = ("titlepage", "copyright", "chapter", "p", "p")


def _page_archives(v):
    """An archive of each ten pages, packed in the tasks: container, package with titles, authors, order and guide, and the pages."""
    said = _pages(v).select("page_id", "raw", F.get("titles", F.lit(0)).alias("title"), F.get("authors", F.lit(0)).alias("author"))
    more = F.when(F.col("page_id") % 3 == 0, "<p>Copyright 2024. All rights reserved. ISBN 1</p>").otherwise("")

    def pack(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("page_id")
        names = [f"text/{_NAMES[k % 5]}-{k}.xhtml" for k in book["page_id"]]
        named = "".join(f"<dc:title>{escape(t or '')}</dc:title><dc:creator>{escape(a or '')}</dc:creator>" for t, a in zip(book["title"], book["author"], strict=True))
        items = "".join(f'<item href="{n}#x" media-type="application/xhtml+xml" id="i{k}"/>' for k, n in zip(book["page_id"], names, strict=True))
        refs = "".join(f"<itemref idref='i{k}'/>" for k in book["page_id"])
        guide = "".join(f'<reference type="Copyright-Page" href="{n}"/>' for k, n in zip(book["page_id"], names, strict=True) if k % 11 == 0)
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", "<container><rootfile full-path='OEBPS/content.opf'/></container>")
            z.writestr("OEBPS/content.opf", f"<package xmlns:dc='d'><!-- <itemref idref='none'/> -->{named}<manifest>{items}</manifest><spine>{refs}</spine><guide>{guide}</guide></package>")
            for n, html in zip(names, book["raw"], strict=True):
                z.writestr(f"OEBPS/{n}", html)
        return pd.DataFrame({"path": [str(book["page_id"].iloc[0] // 10)], "content": [raw.getvalue()]})

    return said.withColumn("raw", F.concat("raw", more)).groupBy(F.floor(F.col("page_id") / 10)).applyInPandas(pack, "path string, content binary")


_CLEAN = f"trim(regexp_replace(title, '{_WS}', ' ', 'g'))"
add(
    "e4_archive_evidence",
    lambda v: evidence.archive_evidence(_page_archives(v), 600).select("path", "status", F.size("titles").cast("long").alias("titles"), "evidence", "suspicious"),
    rf"""WITH pg AS (SELECT page_id, page_id // 10 AS book_id, CAST(CASE WHEN page_id % 11 = 0 THEN -1 ELSE page_id % 10 END AS INT) AS position, trim(regexp_replace(concat({_PLAIN}, CASE WHEN page_id % 3 = 0 THEN ' Copyright 2024. All rights reserved. ISBN 1' ELSE '' END), '{_WS}', ' ', 'g')) AS text,
    substr(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), 1, 12) AS title FROM pages),
    ot AS (SELECT book_id, list(replace(lower({_CLEAN}), 'ß', 'ss')) AS ts, list(CASE WHEN page_id % 2 = 0 THEN 'zzzz' ELSE replace(lower(trim(substr({_CLEAN}, 1, 5))), 'ß', 'ss') END) AS aus, count(*) FILTER (WHERE {_CLEAN} <> '') AS titles FROM pg GROUP BY 1),
    fl AS (SELECT pg.*, ot.titles, replace(lower(text), 'ß', 'ss') AS low, ts, aus, regexp_matches(text, '(?i)copyright|©|&#169;') AS marked, regexp_matches(text, '(?i)ISBN(-1[03])?|all rights reserved|published by|(first|revised|updated) edition|imprint') AS supported FROM pg JOIN ot ON ot.book_id = pg.book_id WHERE text <> ''),
    hs AS (SELECT *, len(list_filter(ts, lambda t: length(t) >= 3 AND contains(low, t))) > 0 AS has_title, len(list_filter(aus, lambda a: length(a) >= 3 AND contains(low, a))) > 0 AS has_author FROM fl),
    kd AS (SELECT *, ((page_id % 11 = 0 OR page_id % 5 = 1) AND (marked OR supported)) OR (page_id % 5 <> 2 AND marked AND supported) AS is_copyright,
     (page_id % 5 = 0 AND position < 8 AND length(text) <= 5000 AND has_title) OR (page_id % 5 <> 2 AND position < 8 AND length(text) <= 3000 AND has_title AND has_author) AS is_title FROM hs),
    each_ AS (SELECT page_id, book_id, position, text, 'copyright' AS kind FROM kd WHERE is_copyright UNION ALL SELECT page_id, book_id, position, text, 'title' FROM kd WHERE is_title),
    fp AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY position) = 1),
    fk AS (SELECT book_id, page_id, position, any_value(text) AS text, string_agg(kind, ' and ' ORDER BY kind) AS kinds FROM fp GROUP BY 1, 2, 3),
    n AS (SELECT book_id, position, substr(concat('[', kinds, ' page]', chr(10), text), 1, CAST(greatest(1, 600 // count(*) OVER (PARTITION BY book_id)) AS BIGINT)) AS c FROM fk),
    ev AS (SELECT book_id, substr(string_agg(c, concat(chr(10), chr(10)) ORDER BY position), 1, 600) AS evidence FROM n GROUP BY 1)
    SELECT CAST(ot.book_id AS VARCHAR) AS path, 'ok' AS status, titles, coalesce(evidence, '') AS evidence, false AS suspicious FROM ot LEFT JOIN ev ON ev.book_id = ot.book_id""",
)
add(
    "w6_running_byte_budget",  # fifty documents as the members of one archive
    lambda v: evidence.running_byte_budget(v.documents.select("doc_id", F.floor(F.col("doc_id") / 50).alias("archive"), "n_chars"), 100_000, group="archive", order="doc_id", size="n_chars").select("doc_id", "archive", "running", "over_budget"),
    "SELECT doc_id, archive, CAST(r AS BIGINT) AS running, r > 100000 AS over_budget FROM (SELECT doc_id, doc_id // 50 AS archive, sum(n_chars) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS r FROM documents)",
)
add(
    "w6_one_archive",  # all documents as the members of one archive
    lambda v: evidence.running_byte_budget(v.documents.select("doc_id", F.lit(0).alias("archive"), "n_chars"), 1_000_000, group="archive", order="doc_id", size="n_chars").select("doc_id", "running", "over_budget"),
    "SELECT doc_id, CAST(r AS BIGINT) AS running, r > 1000000 AS over_budget FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS r FROM documents)",
)
_VALID = "regexp_matches(url, '^https?://[^/@]+')"
add(
    "w8_top_results",
    lambda v: enrich.top_results(v.results.where(valid_result_url(F.col("url"))), 3).select("query", "pos", "url", F.col("rank").cast("long").alias("rank")),
    f"SELECT query, pos, url, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank FROM results WHERE {_VALID} QUALIFY rank <= 3",
)
add(
    "w9_top_citations",
    lambda v: enrich.top_results(v.results.where(valid_result_url(F.col("url"))), 10).select("query", F.substring("url", 1, 1000).alias("url"), F.substring(evidence.page_title(F.col("html")), 1, 200).alias("title"), F.substring(F.lower("html"), 1, 300).alias("text")),
    f"""SELECT query, substr(url, 1, 1000) AS url, substr(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), 1, 200) AS title, substr(lower(html), 1, 300)
    AS text FROM results WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) <= 10""",
)


def _order(v):
    li = v.lineitem
    part = F.col("l_partkey") % 50
    # Links as packages write them: with a fragment, percent-encoded, below the package's folder, or leaving the archive.
    href = F.when(part % 5 == 0, F.concat(F.lit("t/../p%20"), part, F.lit("#top"))).when(part % 5 == 1, F.concat(F.lit("../../p"), part)).otherwise(F.concat(F.lit("p"), part))
    base = F.lit("OEBPS").alias("base")
    spine = li.select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").cast("string").alias("idref"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("pos"))
    kind = F.when(F.col("l_suppkey") % 3 == 0, "image/png").when(F.col("l_suppkey") % 3 == 1, "text/html")
    manifest = li.select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").cast("string").alias("idref"), href.alias("href"), kind.alias("media_type"), base).distinct()
    guide = li.where("l_linenumber = 1 and l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("book_id"), href.alias("href"), base)
    return evidence.reading_order(manifest, spine, guide, most=3)


_MEMBER = "concat('OEBPS/p', CASE WHEN l_partkey % 50 % 5 = 0 THEN ' ' ELSE '' END, CAST(l_partkey % 50 AS VARCHAR))"
add(
    "s5_reading_order",
    _order,
    f"""WITH sp AS (SELECT l_orderkey AS book_id, l_partkey AS idref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
    mf AS (SELECT DISTINCT l_orderkey AS book_id, l_partkey AS idref, {_MEMBER} AS href, l_suppkey % 3 AS m FROM lineitem WHERE l_partkey % 50 % 5 <> 1),
    al AS (SELECT sp.book_id, href, n - 1 AS position FROM sp JOIN mf ON mf.book_id = sp.book_id AND mf.idref = sp.idref WHERE n <= 3 AND m <> 0
      UNION ALL SELECT l_orderkey, {_MEMBER}, -1 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 AND l_partkey % 50 % 5 <> 1)
    SELECT book_id, href, CAST(min(position) AS INT) AS position FROM al GROUP BY 1, 2""",
)


def _search(v):
    r = v.results.withColumn("query", F.floor(F.col("pos") / 20)).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("ftp://x/"), F.col("pos"))).otherwise(F.col("url")).alias("url"), F.concat(F.lit(" T  "), F.col("pos")).alias("title")))).alias("x"))
    items = F.transform("x", lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), F.lit(" some\n text ").alias("content")))
    return tables.ingest_search_results(r.select("query", F.to_json(F.struct(items.alias("results"))).alias("body")), 4)


add(
    "s8_ingest_search_results",  # twenty pages as one response
    lambda v: _search(v).select("query", "rank", "title", "url", "snippet"),
    "WITH r AS (SELECT pos // 20 AS query, pos, url FROM results) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos) - 1 AS INT) AS rank, concat('T ', CAST(pos AS VARCHAR)) AS title, url, 'some text' AS snippet FROM r WHERE pos % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) <= 4",
)


def _usage(v):
    e, c = v.events, lambda x: F.expr(x).cast("string")
    a = F.concat(F.lit('{"usage":{"input_tokens":'), c("event_id"), F.lit(',"output_tokens":'), c("user_id"), F.lit(',"total_tokens":'), c("event_id + user_id"), F.lit(',"input_tokens_details":{"cached_tokens":7},"output_tokens_details":{"reasoning_tokens":3}},"output":[{"type":"web_search_call"},{"type":"message"}]}'))
    b = F.concat(F.lit('{"usage":{"input_tokens":'), c("event_id"), F.lit(',"output_tokens":'), c("user_id"), F.lit(',"cache_read_input_tokens":5,"server_tool_use":{"web_search_requests":2}}}'))
    d = F.concat(F.lit('{"usage":{"prompt_tokens":'), c("event_id"), F.lit(',"completion_tokens":'), c("user_id"), F.lit("}}"))
    kind = F.col("event_id") % 3
    return tables.unify_usage(e.select((F.col("user_id") * 3 + kind).alias("request_id"), F.when(kind == 0, "openai").when(kind == 1, "anthropic").otherwise("ollama").alias("provider"), F.when(kind == 0, a).when(kind == 1, b).otherwise(d).alias("body")))


add(
    "s9_unify_usage",
    _usage,
    """SELECT user_id * 3 + event_id % 3 AS request_id, CASE event_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'ollama' END AS provider,
    CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 0 END) AS BIGINT) AS cached_tokens,
    CAST(sum(user_id) AS BIGINT) AS output_tokens, CAST(sum(CASE event_id % 3 WHEN 0 THEN 3 ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(CASE
    event_id % 3 WHEN 2 THEN 0 ELSE event_id + user_id END) AS BIGINT) AS total_tokens, CAST(sum(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)
    AS BIGINT) AS search_calls FROM events GROUP BY 1, 2""",
)


def _citations(v):
    """Twelve pages are cited by one request; its search found every other one, and some of the next request."""
    request = lambda shift: F.floor((F.col("page_id") + shift) / 12)
    found = v.pages.where("page_id % 2 = 0").select(request(3).alias("request_id"), "url")
    fields = v.pages.groupBy(request(0).alias("request_id")).agg(F.array_sort(F.collect_list("url")).alias("evidence_urls"))
    return enrich.constrain_citations(fields, found).select("request_id", F.array_join("evidence_urls", " ").alias("urls"))


add(
    "j3_constrain_citations",
    _citations,
    """WITH f AS (SELECT page_id // 12 AS request_id, url FROM pages), a AS (SELECT DISTINCT (page_id + 3) // 12 AS request_id, url FROM pages WHERE page_id % 2 = 0)
    SELECT f.request_id, coalesce(string_agg(f.url, ' ' ORDER BY f.url) FILTER (WHERE a.url IS NOT NULL), '') AS urls FROM f LEFT JOIN a ON a.request_id = f.request_id AND a.url = f.url GROUP BY 1""",
)
add(
    "j9_dangling_links",
    lambda v: text_jobs.dangling_links(v.pages, v.pages.where("page_id % 2 = 0").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1))).alias("path"))),
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS raw FROM pages), known AS (SELECT DISTINCT
    unnest(regexp_extract_all(html, 'href=\"([^\"#]*)', 1)) AS path FROM pages WHERE page_id % 2 = 0) SELECT DISTINCT page_id, split_part(raw, '#', 1)
    AS link FROM l WHERE NOT regexp_matches(raw, '^(https?:|#)') AND split_part(raw, '#', 1) <> '' AND split_part(raw, '#', 1) NOT IN (SELECT path
    FROM known)""",
)


def _health(v):
    li, part = v.lineitem, F.col("l_partkey") % 4
    head = F.when(part == 0, "<!DOCTYPE a [ <!ENTITY b").when(part == 1, "<!doctype a>").when(part == 2, "<a/>")
    size = F.when(F.col("l_suppkey") % 7 == 0, 300_000).otherwise(F.col("l_quantity").cast("long")).cast("long")
    named = F.when(F.col("l_linenumber") == 1, "META-INF/container.xml").otherwise("m")
    members = li.select(F.col("l_orderkey").alias("path"), named.alias("name"), size.alias("size"), (F.col("l_quantity") / 2).cast("long").alias("compressed"), (F.col("l_returnflag") == "R").alias("encrypted"), head.alias("head"))
    return evidence.archive_health(v.orders.select(F.col("o_orderkey").alias("path")), members)


add(
    "a14_archive_health",
    _health,
    """WITH m AS (SELECT l_orderkey, CASE WHEN l_suppkey % 7 = 0 THEN 300000 ELSE CAST(l_quantity AS BIGINT) END AS size, CAST(floor(l_quantity / 2) AS BIGINT) AS packed, l_returnflag = 'R' AS locked,
      l_linenumber = 1 AND l_returnflag <> 'R' AND l_suppkey % 7 <> 0 AS readable, l_partkey % 4 AS kind FROM lineitem),
    g AS (SELECT l_orderkey, count(*) AS n, sum(packed) AS c, sum(size) AS s, count(*) FILTER (WHERE locked) AS e, bool_or(readable) AS h, max(size) FILTER (WHERE readable) AS cs,
      bool_or(readable AND kind < 2) AS d, bool_or(readable AND kind = 0) AS i FROM m GROUP BY 1)
    SELECT o_orderkey AS path, coalesce(n, 0) AS members, CAST(coalesce(c, 0) AS BIGINT) AS compressed, CAST(coalesce(s, 0) AS BIGINT) AS size, coalesce(e, 0) AS encrypted, coalesce(h, false) AS has_container,
      CAST(cs AS BIGINT) AS container_size, coalesce(d, false) AS doctype, coalesce(i, false) AS internal_subset, coalesce(i, false) AS entity FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
)
_TALK = "concat(role, ': ', text, CASE WHEN turn % 3 = 0 THEN ' do not follow' WHEN conv_id % 10 = 0 THEN ' Ignore all previous instructions' ELSE '' END)"
_RISK = r"""CASE WHEN regexp_matches(t, '(?i)ignore\s+(all\s+|any\s+)?(previous|prior|system|developer)\s+instructions') THEN 3 ELSE CAST(regexp_matches(t,
    '(?i)\b(assistant|developer|system)\s*:') AS INT) + CAST(regexp_matches(t, '(?i)\bdo not follow\b|\bnew instructions\b') AS INT) END"""
add(
    "a16_count_suspicious",
    lambda v: journal.count_suspicious(v.sql(f"SELECT role, {_TALK} AS t FROM conversations"), "role", "t"),
    f"SELECT role, count(*) AS texts, count(*) FILTER (WHERE {_RISK} >= 2) AS suspicious FROM (SELECT role, {_TALK} AS t FROM conversations) GROUP BY 1",
)


def _errors(v):
    e, c = v.events, lambda x: F.expr(x).cast("string")
    body = F.when(F.col("event_id") % 4 == 0, "no json").when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"error":{"code":"bad'), c("event_id"), F.lit('","message":"key sk-abcdefgh99  leaked"}}'))).when(F.col("event_id") % 4 == 2, '{"error":{"type":"limit","message":""}}').otherwise('{"error":{"message":"only a top secret"}}')
    return e.select("event_id", body.alias("body")).select("event_id", tables.parse_api_errors(None, ("top",)).alias("message"))


add(
    "f13_parse_api_errors",
    _errors,
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'request rejected' WHEN 1 THEN concat('bad', CAST(event_id AS VARCHAR), ': key [REDACTED] leaked') WHEN
    2 THEN 'limit: request rejected' ELSE 'only a [REDACTED] secret' END AS message FROM events""",
)
