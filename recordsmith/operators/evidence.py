"""Pages of documents: classification and bounded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import fold, instruction_risk, safe_href
from ..sources.archives import explode_members, package_documents, package_fields, package_order
from ..sources.staging import staged

# Names, markup and words that tell the kinds of pages.
TITLE_PATH = r"(?:^|[/_. -])(?:title[-_ ]?page|titlepage|covertitle|title)(?:[/_. -]|$)"
COPYRIGHT_PATH = r"(?:^|[/_. -])(?:copyright|copyright[-_ ]?page)(?:[/_. -]|$)"
EXCLUDED_PATH = r"(?:^|[/_. -])(?:toc|contents?|nav|chapter|preface|introduction|dedication|acknowledg(?:e)?ments?|excerpt|sample)(?:[/_. -]|$)"
TITLE_MARKUP = r"(?i)\bepub:type\s*=\s*[\"'][^\"']*\b(?:titlepage|title-page|covertitle)\b[^\"']*[\"']"
COPYRIGHT_MARKUP = r"(?i)\bepub:type\s*=\s*[\"'][^\"']*\bcopyright-page\b[^\"']*[\"']"
COPYRIGHT_WORDS = r"(?i)\bcopyright\b|©|&#169;"
SUPPORT_WORDS = r"(?i)\bISBN(?:-1[03])?\b|\ball rights reserved\b|\bpublished by\b|\b(?:first|revised|updated) edition\b|\bimprint\b"
LONGEST = {"markup": 10_000, "path": 5_000, "fallback": 3_000}
EARLY = 8


def classify_pages(pages: DataFrame) -> DataFrame:
    """pages (name, raw, text, position, guide_kinds, titles, authors) with kinds, a sorted array of 'copyright' and 'title'.

    Titles and authors of fewer than three characters are ignored.
    """
    c, name = F.col, F.lower("name")
    body = fold(c("text"))
    occurs = lambda a: F.coalesce(F.exists(a, lambda t: (F.length(t) >= 3) & F.contains(body, fold(t))), F.lit(False))
    has_title, has_author = occurs("titles"), occurs("authors")
    marked, supported = c("text").rlike(COPYRIGHT_WORDS), c("text").rlike(SUPPORT_WORDS)
    guide = lambda k: F.coalesce(F.array_contains("guide_kinds", k), F.lit(False))
    size, early = F.length("text"), c("position") < EARLY
    open_path = ~name.rlike(EXCLUDED_PATH)
    title = ((guide("title") | c("raw").rlike(TITLE_MARKUP)) & (size <= LONGEST["markup"]) & has_title) | (name.rlike(TITLE_PATH) & early & (size <= LONGEST["path"]) & has_title) | (open_path & early & (size <= LONGEST["fallback"]) & has_title & has_author)
    named = guide("copyright") | c("raw").rlike(COPYRIGHT_MARKUP) | name.rlike(COPYRIGHT_PATH)
    rights = (named & (marked | supported)) | (open_path & marked & supported)
    return pages.withColumn("kinds", F.array_compact(F.array(F.when(rights, "copyright"), F.when(title, "title"))))


def first_page_per_kind(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, page_id, position, kinds): the first page of each kind; a page that serves both appears once."""
    each = pages.select(book, "page_id", "position", F.explode("kinds").alias("kind"))
    first = each.groupBy(book, "kind").agg(F.min(F.struct("position", "page_id")).alias("p"))
    return first.groupBy(book, F.col("p.page_id").alias("page_id"), F.col("p.position").alias("position")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def bounded_evidence(pages: DataFrame, limit: int, *, book: str = "book_id", order: str = "position") -> DataFrame:
    """(book, evidence): each page cut to an equal share of the limit, its label counted, joined by blank lines, cut again.

    The pages of a book are few (one a kind); the cut comes before they are gathered.
    """
    n = F.count("*").over(Window.partitionBy(book))
    label = F.concat(F.lit("["), F.array_join(F.array_sort("kinds"), " and "), F.lit(" page]\n"))
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / n).cast("int"))
    cut = pages.withColumn("_c", F.substring(F.concat(label, F.col("text")), F.lit(1), share))
    joined = cut.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(order, "_c"))).alias("p"))
    return joined.select(book, F.substring(F.array_join(F.col("p._c"), "\n\n"), 1, limit).alias("evidence"))


def running_sum(rows: DataFrame, value: str, *, group: str, order: str) -> DataFrame:
    """rows with `running`, the sum of value up to each row of its group in order, as a prefix sum on two levels.

    Rows are dealt into ranges of (group, order) and written, so one group may span all of them. Sums of
    the ranges, a row for each range and group, give what stands before a range; inside
    a range a window adds the rest. Rows of one group that are equal in order share a range.
    """
    cut = staged(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.where(F.col(group).isNotNull()).join(before, [group, "_range"])
    return joined.withColumn("running", F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*rows.columns, "running")


def running_byte_budget(members: DataFrame, budget: int, *, group: str, order: str, size: str) -> DataFrame:
    """members with running bytes in order, and whether the budget is passed there; members of no group are left out."""
    return running_sum(members, size, group=group, order=order).withColumn("over_budget", F.col("running") > budget)


def reading_order(manifest: DataFrame, spine: DataFrame, guide: DataFrame, *, book: str = "book_id", most: int = 24) -> DataFrame:
    """(book, href, position): guide entries first (-1), then the first `most` spine entries that the manifest lists as pages.

    The limit counts spine entries before the join; the first position of a name wins. With a
    column `base`, the package's folder, in manifest and guide, links are resolved to
    member names, and those that leave the archive are dropped.
    """
    if "base" in manifest.columns:
        member = safe_href(F.col("base"), F.col("href"))
        manifest, guide = (t.withColumn("href", member).where("href is not null") for t in (manifest, guide))
    w = Window.partitionBy(book).orderBy("pos")
    early = spine.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    typed = manifest.where(F.coalesce("media_type", F.lit("")).isin("application/xhtml+xml", "text/html", ""))
    listed = early.join(typed, [book, "idref"]).select(book, "href", (F.col("_n") - 1).alias("position"))
    both = guide.select(book, "href", F.lit(-1).alias("position")).unionByName(listed)
    return both.groupBy(book, "href").agg(F.min("position").alias("position"))


# Bytes of all candidate pages of an archive, and what is read of a page at least.
SCAN_BYTES, SCAN_CHARS, PAGE_BYTES = 4 * 1024 * 1024, 20_000, 256 * 1024


def archive_evidence(archives: DataFrame, limit: int = 12_000) -> DataFrame:
    """(path, status, titles, authors, identifiers, publisher, date, language, evidence, suspicious) of (path, content) archives.

    From members and package documents over the reading order to classified pages: the first title
    and copyright page of each archive, within the limit. status is ok, no package, or scan limit
    where an archive's candidate pages are too large together; only ok archives have evidence.
    Members are unpacked once and written.
    """
    members = staged(explode_members(archives), "members")
    packages = staged(package_documents(members), "packages")
    fields = package_fields(members)
    manifest, spine, guide = package_order(packages)
    order = reading_order(manifest, spine, guide.select("book_id", "href", "base"))
    said = guide.select("book_id", safe_href(F.col("base"), F.col("href")).alias("href"), "pos", "kind").where("href is not null")
    said = said.groupBy("book_id", "href").agg(F.min("pos").alias("first"), F.max_by("kind", "pos").alias("kind"))
    scan = max(SCAN_CHARS, 2 * limit)
    small = members.where((F.col("status") == "ok") & (F.col("size") <= max(PAGE_BYTES, 4 * scan))).select(F.col("path").alias("book_id"), F.col("name").alias("href"), "size", "content")
    found = staged(order.join(small, ["book_id", "href"]).join(said, ["book_id", "href"], "left"), "candidates")
    large = found.groupBy("book_id").agg(F.sum("size").alias("scanned")).where(F.col("scanned") > SCAN_BYTES).select("book_id")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    names = fields.select(F.col("path").alias("book_id"), "titles", "authors")
    pages = found.join(large, "book_id", "left_anti").join(names, "book_id").select(
        "book_id", F.struct(F.coalesce("first", F.lit(0)).alias("first"), "href").alias("page_id"), F.col("href").alias("name"), raw.alias("raw"),
        F.substring(html_to_text(raw), 1, scan).alias("text"), "position", F.array_compact(F.array("kind")).alias("guide_kinds"), "titles", "authors",
    )
    judged = staged(classify_pages(pages.where("text <> ''")).where(F.size("kinds") > 0).select("book_id", "page_id", "text", "position", "kinds"), "pages")
    first = first_page_per_kind(judged).withColumnRenamed("position", "_at").join(judged.drop("kinds", "position"), ["book_id", "page_id"])
    chosen = first.withColumn("position", F.struct("_at", "page_id"))
    texts = bounded_evidence(chosen, limit).withColumnRenamed("book_id", "path")
    out = archives.select("path").join(fields, "path", "left").join(texts, "path", "left").join(large.select(F.col("book_id").alias("path"), F.lit(True).alias("_large")), "path", "left")
    status = F.when(F.col("titles").isNull(), "no package").when(F.col("_large"), "scan limit").otherwise("ok")
    evidence = F.when(status == "ok", F.coalesce("evidence", F.lit("")))
    return out.select("path", status.alias("status"), "titles", "authors", "identifiers", "publisher", "date", "language", evidence.alias("evidence"), (F.coalesce(instruction_risk(evidence), F.lit(0)) >= 2).alias("suspicious"))


# The limits of a container that is read.
CONTAINER, CONTAINER_BYTES, RATIO, RATIO_FROM = "META-INF/container.xml", 256 * 1024, 200, 128 * 1024


def archive_health(archives: DataFrame, members: DataFrame, key: str = "path") -> DataFrame:
    """One row an archive: members, sizes, encrypted ones, and flags of the container's markup; unreadable ones count 0.

    Only the container is looked into, and only if it is neither encrypted, too large nor
    packed beyond the ratio; otherwise it counts as absent and has no size.
    """
    size, packed = F.col("size"), F.greatest(F.lit(1), F.col("compressed"))
    packed_well = (size < RATIO_FROM) | (size <= RATIO * packed)
    readable = (F.col("name") == CONTAINER) & ~F.coalesce("encrypted", F.lit(False)) & (size <= CONTAINER_BYTES) & packed_well
    has = lambda p: F.bool_or(readable & F.coalesce(F.col("head").rlike(p), F.lit(False)))
    out = members.groupBy(key).agg(
        F.count("*").alias("members"),
        F.sum("compressed").alias("compressed"),
        F.sum("size").alias("size"),
        F.count_if("encrypted").alias("encrypted"),
        F.bool_or(readable).alias("has_container"),
        F.max(F.when(readable, size)).alias("container_size"),
        has(r"(?i)<!DOCTYPE").alias("doctype"),
        has(r"(?is)<!DOCTYPE[^>]*\[").alias("internal_subset"),
        has(r"(?i)<!ENTITY").alias("entity"),
    )
    joined = archives.select(key).join(out, key, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("members", "compressed", "size", "encrypted")}
    return joined.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("has_container", "doctype", "internal_subset", "entity")})


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
