"""Archive files: scans, members and package fields."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import decode_entities
from ..functions.text import safe_path

# The limits of a member scan.
MOST_MEMBERS, MOST_RATIO, RATIO_FROM, MOST_BYTES = 10_000, 200, 128 * 1024, 4 * 1024 * 1024
MEMBERS = "path string, name string, size long, compressed long, encrypted boolean, status string, content binary"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("encrypted", pa.bool_()), ("status", pa.string()), ("content", pa.binary())])
#: Bytes and members that a task hands on at once, unless one member is larger.
HELD_BYTES, HELD = 4 << 20, 2000


_LIST = T.ArrayType(T.StringType())
_FIELDS = T.StructType([T.StructField(n, _LIST) for n in ("titles", "authors", "identifiers")] + [T.StructField(n, T.StringType()) for n in ("publisher", "date", "language")])


def scan_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, content, fingerprint): one row a file, with the SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("fingerprint"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size and time are not in the manifest; only these need a new hash."""
    return files.join(manifest, ["path", "length", "modified"], "left_anti")


def explode_members(archives: DataFrame) -> DataFrame:
    """One row a member of (path, content) archives, with a status instead of an exception.

    Bytes are read only for members that are neither encrypted, too large nor
    inflated beyond the ratio; a member whose bytes are damaged is 'corrupt' and leaves the
    others as they are. An unreadable archive or one of too many members
    is one row with an error. Archives are dealt by Spark, one at a time in a task, and their members handed on
    many at a time, within a bound of bytes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for part in parts:
            for path, content in zip(part.column(0), part.column(1), strict=True):
                for member in _members(path.as_py(), content.as_py()):
                    made.append(member)
                    held += len(member[-1] or b"")
                    if held >= HELD_BYTES or len(made) >= HELD:
                        yield _batch(made)
                        made, held = [], 0
        if made:
            yield _batch(made)

    raw = archives.select("path", "content").mapInArrow(run, MEMBERS)
    safe = safe_path(F.col("name"))
    locked, ratio = F.col("encrypted"), (F.col("size") >= RATIO_FROM) & (F.col("size") > MOST_RATIO * F.greatest(F.lit(1), F.col("compressed")))
    status = F.when(F.col("name").isNull() | (F.col("status") == "corrupt"), F.col("status")).when(locked, "encrypted").when(ratio, "ratio").when(F.col("size") > MOST_BYTES, "skipped").when(safe.isNull(), "unsafe path").otherwise("ok")
    return raw.withColumn("status", status).withColumn("content", F.when(F.col("status") == "ok", F.col("content")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _members(path: str, content: bytes | None) -> Iterator[tuple]:
    """The directory of one archive, with the bytes of members within the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError):
        yield path, None, None, None, None, "unreadable", None
        return
    infos = archive.infolist()
    if len(infos) > MOST_MEMBERS:
        yield path, None, None, None, None, "too many members", None
        return
    for i in infos:
        locked, body, status = bool(i.flag_bits & 1), None, ""
        if not locked and i.file_size <= MOST_BYTES and i.file_size <= max(RATIO_FROM, MOST_RATIO * max(1, i.compress_size)):
            try:
                with archive.open(i) as stream:
                    body = stream.read(MOST_BYTES + 1)
                status = "" if len(body) <= MOST_BYTES else "corrupt"
            except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, ValueError):
                status = "corrupt"
        yield path, i.filename, i.file_size, i.compress_size, locked, status, body


def package_documents(members: DataFrame) -> DataFrame:
    """(path, name, xml): the package document that each archive's container names, with a simple document type taken out.

    It is never resolved; a document with an internal subset, a second declaration or an entity is
    refused, so nothing is left to expand.
    """
    named = members.where((F.col("name") == "META-INF/container.xml") & F.col("content").isNotNull()).select("path", _without_doctype(F.col("content").cast("string")).alias("xml"))
    root = F.regexp_extract("xml", r"""<(?:[\w.-]+:)?rootfile\b[^>]*?\bfull-path\s*=\s*["']([^"']*)["']""", 1)
    wanted = named.select("path", safe_path(root).alias("name")).where("name is not null").groupBy("path", "name").agg(F.count("*").alias("_named"))
    opf = members.where(F.col("content").isNotNull()).join(wanted, ["path", "name"])
    # What is asked of the document rests on both sides, so it is never asked of the other members before the join.
    return opf.select("path", "name", F.when(F.col("_named") > 0, _without_doctype(F.col("content").cast("string"))).alias("xml")).where("xml is not null")


def package_fields(members: DataFrame) -> DataFrame:
    """(path, titles, authors, identifiers, publisher, date, language) from the package documents.

    White space is collapsed and empty values dropped. A refused or malformed document gives no row.
    """
    return package_documents(members).select("path", _package("xml").alias("p")).select("path", "p.*").where("titles is not null")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag; '' where it is missing."""
    quoted = lambda q: F.regexp_extract(tag, rf"(?<![\w:.-]){name}\s*=\s*{q}([^{q}]*){q}", 1)
    return F.coalesce(F.nullif(quoted('"'), F.lit("")), quoted("'"))


def package_order(packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, spine, guide) of package documents, as reading_order() takes them; all on the JVM.

    manifest: (book_id, idref, href, media_type, base), the last of an id; spine: (book_id, pos, idref);
    guide: (book_id, pos, href, kind, base) of title and copyright pages. Comments are left out.
    """
    bare = packages.select(F.col("path").alias("book_id"), F.when(F.instr("name", "/") > 0, F.regexp_replace("name", "/[^/]*$", "")).otherwise("").alias("base"), F.regexp_replace("xml", r"(?s)<!--.*?-->", "").alias("xml"))

    def tags(name: str, **attributes: str) -> DataFrame:
        found = F.regexp_extract_all("xml", F.lit(rf"<(?:[\w.-]+:)?{name}\b[^>]*>"), F.lit(0))
        each = bare.select("book_id", "base", F.posexplode(found).alias("pos", "tag"))
        return each.select("book_id", "base", "pos", *[decode_entities(_attribute(F.col("tag"), a)).alias(c) for c, a in attributes.items()])

    items = tags("item", idref="id", href="href", media_type="media-type").where("idref <> '' and href <> ''")
    manifest = items.groupBy("book_id", "base", "idref").agg(F.max_by(F.struct("href", "media_type"), "pos").alias("i")).select("book_id", "base", "idref", "i.*")
    spine = tags("itemref", idref="idref").where("idref <> ''").drop("base")
    kind = F.lower("type")
    # The types of references that name a kind of page.
    named = F.when(kind.isin("title-page", "titlepage", "covertitle"), "title").when(kind.isin("copyright-page", "copyright"), "copyright")
    guide = tags("reference", href="href", type="type").withColumn("kind", named).where("href <> '' and kind is not null").drop("type")
    return manifest, spine, guide


@F.pandas_udf(_FIELDS)
def _package(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_texts(xml) for xml in documents], columns=_FIELDS.names)


def _texts(xml: str) -> tuple:
    """The collapsed texts of one package document; nulls where it is no XML."""
    found: dict[str, list[str]] = {}
    try:
        nodes = ElementTree.fromstring(xml).iter()
    except (ElementTree.ParseError, ValueError):
        return (None,) * len(_FIELDS)
    for node in nodes:
        value = " ".join((node.text or "").split())
        if value and isinstance(node.tag, str):
            name = node.tag.rsplit("}", 1)[-1].lower()
            found.setdefault("creator" if name == "contributor" else name, []).append(value)
    first = lambda n: found.get(n, [None])[0]
    return found.get("title", []), found.get("creator", []), found.get("identifier", []), first("publisher"), first("date"), first("language")


def _without_doctype(xml: Column) -> Column:
    """The document without a simple document type; null where it declares entities, a subset or more than one."""
    bare = F.regexp_replace(xml, r"(?is)\A(.*?)<!DOCTYPE\s+[^>\[]+>", "$1")
    refused = xml.rlike(r"(?i)<!ENTITY") | xml.rlike(r"(?is)<!DOCTYPE[^>]*\[") | bare.rlike(r"(?i)<!DOCTYPE")
    return F.when(~refused, bare)
