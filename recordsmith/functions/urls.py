"""Column functions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cascade, contains_any, once, strip


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def _octets(name: Column) -> Column:
    return F.when(name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(name, r"\."), lambda x: x.cast("int")))


def private_ipv4(name: Column) -> Column:
    """True for IPv4 literals that are not globally reachable."""

    def reserved(o: Column) -> Column:
        a, b, c = (F.get(o, i) for i in range(3))
        # The blocks that are not global.
        blocks = a.isin(0, 10, 127) | (a >= 240) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        return blocks | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))

    return F.coalesce(once(_octets(name), reserved), F.lit(False))


def private_ipv6(name: Column) -> Column:
    """True for bracketed IPv6 literals that are not globally reachable; null for other names."""
    groups = F.split(F.split(F.btrim(name, F.lit("[]")), "::")[0], ":")

    def number(listed: Column, i: int) -> Column:
        return F.conv(F.coalesce(F.nullif(F.get(listed, i), F.lit("")), F.lit("0")), 16, 10).try_cast("int")

    def reserved(g: Column) -> Column:
        a, b, c, d = (F.get(g, i) for i in range(4))
        # The blocks that are not global, and the parts of 2001::/23 that are.
        shared = (a == 0x2001) & (b < 0x200) & ~(b.between(0x20, 0x3F) | (b == 3) | ((b == 4) & (c == 0x112)))
        blocks = (a == 0) | ((a == 0x64) & (b == 0xFF9B) & (c == 1)) | ((a == 0x100) & (b == 0) & (c == 0) & (d == 0)) | shared | ((a == 0x2001) & (b == 0xDB8)) | (a == 0x2002)
        return blocks | a.between(0xFC00, 0xFDFF) | a.between(0xFE80, 0xFEBF)

    judged = once(once(groups, lambda listed: F.array(*[number(listed, i) for i in range(4)])), reserved)
    return F.when(name.startswith("["), F.coalesce(judged, F.lit(True)))


def valid_evidence_url(url: Column, limit: int = 2048) -> Column:
    """http or https with a public host, no credentials, at most `limit` characters.

    Each part of the address is taken out once, and its host taken apart once, also inside a lambda.
    """

    def good(p: Column) -> Column:
        name = p["host"]
        ok = p["protocol"].isin("http", "https") & (F.length(name) > 0) & p["user"].isNull() & p["short"]
        return ok & ~name.isin("localhost", "localhost.localdomain") & ~private_ipv4(name) & ~F.coalesce(private_ipv6(name), F.lit(False))

    parts = F.struct(part(url, "PROTOCOL").alias("protocol"), host(url).alias("host"), part(url, "USERINFO").alias("user"), (F.length(url) <= limit).alias("short"))
    return F.coalesce(once(parts, good), F.lit(False))


def valid_result_url(url: Column) -> Column:
    """A search result's address: http or https, a host, no credentials; private hosts may stay."""
    return F.coalesce(part(url, "PROTOCOL").isin("http", "https") & (F.length(part(url, "HOST")) > 0) & part(url, "USERINFO").isNull(), F.lit(False))


def service_url(url: Column, allow_remote: bool = False) -> tuple[Column, Column]:
    """(address, error): the trimmed base address, or why it is refused."""
    value = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "/+$", "")
    name = host(value)
    loopback = (name == "localhost") | name.rlike(r"^127\.") | (name == "[::1]")
    whole = part(value, "PROTOCOL").isin("http", "https") & (F.length(name) > 0)
    rules = (
        ("incomplete", ~F.coalesce(whole, F.lit(False))),
        ("extra parts", part(value, "USERINFO").isNotNull() | part(value, "QUERY").isNotNull() | part(value, "REF").isNotNull()),
        ("plain http", (part(value, "PROTOCOL") == "http") & ~loopback & F.lit(not allow_remote)),
    )
    error = cascade(rules, F.lit(None).cast("string"))
    return F.when(error.isNull(), value), error


def source_label(url: Column) -> Column:
    """Kind and host of a source, such as 'Publisher — example.org'."""
    name = F.regexp_replace(F.coalesce(host(url), F.lit("unknown source")), r"^www\.", "")
    # Kinds and what a host's name holds, in order.
    kinds = (
        ("Library catalog", ("worldcat", "loc.gov", "library", "catalog")),
        ("Bibliographic registry", ("isbn", "crossref")),
        ("Retailer", ("amazon", "barnesandnoble", "kobo", "bookshop")),
        ("Publisher", ("penguin", "harpercollins", "simonandschuster", "macmillan", "publisher")),
    )
    kind = cascade(tuple((label, contains_any(name, words)) for label, words in kinds), F.lit("Web source"))
    return F.concat(kind, F.lit(" — "), name)
