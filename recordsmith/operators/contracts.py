"""Closed contracts of research responses: JSON bodies against exact keys, types, counts and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, valid_partial_date
from ..functions.urls import valid_evidence_url
from ..sources.staging import staged
from .review import FIELDS

# The keys, the levels of confidence, and the most of everything.
MATCH_KEYS, FIELD_KEYS, CONFIDENCES = ("candidate_identity", "edition_confidence", "rationale"), ("confidence", "evidence_urls", "inferred", "value"), ("high", "medium", "low")
MOST_URLS, SHORT_TEXT, RATIONALE, COMMENTS, AUTHORS, TAGS, IDENTIFIERS, IDENTIFIER, SERIES_INDEX = 10, 1000, 4000, 30_000, 50, 100, 50, 512, 100_000
IDENTIFIER_TYPE = r"^[a-z0-9][a-z0-9._-]{0,31}\z"

_EMPTY, _NULL, _TEXT, _TEXTS = "ARRAY<VOID>", "VOID", "STRING", "ARRAY<STRING>"


def _kind(v: Column) -> Column:
    """The type of a JSON value; '' where it is missing."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _get(v: Column, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$", kind)


def _object(v: Column) -> Column:
    """The members of a JSON object by key; null where the value is none."""
    return _get(v, "map<string,variant>")


def _member(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _has_keys(m: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(m)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def _text(v: Column, most: int) -> Column:
    return (_kind(v) == _TEXT) & F.coalesce(F.length(_get(v)) <= most, F.lit(False))


def _all_of(v: Column, kind: str, good: Callable[[Column], Column], most: int) -> Column:
    """A list of at most so many good elements."""
    items = _get(v, kind)
    return F.coalesce((F.size(items) <= most) & F.forall(items, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def parsed(df: DataFrame, column: str, fields: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """df with the parts of a JSON body as columns, and these by name: body, match, fields and each of `fields`.

    The body is parsed once, and every object taken apart once: each step is a
    projection that the next one reads many times, so the optimizer keeps them apart.
    """
    free = lambda n: f"_{n}" if f"_{n}" not in df.columns else free(f"{n}_")
    body, match, inner = free("body"), free("match"), free("fields")
    names = {f: free(f"field_{f}") for f in fields}
    out = df.withColumn(body, F.try_parse_json(column))
    top = _object(F.col(body))
    out = out.withColumns({match: _object(_member(top, "match")), inner: _object(_member(top, "fields"))})
    out = out.withColumns({n: _object(_member(F.col(inner), f)) for f, n in names.items()})
    return out, {"body": F.col(body), "match": F.col(match), "fields": F.col(inner)} | {f: F.col(n) for f, n in names.items()}


def _value(v: Column, name: str) -> Column:
    """Whether the value of a field has its type and keeps its limits; null is always good."""
    kind = _kind(v)
    if name in ("authors", "tags"):
        listed = kind.isin(_TEXTS, _EMPTY) & _all_of(v, "array<string>", lambda x: F.length(x) <= SHORT_TEXT, AUTHORS if name == "authors" else TAGS)
    elif name == "identifiers":
        each = lambda x: x["type"].rlike(IDENTIFIER_TYPE) & (F.length(x["value"]) <= IDENTIFIER)
        listed = kind.isin("ARRAY<OBJECT<type: STRING, value: STRING>>", _EMPTY) & _all_of(v, "array<struct<type: string, value: string>>", each, IDENTIFIERS)
    elif name == "series":
        index = F.try_variant_get(v, "$.index", "double")
        placed = kind.startswith("OBJECT<index: VOID") | index.between(0, SERIES_INDEX)
        listed = kind.rlike(r"^OBJECT<index: (VOID|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)), name: STRING>$") & (F.length(F.try_variant_get(v, "$.name", "string")) <= SHORT_TEXT) & placed
    elif name == "published_date":
        listed = (kind == _TEXT) & valid_partial_date(_get(v))
    else:
        listed = _text(v, COMMENTS if name == "comments" else SHORT_TEXT)
    return (kind == _NULL) | F.coalesce(listed, F.lit(False))


def _field_errors(m: Column, name: str, most_urls: int) -> Column:
    """The errors of one field: only that it is no object, or all that is wrong with it."""
    say = lambda bad, what: F.when(bad, f"fields.{name} {what}")
    confidence, cited = _member(m, "confidence"), _member(m, "evidence_urls")
    urls = _get(cited, "array<string>")
    listed = _kind(cited).isin(_TEXTS, _EMPTY) & F.coalesce(F.forall(urls, lambda u: F.coalesce(valid_evidence_url(u), F.lit(False))), F.lit(False))
    inner = (
        say(~_has_keys(m, FIELD_KEYS), "keys"),
        say(~((_kind(confidence) == _TEXT) & F.coalesce(_get(confidence).isin(*CONFIDENCES), F.lit(False))), "confidence"),
        F.when(~listed, f"fields.{name} evidence_urls").when(F.size(urls) > most_urls, f"fields.{name} evidence_urls count"),
        say(_kind(_member(m, "inferred")) != "BOOLEAN", "inferred"),
        say(~_value(_member(m, "value"), name), "value"),
    )
    return F.when(m.isNull(), F.array(F.lit(f"fields.{name} object"))).otherwise(F.array_compact(F.array(*inner)))


def with_errors(df: DataFrame, column: str, requested: tuple[str, ...] = FIELDS, most_urls: int = MOST_URLS) -> DataFrame:
    """df with `errors`: all errors of a response body, never only the first; an empty array for a good one.

    The key sets of the response, its match, its fields and each field are
    exact; every value has the type, count and length of its kind. A body that
    is no JSON object, or repeats a key, has that one error.
    """
    out, part = parsed(df, column, requested)
    most, match, fields = max(1, min(MOST_URLS, most_urls)), part["match"], part["fields"]
    sure = _member(match, "edition_confidence")
    matched = (
        F.when(~_has_keys(match, MATCH_KEYS), "match keys"),
        F.when(~((_kind(sure) == _TEXT) & F.coalesce(_get(sure).isin(*CONFIDENCES), F.lit(False))), "match edition_confidence"),
        F.when(~_text(_member(match, "candidate_identity"), SHORT_TEXT), "match candidate_identity"),
        F.when(~_text(_member(match, "rationale"), RATIONALE), "match rationale"),
    )
    inside = F.concat(F.array_compact(F.array(F.when(~_has_keys(fields, requested), "fields keys"))), *[_field_errors(part[f], f, most) for f in requested])
    whole = F.concat(
        F.array_compact(F.array(F.when(~_has_keys(_object(part["body"]), ("fields", "match")), "response keys"))),
        F.when(match.isNotNull(), F.array_compact(F.array(*matched))).otherwise(F.array(F.lit("match object"))),
        F.when(fields.isNotNull(), inside).otherwise(F.array(F.lit("fields object"))),
    )
    return out.select(*df.columns, F.when(_object(part["body"]).isNull(), F.array(F.lit("response object"))).otherwise(whole).alias("errors"))


def requested_fields(fields: list[str] | None) -> tuple[str, ...]:
    """The fields in their own order; all where none are named; an unknown name or an empty list is an error."""
    unknown = sorted(set(fields or ()) - set(FIELDS))
    if unknown or fields == []:
        raise ValueError(f"unknown fields: {unknown}" if unknown else "no fields are requested")
    return tuple(f for f in FIELDS if fields is None or f in fields)


def validate_metadata(responses: DataFrame, fields: list[str] | None = None, most_urls: int = MOST_URLS, *, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors) of JSON responses; bodies are judged once and written, then split."""
    checked = staged(with_errors(responses, column, requested_fields(fields), most_urls), "responses")
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def response_fields(accepted: DataFrame, fields: list[str] | None = None, *, key: str = "book_id", column: str = "body") -> DataFrame:
    """(key, field, value, confidence, evidence_urls, inferred) of accepted responses; value is JSON, null where there is none."""
    asked = requested_fields(fields)
    out, part = parsed(accepted.select(key, column), column, asked)
    rows = []
    for name in asked:
        of = lambda k, m=part[name]: _member(m, k)
        value = F.when(_kind(of("value")) != _NULL, F.to_json(of("value")))
        rows.append(F.struct(F.lit(name).alias("field"), value.alias("value"), _get(of("confidence")).alias("confidence"), _get(of("evidence_urls"), "array<string>").alias("evidence_urls"), _get(of("inferred"), "boolean").alias("inferred")))
    return out.select(key, F.explode(F.array(*rows)).alias("f")).select(key, "f.*")


def valid_prompt_review(column: str, most_prompt: int) -> Column:
    """Whether a body is a good review of a prompt: exact keys, and their types and lengths."""

    def good(m: Column) -> Column:
        of = lambda k: _member(m, k)
        issues = _kind(of("issues")).isin(_TEXTS, _EMPTY) & _all_of(of("issues"), "array<string>", lambda x: F.length(x) <= SHORT_TEXT, 100)
        repaired = (_kind(of("repaired_prompt")) == _NULL) | _text(of("repaired_prompt"), most_prompt)
        return _has_keys(m, ("valid", "issues", "repaired_prompt", "change_summary")) & (_kind(of("valid")) == "BOOLEAN") & issues & repaired & _text(of("change_summary"), RATIONALE)

    return once(_object(F.try_parse_json(column)), good)
