"""Models, versions and when a source is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, strip

# The shapes of model ids, of dated snapshots and of one family's names.
MODEL_ID = r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}\z"
SNAPSHOT = r"-\d{4}-\d{2}-\d{2}$"
_FAMILY = r"^claude-(opus|sonnet|haiku|fable|mythos)-(\d+)(?:-(\d+))?(?:-|$)"
# What a research model's name does not hold.
EXCLUDED = ("audio", "chat", "codex", "image", "realtime", "search-preview", "transcribe", "tts", "whisper")


def is_model_id(model: Column) -> Column:
    return F.coalesce(strip(model).rlike(MODEL_ID), F.lit(False))


def safe_model_id(model: Column) -> Column:
    """Cut to 128; what looks like a secret or no model id is redacted."""
    value = F.substring(F.coalesce(model, F.lit("unknown")), 1, 128)
    secret = F.lower(value).rlike("^(sk-|sess-)") | ~is_model_id(value)
    return F.when(value.isin("unknown", "not applicable"), value).when(secret, "[REDACTED_INVALID_MODEL]").otherwise(value)


def _version(model: Column) -> tuple[Column, Column, Column]:
    """(family, major, minor) of a family model; null where the name is another."""
    name = F.lower(strip(model))
    text = lambda i: F.nullif(F.regexp_extract(name, _FAMILY, i), F.lit(""))
    return text(1), text(2).try_cast("int"), text(3).try_cast("int")


def is_research_model(model: Column, provider: Column) -> Column:
    """Models that may do research: rule by prefix for one family, by version for the other."""
    name = F.lower(model)
    gpt = is_model_id(model) & ~model.rlike(SNAPSHOT) & name.startswith("gpt-") & ~contains_any(name, EXCLUDED)
    family, major, minor = _version(model)
    claude = (major >= 5) | ((major == 4) & (minor >= 5) & family.isin("opus", "sonnet", "haiku"))
    return F.coalesce(F.when(provider == "anthropic", claude).otherwise(gpt), F.lit(False))


def supports_effort(model: Column) -> Column:
    family, major, minor = _version(model)
    return F.coalesce((major >= 5) | ((major == 4) & (((family == "opus") & (minor >= 5)) | ((family == "sonnet") & (minor >= 6)))), F.lit(False))


def filter_research_models(catalog: DataFrame) -> DataFrame:
    return catalog.where(is_research_model(F.col("model"), F.col("provider")))


def catalog_union(*parts: DataFrame) -> DataFrame:
    """Distinct research models (provider, model) of all parts."""
    out = parts[0].select("provider", "model")
    for p in parts[1:]:
        out = out.union(p.select("provider", "model"))
    return filter_research_models(out).distinct()


def distinct_models(df: DataFrame) -> DataFrame:
    return df.select(strip(F.col("model")).alias("model")).where(is_model_id(F.col("model"))).distinct().orderBy("model")


def catalog_order(models: DataFrame, default: str, most: int = 200) -> DataFrame:
    """The default first, then by folded name; a top-k with its position."""
    first = models.orderBy(F.col("model") != default, F.lower("model"), "model").limit(most)
    return first.select("model", (F.col("model") == default).alias("is_default"))


def unavailable_models(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected (provider, model) pairs that the provider does not list."""
    return selected.select("provider", "model").distinct().join(catalog, ["provider", "model"], "left_anti")


def refresh_due(last: Column, now: Column, enabled: Column, hours: float = 24.0) -> Column:
    """Due when never tried, when the clock went back, on unusable values, or after `hours`; never when disabled."""
    t = last.try_cast("double")
    unusable = t.isNull() | F.isnan(t) | t.isin(float("inf"), float("-inf"))
    return enabled & F.coalesce(unusable | (now < t) | (now - t >= hours * 3600), F.lit(True))


def _finite(value: Column) -> Column:
    """A number that can be reckoned with, else null."""
    t = value.try_cast("double")
    return F.when(~F.isnan(t) & ~t.isin(float("inf"), float("-inf")), t)


def cache_is_fresh(fetched: Column, models: Column, now: Column, days: float = 7.0) -> Column:
    """True for a list with models that was fetched less than `days` ago, and not in the future; no time counts as the epoch."""
    age = now - F.coalesce(_finite(fetched), F.when(fetched.isNull(), 0.0))
    return F.coalesce((F.size(models) > 0) & (age >= 0) & (age < days * 86400), F.lit(False))


def reminder_due(version: Column, skipped: Column, reminded: Column, remind_after: Column, now: Column) -> Column:
    """Whether to tell of a version: never if it is skipped; if the reminder is for another version or has no usable time; else from its time on."""
    at = F.when(remind_after.isNull(), 0.0).otherwise(_finite(remind_after))
    due = F.when(reminded.eqNullSafe(version), F.coalesce(at <= now, F.lit(True))).otherwise(True)
    return ~skipped.eqNullSafe(version) & due


def known_update_available(known: Column, minimum: Column, current: Column, host: Column) -> Column:
    """Whether a remembered version is newer than the current one and runs on the host; invalid versions are none."""
    k, m, c, h = (parse_version(x) for x in (known, minimum, current, host))
    return F.coalesce((k > c) & (h >= m), F.lit(False))


def parse_version(text: Column) -> Column:
    """Struct of three numbers, null unless there are exactly three of at most 999999."""
    shaped = (F.length(text) <= 32) & text.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)\z")
    n = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    good = shaped & F.forall(n, lambda x: x.isNotNull() & (x <= 999999))
    return F.when(good, F.struct(*[F.get(n, F.lit(i)).alias(k) for i, k in enumerate(("major", "minor", "patch"))]))


def classify_version(current: Column, offered: Column, minimum: Column, host: Column) -> Column:
    """incompatible, available or current, by numbers and not by text; null where a version is invalid."""
    c, o, m, h = (parse_version(x) for x in (current, offered, minimum, host))
    known = c.isNotNull() & o.isNotNull() & m.isNotNull() & h.isNotNull()
    return F.when(known, F.when(h < m, "incompatible").when(o > c, "available").otherwise("current"))
