"""Lookups into the free-form ``properties`` JSON (SCL-10, PRJ-04 for JSON)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(props: Column | str) -> Column:
    """VARIANT of the properties text; NULL when it is not valid JSON."""
    return F.try_parse_json(_c(props))


def property_get(props: Column | str, path: str, type_: str = "string") -> Column:
    """Value at ``$.a.b`` cast to ``type_``; NULL on bad JSON, missing key or bad cast."""
    return F.try_variant_get(parsed(props), path if path.startswith("$") else "$." + path, type_)


def is_materialization_source(props: Column | str) -> Column:
    return F.coalesce(property_get(props, "source") == "materialization", F.lit(False))


def is_object(props: Column | str) -> Column:
    """Whether the text is a JSON object; false for NULL, other JSON and text that is not JSON."""
    return F.coalesce(F.schema_of_variant(parsed(props)).startswith("OBJECT"), F.lit(False))


def normalize_properties(raw: Column | str) -> Column:
    """Registration form rule: blank -> ``{}``; text that is not JSON -> ``{}``."""
    r = F.trim(_c(raw))
    ok = F.try_parse_json(r).isNotNull() & (r != "")
    return F.when(ok, r).otherwise(F.lit("{}"))
