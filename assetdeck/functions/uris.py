"""URI parsing and access-plan pieces (SCL-11, SCL-12, SCL-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GCS_BUCKET_PATTERN, GCS_PREFIX_PATTERN

# scheme, then '//' authority, then path up to '?' or '#'
URI_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uri_scheme(uri: Column | str) -> Column:
    """Lower-cased scheme; empty string when the URI has none."""
    return F.lower(F.regexp_extract(_c(uri), URI_PATTERN, 1))


def uri_netloc(uri: Column | str) -> Column:
    return F.regexp_extract(_c(uri), URI_PATTERN, 3)


def uri_path(uri: Column | str) -> Column:
    return F.regexp_extract(_c(uri), URI_PATTERN, 4)


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def gcs_bucket(uri: Column | str) -> Column:
    return uri_netloc(uri)


def gcs_prefix(uri: Column | str) -> Column:
    """Path without any leading slashes; query and fragment dropped."""
    return F.regexp_replace(uri_path(uri), r"^/+", "")


def gcs_uri_error(uri: Column | str) -> Column:
    """NULL for a usable ``gs://bucket[/prefix]`` URI, else the reason."""
    u = _c(uri)
    return gcs_parts_error(u, uri_scheme(u), gcs_bucket(u), gcs_prefix(u))


def gcs_parts_error(uri: Column, scheme: Column, bucket: Column, prefix: Column) -> Column:
    """``gcs_uri_error`` where the URI has been parsed before."""
    return (
        F.when((scheme != "gs") | (bucket == ""),
               F.concat(F.lit("Invalid GCS URI "), _quoted(uri), F.lit(": expected format gs://bucket[/prefix]")))
        .when(~bucket.rlike(GCS_BUCKET_PATTERN), F.concat(F.lit("Invalid GCS bucket name: "), _quoted(bucket)))
        .when((prefix != "") & ~prefix.rlike(GCS_PREFIX_PATTERN), F.concat(F.lit("Invalid GCS prefix: "), _quoted(prefix)))
    )


def prefix_condition(bucket: Column | str, prefix: Column | str) -> Column:
    """Access-boundary condition: a plain string prefix on the object name."""
    return F.concat(F.lit("resource.name.startsWith('projects/_/buckets/"), _c(bucket), F.lit("/objects/"), _c(prefix), F.lit("')"))
