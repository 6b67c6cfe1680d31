"""Registration-request rules (SCL-05, PRJ-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import name_error
from ..functions.properties import is_object, normalize_properties


def request_errors(table_request: bool | Column = False) -> Column:
    """Array of request-level errors (NULLs dropped), in checking order."""
    is_table = table_request if isinstance(table_request, Column) else F.lit(bool(table_request))
    checks = [
        F.when(F.col("datastack").isNull(), F.lit("datastack is required")),
        name_error("name"),
        F.when(F.col("uri").isNull(), F.lit("uri is required")),
        F.when(F.col("asset_type").isNull() & ~is_table, F.lit("asset_type is required")),
        F.when(F.col("is_managed").isNull(), F.lit("is_managed is required")),
        F.when(F.coalesce(F.col("revision"), F.lit(0)) < 0, F.lit("revision must be >= 0")),
        F.when(~F.coalesce(F.col("mutability"), F.lit(S.DEFAULT_MUTABILITY)).isin(*S.MUTABILITY_VALUES),
               F.concat(F.lit("mutability must be one of: "), F.lit(", ".join(S.MUTABILITY_VALUES)))),
        F.when(~F.coalesce(F.col("maturity"), F.lit(S.DEFAULT_MATURITY)).isin(*S.MATURITY_VALUES),
               F.concat(F.lit("maturity must be one of: "), F.lit(", ".join(S.MATURITY_VALUES)))),
        F.when(F.col("properties").isNotNull() & ~is_object("properties"), F.lit("properties must be an object")),
        F.when(is_table & F.col("format").isNull(), F.lit("format is required for tables")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def with_request_check(candidates: DataFrame, table_request: bool | Column = False) -> DataFrame:
    return candidates.withColumn("request_errors", request_errors(table_request)).withColumn("request_valid", F.size("request_errors") == 0)


def registration_row(raw: DataFrame) -> DataFrame:
    """Form text -> candidate row: trim, blank -> NULL, integer parse with error, bad JSON -> ``{}``.

    JSON that is no object and an expiry that is no timestamp are left for the request check to reject: the first is
    kept as it is, the second is the form's last error."""
    def blank_null(c):
        t = F.trim(F.col(c))
        return F.when(t != "", t)

    mv_txt, rev_txt = blank_null("mat_version"), blank_null("revision")
    mv, rev = mv_txt.try_cast("int"), rev_txt.try_cast("int")
    expires = blank_null("expires_at").try_cast("timestamp")
    error = (
        F.when(blank_null("uri").isNull() | blank_null("name").isNull() | blank_null("datastack").isNull(),
               F.lit("URI, name, and datastack are required."))
        .when(mv_txt.isNotNull() & mv.isNull(), F.lit("Mat version must be an integer."))
        .when(rev_txt.isNotNull() & rev.isNull(), F.lit("Revision must be an integer."))
        .when(blank_null("expires_at").isNotNull() & expires.isNull(), F.lit("Expires at must be a timestamp."))
    )
    return raw.select(
        "*",
        blank_null("datastack").alias("n_datastack"),
        blank_null("name").alias("n_name"),
        blank_null("uri").alias("n_uri"),
        F.coalesce(blank_null("format"), F.lit("delta")).alias("n_format"),
        mv.alias("n_mat_version"),
        F.coalesce(rev, F.lit(0)).alias("n_revision"),
        F.coalesce(blank_null("mutability"), F.lit(S.DEFAULT_MUTABILITY)).alias("n_mutability"),
        F.coalesce(blank_null("maturity"), F.lit(S.DEFAULT_MATURITY)).alias("n_maturity"),
        (F.col("is_managed") == "true").alias("n_is_managed"),
        blank_null("access_group").alias("n_access_group"),
        normalize_properties("properties").alias("n_properties"),
        expires.alias("n_expires_at"),
        error.alias("form_error"),
    )
