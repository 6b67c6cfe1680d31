"""Registration checks over a batch of candidates (JON-01 .. JON-05, PIP-01 .. PIP-04, AGG-04).

Every check is a column pair ``<check>_passed`` / ``<check>_message``
(``NULL`` passed = not run).  Checks against the store are equality left
joins: the store side is unique on the join key, so each candidate gets at
most one match, and a hot candidate key is split by AQE's skew join.
Reference data (``mat_objects``) is a small dimension: broadcast after a
bounded size probe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name, name_error
from ..functions.properties import is_materialization_source, property_get
from .joins import maybe_broadcast

KEY = ["datastack", "name", "revision"]


def find_duplicate(cands: DataFrame, assets: DataFrame, out: str = "dup_id") -> DataFrame:
    """JON-01: existing asset with the same (datastack, name, revision) and NULL-safe equal
    mat_version; expired assets count."""
    zero = F.lit(0)  # an unset revision is revision 0
    key = {k: F.coalesce(F.col(k), zero) if k == "revision" else F.col(k) for k in KEY}
    a = assets.select(*[key[k].alias(f"_a_{k}") for k in KEY], F.col("mat_version").alias("_a_mv"), F.col("id").alias(out))
    cond = [key[k] == F.col(f"_a_{k}") for k in KEY] + [F.col("mat_version").eqNullSafe(F.col("_a_mv"))]
    return cands.join(a, cond, "left").drop(*[f"_a_{k}" for k in KEY], "_a_mv")


def find_by_uri(cands: DataFrame, assets: DataFrame, out: str = "uri_dup_id") -> DataFrame:
    """JON-02: existing asset with the same URI (expired ones count)."""
    a = assets.select(F.col("uri").alias("_a_uri"), F.col("id").alias(out))
    return cands.join(a, F.col("uri") == F.col("_a_uri"), "left").drop("_a_uri")


def unique_both(cands: DataFrame, assets: DataFrame) -> DataFrame:
    """JON-03: ``unique_status`` duplicate / duplicate_uri / ok - the key conflict is reported first."""
    c = find_by_uri(find_duplicate(cands, assets), assets)
    status = F.when(F.col("dup_id").isNotNull(), "duplicate").when(F.col("uri_dup_id").isNotNull(), "duplicate_uri").otherwise("ok")
    return c.withColumn("unique_status", status)


def _covered(mat: DataFrame) -> DataFrame:
    return maybe_broadcast(mat.select("datastack").distinct().withColumn("_covered", F.lit(True)))


def name_reservation(cands: DataFrame, mat: DataFrame, honor_source: bool = True) -> DataFrame:
    """JON-04: the base name (before the first dot) of a current reference table of the
    datastack is reserved, unless ``properties.source`` is ``materialization``.
    No reference data for the datastack -> skipped (pass, fail-open)."""
    current = maybe_broadcast(mat.where((F.col("object_type") == "table") & F.col("is_current"))
                              .select("datastack", F.col("object_name").alias("_base")).distinct()
                              .withColumn("_reserved", F.lit(True)))
    c = cands.withColumn("_base", base_name("name"))
    c = c.join(_covered(mat), "datastack", "left").join(current, ["datastack", "_base"], "left")
    mat_src = is_materialization_source("properties") if honor_source else F.lit(False)
    reserved = F.coalesce(F.col("_reserved"), F.lit(False)) & ~mat_src
    skipped = F.col("_covered").isNull()
    return c.withColumn("reservation_passed", skipped | ~reserved).withColumn(
        "reservation_message",
        F.when(skipped, F.concat(F.lit("name_reservation skipped: no reference data for datastack '"), F.col("datastack"), F.lit("'")))
        .when(reserved, F.concat(F.lit("Name '"), F.col("name"), F.lit(
            "' is reserved for materialization. Use properties.source='materialization' with admin/service permission to register."))),
    ).drop("_base", "_covered", "_reserved")


def mat_table_verify(cands: DataFrame, mat: DataFrame, configured: bool = True) -> DataFrame:
    """JON-05: only for ``properties.source = 'materialization'``: needs ``source_table`` and
    ``mat_version``; the version must exist for the datastack and the table at it.
    No reference data for the datastack -> fail (closed).  Where the reference service is not ``configured`` at all,
    such candidates pass with a message."""
    if not configured:
        mine = is_materialization_source("properties")
        return cands.withColumn("matverify_passed", F.when(mine, F.lit(True))).withColumn(
            "matverify_message", F.when(mine, F.lit("Materialization check skipped: no reference service is configured")))
    src_table = property_get("properties", "source_table")
    src_version = property_get("properties", "mat_version", "int")
    versions = maybe_broadcast(mat.select("datastack", F.col("version").alias("_v")).distinct().withColumn("_v_ok", F.lit(True)))
    tables = maybe_broadcast(mat.where(F.col("object_type") == "table")
                             .select("datastack", F.col("version").alias("_v"), F.col("object_name").alias("_t")).distinct()
                             .withColumn("_t_ok", F.lit(True)))
    # the other two are read from the text only where the first asks for them
    c = cands.withColumn("_is_mat", is_materialization_source("properties"))
    c = c.withColumn("_t", F.when(F.col("_is_mat"), src_table)).withColumn("_v", F.when(F.col("_is_mat"), src_version))
    c = c.join(_covered(mat), "datastack", "left").join(versions, ["datastack", "_v"], "left").join(tables, ["datastack", "_v", "_t"], "left")
    msg = (
        F.when(~F.col("_is_mat"), F.lit(None).cast("string"))
        .when(F.coalesce(F.col("_t"), F.lit("")) == "", F.lit(
            "properties.source_table and properties.mat_version are required when source='materialization'"))
        .when(F.col("_v").isNull(), F.lit(
            "properties.source_table and properties.mat_version are required when source='materialization'"))
        .when(F.col("_covered").isNull(), F.concat(F.lit("Failed to reach MaterializationEngine: no reference data for datastack '"),
                                                   F.col("datastack"), F.lit("'")))
        .when(F.col("_v_ok").isNull(), F.concat(F.lit("Version "), F.col("_v").cast("string"), F.lit(" not found for datastack '"),
                                                F.col("datastack"), F.lit("' in MaterializationEngine")))
        .when(F.col("_t_ok").isNull(), F.concat(F.lit("Mat table '"), F.col("_t"), F.lit("' at version "), F.col("_v").cast("string"),
                                                F.lit(" not found in MaterializationEngine")))
    )
    judged = c.withColumn("_msg", msg).drop("_t", "_v", "_covered", "_v_ok", "_t_ok")
    return judged.withColumn("matverify_passed", F.when(F.col("_is_mat"), F.col("_msg").isNull())).withColumn(
        "matverify_message", F.col("_msg")).drop("_is_mat", "_msg")


def uri_reachable(cands: DataFrame, storage: DataFrame) -> DataFrame:
    """SRC-11 against a storage inventory ``(uri, actual_format, error)``, as ``extract.inventory`` reads it.

    A row with an ``error`` (an inventory may lack the column) stands for storage that cannot be reached."""
    error = F.col("error") if "error" in storage.columns else F.lit(None).cast("string")
    s = storage.select(F.col("uri").alias("_s_uri"), F.col("actual_format").alias("_actual"), error.alias("_s_error")).distinct()
    c = cands.join(s, F.col("uri") == F.col("_s_uri"), "left")
    found = F.col("_s_uri").isNotNull() & F.col("_s_error").isNull()
    message = F.when(F.col("_s_error").isNotNull(), F.concat(F.lit("URI unreachable: "), F.col("_s_error"))).when(
        ~found, F.concat(F.lit("URI does not exist: "), F.col("uri")))
    return c.withColumn("reachable_passed", found).withColumn("reachable_message", message).drop("_s_uri", "_s_error")


def format_sniff(cands: DataFrame) -> DataFrame:
    """SRC-14 after ``uri_reachable`` (uses its ``_actual``): NULL format or a format without a
    sniffer passes with a message; parquet/delta must be readable as that format."""
    fmt = F.lower(F.col("format"))
    label = F.when(fmt == "parquet", F.lit("Parquet")).otherwise(F.lit("Delta"))
    reason = F.when(F.col("_actual").isNull(), F.lit("path not found")).otherwise(F.concat(F.lit("not a "), fmt, F.lit(" table")))
    ok_fmt = F.col("_actual") == fmt
    msg = (
        F.when(F.col("format").isNull(), F.lit("No format specified; skipping sniff"))
        .when(~fmt.isin("parquet", "delta"), F.concat(F.lit("No sniffer registered for format '"), F.col("format"), F.lit("'")))
        .when(~F.coalesce(ok_fmt, F.lit(False)), F.concat(label, F.lit(" sniff failed: "), reason))
    )
    passed = F.col("format").isNull() | ~fmt.isin("parquet", "delta") | F.coalesce(ok_fmt, F.lit(False))
    return cands.withColumn("sniff_passed", passed).withColumn("sniff_message", msg).drop("_actual")


def content_checks(cands: DataFrame, mat: DataFrame, storage: DataFrame) -> DataFrame:
    """PIP-01: reservation, reachability, sniff and conditional mat verify; all run."""
    c = name_reservation(cands, mat)
    c = format_sniff(uri_reachable(c, storage))
    return mat_table_verify(c, mat)


CHECKS = ["auth", "dup", "uri", "reservation", "reachable", "sniff", "matverify"]


def validate_report(cands: DataFrame, assets: DataFrame, mat: DataFrame, storage: DataFrame, allowed_col: str = "allowed") -> DataFrame:
    """PIP-02: auth failure stops the report; otherwise key, URI and content checks all run."""
    c = unique_both(cands, assets)
    c = content_checks(c, mat, storage)
    auth = F.col(allowed_col)
    out = c.withColumn("auth_passed", auth).withColumn(
        "auth_message", F.when(~auth, F.concat(F.lit("Write permission required on datastack '"), F.col("datastack"), F.lit("'"))))
    out = out.withColumn("dup_passed", F.when(auth, F.col("dup_id").isNull())).withColumn(
        "uri_passed", F.when(auth, F.col("uri_dup_id").isNull())).withColumn(
        "uri_message", F.when(auth & F.col("uri_dup_id").isNotNull(), F.lit("URI is already registered to another asset")))
    for chk in ("reservation", "reachable", "sniff", "matverify"):
        out = out.withColumn(f"{chk}_passed", F.when(auth, F.col(f"{chk}_passed"))).withColumn(
            f"{chk}_message", F.when(auth, F.col(f"{chk}_message")))
    out = out.withColumn("dup_id", F.when(auth, F.col("dup_id"))).withColumn("uri_dup_id", F.when(auth, F.col("uri_dup_id")))
    return failed_checks(out)


def failed_checks(report: DataFrame) -> DataFrame:
    """AGG-04: names of the checks that ran and failed; any failure rejects."""
    names = F.array(*[F.when(F.col(f"{c}_passed") == F.lit(False), F.lit(c)) for c in CHECKS])
    failed = F.filter(names, lambda x: x.isNotNull())
    return report.withColumn("failed", F.array_join(failed, ",")).withColumn("rejected", F.size(failed) > 0)


def check_name(requests: DataFrame, assets: DataFrame, mat: DataFrame) -> DataFrame:
    """PIP-03: invalid_format, then reserved, then duplicate, else available."""
    r = requests.withColumn("_fmt_err", name_error("name"))
    r = name_reservation(r, mat, honor_source=False)
    r = find_duplicate(r, assets)
    reason = (F.when(F.col("_fmt_err").isNotNull(), "invalid_format").when(~F.col("reservation_passed"), "reserved")
              .when(F.col("dup_id").isNotNull(), "duplicate"))
    return r.select(
        *requests.columns,
        reason.isNull().alias("available"),
        reason.alias("reason"),
        F.when(F.col("_fmt_err").isNotNull(), F.col("_fmt_err")).alias("message"),
        F.when(reason == "duplicate", F.col("dup_id")).alias("existing_id"),
    )


def check_uri(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """PIP-04: duplicate_uri with the existing id, else available."""
    r = find_by_uri(requests, assets)
    return r.select(*requests.columns, F.col("uri_dup_id").isNull().alias("available"),
                    F.when(F.col("uri_dup_id").isNotNull(), F.lit("duplicate_uri")).alias("reason"),
                    F.col("uri_dup_id").alias("existing_id"))
