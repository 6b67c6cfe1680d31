"""Row changes producing the next asset snapshot (SNK-03, SNK-04, SNK-05, SNK-06).

Each function is ``snapshot -> (new snapshot, per-request status)``; the
caller writes the new snapshot to a new folder (``sources.store``).
Column annotations are kept in long form (one row per asset and position),
so replacing a list never gathers an asset's annotations into one row.  All of
them are equality joins on ``id``; several requests for the same id take effect
in request order, each with its own status row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import access as AC
from . import annotations as AN
from .predicates import is_expired

PATCHABLE = ("maturity", "access_group", "expires_at")


def partition_columns(extracted: DataFrame) -> Column:
    """The partition columns an extraction found; an empty list where it reports none."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.col("partition_columns"), empty) if "partition_columns" in extracted.columns else empty


def _may_edit(requests: DataFrame, permissions: DataFrame | None, users: DataFrame | None) -> DataFrame:
    """Adds ``allowed``: ``edit`` (or ``admin``) on ``datastack`` for ``user_id``; without permissions nothing is checked."""
    return AC.datastack_permission(requests, permissions, users, "edit", auth_enabled=permissions is not None)


def patch_assets(assets: DataFrame, patches: DataFrame, now, order: str = "request_id", permissions: DataFrame | None = None,
                 users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-03: only maturity, access_group, expires_at.  Per field ``<f>_set`` says whether it
    was sent: unset keeps, explicit NULL clears.  Missing or expired -> not_found; an explicit
    NULL or unknown maturity -> invalid (no change).  With ``permissions`` and ``users``, a request whose ``user_id``
    may not edit the asset's datastack is forbidden (after not_found, before invalid).

    All requests of an id apply in the order of the (unique) ``order`` column: per field the last valid request
    that sets it wins, and the first one whose ``expires_at`` lies in the past makes the later ones not_found.
    Returns (next snapshot, one status row per request)."""
    p = patches
    target = assets.select("id", "datastack", is_expired(now).alias("_expired"))
    st = _may_edit(p.join(target, "id", "left"), permissions, users).select(
        "id", *[c for c in p.columns if c != "id"],
        F.when(F.col("_expired").isNull() | F.col("_expired"), F.lit("not_found"))
        .when(~F.col("allowed"), F.lit("forbidden"))
        .when(F.col("maturity_set") & (F.col("maturity").isNull() | ~F.col("maturity").isin(*S.MATURITY_VALUES)), F.lit("invalid"))
        .otherwise(F.lit("updated")).alias("status"))
    ends = st.where((F.col("status") == "updated") & F.col("expires_at_set") & is_expired(now)).groupBy("id").agg(
        F.min(order).alias("_end"))
    st = st.join(ends, "id", "left").withColumn(
        "status", F.when(F.col(order) > F.col("_end"), F.lit("not_found")).otherwise(F.col("status"))).drop("_end")
    sent = {f: F.when(F.col(f"{f}_set"), F.col(order)) for f in PATCHABLE}
    ok = st.where(F.col("status") == "updated").groupBy("id").agg(
        *[F.max(sent[f]).isNotNull().alias(f"_{f}_set") for f in PATCHABLE],
        *[F.max_by(F.col(f), sent[f]).alias(f"_{f}") for f in PATCHABLE])
    j = assets.join(ok, "id", "left")
    out = j.select(*[
        F.when(F.coalesce(F.col(f"_{c}_set"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in PATCHABLE else F.col(c)
        for c in assets.columns])
    return out, st.select("id", order, "status")


def delete_assets(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK-06: remove by id (expired ones too)."""
    return assets.join(ids.select("id").distinct(), "id", "left_anti")


def delete_requests(assets: DataFrame, requests: DataFrame, permissions: DataFrame | None = None, users: DataFrame | None = None,
                    order: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """SNK-06 per request (``id``, ``user_id`` and the unique ``order``): not_found, forbidden or deleted.

    Expired assets can be deleted.  Of several permitted requests for one id the first deletes it, and every later
    request finds nothing.  Returns (next snapshot, one status row per request)."""
    r = _may_edit(requests.join(assets.select("id", "datastack"), "id", "left"), permissions, users)
    first = r.where(F.col("datastack").isNotNull() & F.col("allowed")).groupBy("id").agg(F.min(order).alias("_first"))
    status = (F.when(F.col("datastack").isNull() | (F.col(order) > F.col("_first")), F.lit("not_found"))
              .when(~F.col("allowed"), F.lit("forbidden")).otherwise(F.lit("deleted")))
    return delete_assets(assets, first), r.join(first, "id", "left").select("id", order, status.alias("status"))


def replace_annotations(assets: DataFrame, annotations: DataFrame, updates: DataFrame, new_ann: DataFrame, mat: DataFrame,
                        now, order: str | None = None, permissions: DataFrame | None = None,
                        users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-04: replace the whole annotation list of each requested table after the checks.

    Annotations are stored in long form (``annotations``: one row per asset and
    position), so a replacement is an anti-join of the old rows plus a union of the
    new ones - no per-asset list is ever collected.  ``updates(id)`` lists the
    requests; ``new_ann`` holds their annotations keyed by ``asset_id`` (none =
    clear).  With ``order``, a column of both that numbers the requests, a table may have several: each
    is checked on its own and the list of the last valid one stays.
    A malformed kind -> invalid_request; missing or expired -> not_found, non-table
    -> not_table; with ``permissions`` and ``users``, no ``edit`` for the request's ``user_id`` -> forbidden (requests
    of one number by several users count once, by the least id);
    kind target, point group or dtype failures -> rejected, unchanged.
    Returns (next annotation table, per-request status)."""
    number = F.col(order).cast("long") if order else F.lit(0).cast("long")
    key = lambda asset: F.concat_ws("\u0001", F.col(asset), F.col("_order").cast("string"))
    req = updates.select("id", number.alias("_order"), *(["user_id"] if permissions is not None else []))
    req = req.distinct() if permissions is None else req.groupBy("id", "_order").agg(F.min("user_id").alias("user_id"))
    tgt = assets.withColumn("_expired", is_expired(now))
    r = _may_edit(req.join(tgt, "id", "left").withColumn("_key", key("id")), permissions, users)
    # the checks see each request as an asset of its own
    asked = r.drop("id", "allowed", "user_id").withColumnRenamed("_key", "id").drop("_order")
    a = new_ann.withColumn("_order", number).withColumn("_asset", F.col("asset_id")).withColumn("asset_id", key("asset_id")).join(
        req.select(key("id").alias("asset_id")), "asset_id", "left_semi")
    cols = AN.explode_columns(asked)
    bad = (AN.kind_target_check(a, asked, mat).select("asset_id")
           .unionByName(AN.point_group_uniqueness(a).select("asset_id"))
           .unionByName(AN.kind_dtype_check(a, cols).select("asset_id"))).distinct().withColumn("_bad", F.lit(True))
    malformed = AN.invalid_kinds(a).select("asset_id").distinct().withColumn("_malformed", F.lit(True))
    st = (r.select("id", "_order", "_key", "asset_type", "_expired", "allowed")
          .join(bad.withColumnRenamed("asset_id", "_key"), "_key", "left")
          .join(malformed.withColumnRenamed("asset_id", "_key"), "_key", "left"))
    status = (F.when(F.col("_malformed"), F.lit("invalid_request"))
              .when(F.col("asset_type").isNull() | F.col("_expired"), F.lit("not_found"))
              .when(F.col("asset_type") != "table", F.lit("not_table"))
              .when(~F.col("allowed"), F.lit("forbidden"))
              .when(F.coalesce(F.col("_bad"), F.lit(False)), F.lit("rejected"))
              .otherwise(F.lit("updated")))
    st = st.select("id", "_order", status.alias("status"))
    last = st.where(F.col("status") == "updated").groupBy("id").agg(F.max("_order").alias("_order"))
    kept = annotations.join(last.select(F.col("id").alias("asset_id")), "asset_id", "left_anti")
    replaced = a.join(last.select(key("id").alias("asset_id")), "asset_id", "left_semi").withColumn(
        "asset_id", F.col("_asset")).select(*annotations.columns)
    return kept.unionByName(replaced), st.withColumnRenamed("_order", order) if order else st.drop("_order")


def refreshable(assets: DataFrame, ids: DataFrame, now) -> DataFrame:
    """``uri, format`` of the requested tables that extraction may be tried for: present, not expired, with an extractor."""
    wanted = assets.where((F.col("asset_type") == "table") & ~is_expired(now) & F.lower("format").isin(*S.SUPPORTED_EXTRACT_FORMATS))
    return wanted.join(ids.select("id"), "id", "left_semi").select("uri", F.lower("format").alias("format")).distinct()


def refresh_metadata(assets: DataFrame, ids: DataFrame, extracted: DataFrame, now, permissions: DataFrame | None = None,
                     users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-05: re-extract the metadata of the requested tables; annotations untouched.

    ``extracted(uri, n_rows, n_bytes, columns)`` is what the readers found (``refreshable`` says where to look); with a
    column ``format`` it holds for tables of that format.  Missing or expired -> not_found,
    non-table -> not_table, with ``permissions`` and ``users`` no ``edit`` for the request's ``user_id`` -> forbidden,
    NULL format -> no_format, format without an extractor -> unsupported_format, nothing readable at the URI ->
    extraction_failed.  Several extractions of one URI and format count as one; ``extracted.partition_columns``, where
    there, is stored.  One status row per distinct request; any permitted one refreshes the table."""
    ts = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    req = ids.select("id", *(["user_id"] if permissions is not None else [])).distinct()
    tgt = assets.select("id", "datastack", "asset_type", "format", "uri", is_expired(now).alias("_expired"))
    by = ["_x_uri"] + (["_x_format"] if "format" in extracted.columns else [])
    ex = extracted.select(F.col("uri").alias("_x_uri"), *([F.lower("format").alias("_x_format")] if len(by) > 1 else []), "n_rows", "n_bytes", "columns",
                          partition_columns(extracted).alias("partition_columns")).dropDuplicates(by)
    match = [F.col("uri") == F.col("_x_uri")] + ([F.lower("format") == F.col("_x_format")] if len(by) > 1 else [])
    r = _may_edit(req.join(tgt, "id", "left"), permissions, users).join(ex, match, "left")
    status = (F.when(F.col("asset_type").isNull() | F.col("_expired"), F.lit("not_found"))
              .when(F.col("asset_type") != "table", F.lit("not_table"))
              .when(~F.col("allowed"), F.lit("forbidden"))
              .when(F.col("format").isNull(), F.lit("no_format"))
              .when(~F.lower("format").isin(*S.SUPPORTED_EXTRACT_FORMATS), F.lit("unsupported_format"))
              .when(F.col("_x_uri").isNull(), F.lit("extraction_failed"))
              .otherwise(F.lit("refreshed")))
    asked = [c for c in ("id", "user_id") if c in req.columns]
    st = r.select(*asked, status.alias("status"), "n_rows", "n_bytes", "columns", "partition_columns")
    md = st.where(F.col("status") == "refreshed").dropDuplicates(["id"]).select(
        "id", F.struct(F.col("n_rows").cast("bigint").alias("n_rows"), F.size("columns").cast("int").alias("n_columns"),
                       F.col("n_bytes").cast("bigint").alias("n_bytes"), F.col("columns").alias("columns"),
                       F.col("partition_columns")).cast(S.TABLE_METADATA).alias("_md"))
    j = assets.join(md, "id", "left")
    out = j.select(*[
        F.coalesce(F.col("_md"), F.col(c)).alias(c) if c == "cached_metadata"
        else F.when(F.col("_md").isNotNull(), ts).otherwise(F.col(c)).alias(c) if c == "metadata_cached_at"
        else F.col(c) for c in assets.columns])
    return out, st.select(*asked, "status")
