"""Registration pipelines (PIP-05, PIP-06) on top of batch admission.

All state-free checks (request, permission, content, kind, extraction) run
as columns over the whole batch first; only then does the admission loop
decide key / URI conflicts between candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import admission as AD
from . import annotations as AN
from . import checks as CK
from .access import datastack_permission
from .changes import partition_columns
from .requests import with_request_check


@dataclass
class RegistrationResult:
    labelled: DataFrame   # one row per candidate with admission_status / existing_id / new_id
    snapshot: DataFrame   # store plus the created rows (SET-02)
    rounds: int
    created: DataFrame    # the created rows alone, in asset columns
    annotations: DataFrame | None = None  # long-form annotations of created tables (asset_id = new id)


def _content_failed():
    return ~F.coalesce(F.col("reservation_passed"), F.lit(True)) | ~F.coalesce(F.col("reachable_passed"), F.lit(True)) \
        | ~F.coalesce(F.col("sniff_passed"), F.lit(True)) | ~F.coalesce(F.col("matverify_passed"), F.lit(True))


def _gate(c: DataFrame, permissions: DataFrame, users: DataFrame, table: bool, auth_enabled: bool) -> DataFrame:
    c = with_request_check(c, table_request=table)
    c = datastack_permission(c, permissions, users, wanted="edit", auth_enabled=auth_enabled)
    return c.withColumn("gate_status", F.when(~F.col("request_valid"), F.lit("invalid_request"))
                        .when(~F.col("allowed"), F.lit("forbidden")))


def _checked_assets(cands: DataFrame, mat: DataFrame, storage: DataFrame, permissions: DataFrame, users: DataFrame, auth_enabled: bool) -> DataFrame:
    """Candidates with ``gate_status`` and ``content_status`` of an asset registration."""
    c = _gate(cands, permissions, users, False, auth_enabled)
    c = CK.content_checks(c, mat, storage.dropDuplicates(["uri"]))
    return c.withColumn("content_status", F.when(_content_failed(), F.lit("invalid")))


def _checked_tables(cands: DataFrame, ann: DataFrame, extracted: DataFrame, mat: DataFrame, storage: DataFrame, permissions: DataFrame,
                    users: DataFrame, auth_enabled: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates with ``gate_status`` and ``content_status`` of a table registration, and their annotations."""
    c = cands.withColumn("asset_type", F.lit("table"))
    storage, extracted = storage.dropDuplicates(["uri"]), extracted.dropDuplicates(["uri"])
    ex = extracted.select(F.col("uri").alias("_x_uri"), F.col("columns").alias("_x_cols"), F.col("n_rows").alias("_x_rows"),
                          F.col("n_bytes").alias("_x_bytes"), partition_columns(extracted).alias("_x_parts"))
    # what the annotations say of a candidate needs its seq, datastack and URI alone, not the checked row
    key = cands.select(F.col("seq").cast("string").alias("asset_id"), "datastack", "uri")
    a = ann.join(key.select("asset_id"), "asset_id", "left_semi")
    malformed = AN.invalid_kinds(ann).select("asset_id").distinct()
    target_err = AN.kind_target_check(a, key.select(F.col("asset_id").alias("id"), "datastack"), mat).select("asset_id").distinct()
    group_err = AN.point_group_uniqueness(a).select("asset_id").distinct()
    cols_long = key.join(ex, F.col("uri") == F.col("_x_uri")).where(F.col("_x_cols").isNotNull()).select(
        "asset_id", F.posexplode("_x_cols").alias("pos", "col")).select(
        "asset_id", (F.col("pos") + 1).alias("pos"), F.col("col.name").alias("name"), F.col("col.dtype").alias("dtype"))
    dtype_err = AN.kind_dtype_check(a, cols_long).select("asset_id").distinct()
    flags = [malformed.withColumn("_mk", F.lit(True)), target_err.withColumn("_kt", F.lit(True)),
             group_err.withColumn("_pg", F.lit(True)), dtype_err.withColumn("_dt", F.lit(True))]
    # whole candidates are shuffled once by seq and once by URI, joins by the same key follow each other
    c = _gate(c, permissions, users, True, auth_enabled).withColumn("asset_id", F.col("seq").cast("string"))
    for f in flags:
        c = c.join(f, "asset_id", "left")
    c = c.withColumn("gate_status", F.when(F.col("_mk").isNotNull(), F.lit("invalid_request")).otherwise(F.col("gate_status"))).drop("_mk")
    st = storage.select(F.col("uri").alias("_s2_uri"), F.col("actual_format").alias("_actual_fmt"))
    c = CK.content_checks(c, mat, storage)
    c = c.join(ex, F.col("uri") == F.col("_x_uri"), "left").join(st, F.col("uri") == F.col("_s2_uri"), "left").drop("_s2_uri")
    fmt = F.lower(F.col("format"))
    content = (
        F.when(_content_failed(), F.lit("invalid"))
        .when(F.coalesce(F.col("_kt"), F.lit(False)), F.lit("kind_invalid"))
        .when(F.coalesce(F.col("_pg"), F.lit(False)), F.lit("point_group_invalid"))
        .when(~fmt.isin(*S.SUPPORTED_EXTRACT_FORMATS), F.lit("unsupported_format"))
        .when(F.col("_x_uri").isNull() | (F.coalesce(F.col("_actual_fmt"), F.lit("")) != fmt), F.lit("extraction_failed"))
        .when(F.coalesce(F.col("_dt"), F.lit(False)), F.lit("dtype_invalid"))
    )
    return c.withColumn("content_status", content), a


def register_assets(cands: DataFrame, assets: DataFrame, mat: DataFrame, storage: DataFrame, permissions: DataFrame,
                    users: DataFrame, now, auth_enabled: bool = True, batch: int | str | None = None) -> RegistrationResult:
    """PIP-05 + SNK-01: request, permission, key, URI, content checks, then insert."""
    c = _checked_assets(cands, mat, storage, permissions, users, auth_enabled)
    labelled, rounds = AD.admit(c, assets, batch=batch)
    created = _asset_rows(labelled.where(F.col("admission_status") == "created"), now)
    return RegistrationResult(labelled, assets.unionByName(created, allowMissingColumns=True), rounds, created)


def register_tables(cands: DataFrame, ann: DataFrame, extracted: DataFrame, assets: DataFrame, mat: DataFrame,
                    storage: DataFrame, permissions: DataFrame, users: DataFrame, now,
                    auth_enabled: bool = True, batch: int | str | None = None) -> RegistrationResult:
    """PIP-06 + SNK-02: PIP-05's checks, then kind targets, point groups, extractor,
    extraction and dtypes; accepted rows carry metadata and annotations.

    A malformed kind (SCL-04) makes the whole request invalid, before any other check.
    A candidate's ``source`` column, where there is one, is kept (NULL or none: the default);
    so are ``extracted.partition_columns`` (none: an empty list).  Several storage or
    extraction rows of one URI count as one.

    ``ann``: candidate annotations in long form keyed ``asset_id`` = candidate seq (text);
    ``extracted(uri, n_rows, n_bytes, columns)``: metadata found at each URI.
    """
    c, a = _checked_tables(cands, ann, extracted, mat, storage, permissions, users, auth_enabled)
    labelled, rounds = AD.admit(c, assets, batch=batch)
    created, new_ann = _table_rows(labelled.where(F.col("admission_status") == "created"), a, now, "source" in cands.columns)
    return RegistrationResult(labelled, assets.unionByName(created, allowMissingColumns=True), rounds, created, new_ann)


def register_all(cands: DataFrame, ann: DataFrame, extracted: DataFrame, assets: DataFrame, mat: DataFrame, storage: DataFrame,
                 permissions: DataFrame, users: DataFrame, now, auth_enabled: bool = True, batch: int | str | None = None) -> RegistrationResult:
    """Both kinds in one batch: candidates of type ``table`` by PIP-06, the others by PIP-05, keys and URIs decided together."""
    table = F.coalesce(F.col("asset_type") == "table", F.lit(False))
    c, a = _checked_tables(cands.where(table), ann, extracted, mat, storage, permissions, users, auth_enabled)
    both = _checked_assets(cands.where(~table), mat, storage, permissions, users, auth_enabled).unionByName(c, allowMissingColumns=True)
    labelled, rounds = AD.admit(both, assets, batch=batch)
    done = labelled.where(F.col("admission_status") == "created")
    tables, new_ann = _table_rows(done.where(table), a, now, "source" in cands.columns)
    created = _asset_rows(done.where(~table), now).unionByName(tables)
    return RegistrationResult(labelled, assets.unionByName(created, allowMissingColumns=True), rounds, created, new_ann)


def _asset_rows(created: DataFrame, now) -> DataFrame:
    rows = AD.to_asset_rows(created.drop("source", "cached_metadata", "column_annotations"), now)
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ASSET.fields])


def _table_rows(created: DataFrame, a: DataFrame, now, has_source: bool) -> tuple[DataFrame, DataFrame]:
    """The created tables in asset columns, and their annotations."""
    # annotations stay in long form, re-keyed to the new asset id (no per-asset list is collected)
    new_ann = a.join(created.select(F.col("seq").cast("string").alias("asset_id"), "new_id"), "asset_id", "inner") \
        .withColumn("asset_id", F.col("new_id")).drop("new_id")
    created = created.withColumn(
        "cached_metadata", F.struct(F.col("_x_rows").cast("bigint").alias("n_rows"), F.size("_x_cols").alias("n_columns"),
                                    F.col("_x_bytes").cast("bigint").alias("n_bytes"), F.col("_x_cols").alias("columns"),
                                    F.col("_x_parts").alias("partition_columns"))).withColumn(
        "source", F.coalesce(F.col("source") if has_source else F.lit(None).cast("string"),
                             F.lit(S.DEFAULT_TABLE_SOURCE))).withColumn(
        "column_annotations", F.lit(None).cast(T.ArrayType(S.ANNOTATION)))
    return AD.to_asset_rows(created, now, table=True).select(*S.ASSET_COLUMNS), new_ann
