"""Permission-aware access (JON-09, JON-10, JON-11, PRJ-09).

Principals are tables: ``users(user_id, is_admin)``,
``permissions(user_id, resource, permission)``, ``memberships(user_id, group_name)``.
Every check is an equality semi/left join on (user, resource); nothing is
collected per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uris as U
from .predicates import is_expired


def _flagged(df: DataFrame, grants: DataFrame, left_on: list, right_on: list, flag: str) -> DataFrame:
    g = grants.select(*[F.col(r).alias(f"_g{i}") for i, r in enumerate(right_on)]).distinct().withColumn(flag, F.lit(True))
    cond = [F.col(left) == F.col(f"_g{i}") for i, left in enumerate(left_on)]
    j = df.join(g, cond, "left")
    return j.drop(*[f"_g{i}" for i in range(len(right_on))]).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_admin(df: DataFrame, users: DataFrame) -> DataFrame:
    admins = users.where(F.col("is_admin")).select("user_id")
    return _flagged(df, admins, ["user_id"], ["user_id"], "_is_admin")


def datastack_permission(requests: DataFrame, permissions: DataFrame, users: DataFrame, wanted: str | None = None,
                         auth_enabled: bool = True, resource_col: str = "datastack", wanted_col: str | None = None) -> DataFrame:
    """JON-09: adds ``allowed``: auth off, or admin, or the wanted permission or
    ``admin`` listed for the resource.  ``wanted`` is a constant or ``wanted_col`` a column."""
    if not auth_enabled:
        return requests.withColumn("allowed", F.lit(True))
    r = with_admin(requests, users)
    if wanted_col is None:
        grants = permissions.where(F.col("permission").isin(wanted, "admin"))
        r = _flagged(r, grants, ["user_id", resource_col], ["user_id", "resource"], "_granted")
    else:
        exact = permissions.select("user_id", "resource", F.col("permission").alias("_perm"))
        r = _flagged(r, exact, ["user_id", resource_col, wanted_col], ["user_id", "resource", "_perm"], "_granted_exact")
        adm = permissions.where(F.col("permission") == "admin")
        r = _flagged(r, adm, ["user_id", resource_col], ["user_id", "resource"], "_granted_admin")
        r = r.withColumn("_granted", F.col("_granted_exact") | F.col("_granted_admin")).drop("_granted_exact", "_granted_admin")
    return r.withColumn("allowed", F.col("_is_admin") | F.col("_granted")).drop("_is_admin", "_granted")


def view_resource(access_group: Column | str = "access_group", datastack: Column | str = "datastack") -> Column:
    """Access group, or the datastack when the group is NULL or empty."""
    ag = F.col(access_group) if isinstance(access_group, str) else access_group
    ds = F.col(datastack) if isinstance(datastack, str) else datastack
    return F.coalesce(F.when(ag != "", ag), ds)


def asset_view_access(requests: DataFrame, assets: DataFrame, permissions: DataFrame, memberships: DataFrame,
                      users: DataFrame, now, auth_enabled: bool = True) -> DataFrame:
    """JON-10: ``requests(request_id, user_id, asset_id)`` -> status ok / forbidden / not_found.

    Missing or expired assets are not found; otherwise the user needs ``view``
    (or ``admin``) on the resource, or membership of a group of that name.
    """
    a = assets.select(F.col("id").alias("asset_id"), view_resource().alias("resource"),
                      is_expired(now).alias("_expired"))
    r = requests.join(a, "asset_id", "left")
    if auth_enabled:
        r = with_admin(r, users)
        r = _flagged(r, permissions.where(F.col("permission").isin("view", "admin")), ["user_id", "resource"],
                     ["user_id", "resource"], "_perm")
        r = _flagged(r, memberships, ["user_id", "resource"], ["user_id", "group_name"], "_member")
        ok = F.col("_is_admin") | F.col("_perm") | F.col("_member")
    else:
        ok = F.lit(True)
    status = F.when(F.col("resource").isNull() | F.col("_expired"), F.lit("not_found")).when(ok, F.lit("ok")).otherwise(F.lit("forbidden"))
    return r.select("request_id", "user_id", "asset_id", "resource", status.alias("status"))


def shares_group(requests: DataFrame, memberships: DataFrame, users: DataFrame, key: str = "request_id",
                 groups_col: str = "required_groups") -> DataFrame:
    """JON-11: admin, or any overlap between the user's groups and the required list.

    The required list is exploded and semi-joined to memberships: no per-user
    group list is collected.  ``key`` identifies a request."""
    wanted = requests.select(key, "user_id", F.explode(groups_col).alias("group_name"))
    hit = wanted.join(memberships.select("user_id", "group_name").distinct(), ["user_id", "group_name"], "left_semi")
    hit = hit.select(key).distinct().withColumn("_overlap", F.lit(True))
    out = with_admin(requests.join(hit, key, "left"), users)
    return out.withColumn("shares", F.col("_is_admin") | F.coalesce(F.col("_overlap"), F.lit(False))).drop("_overlap", "_is_admin")


def access_responses(requests: DataFrame, assets: DataFrame, permissions: DataFrame, memberships: DataFrame, users: DataFrame,
                     now, auth_enabled: bool = True) -> DataFrame:
    """JON-10 then PRJ-09: one row per request (``request_id, user_id, asset_id``) with the plan of the granted ones.

    ``status`` is not_found, forbidden, error (a managed URI that cannot be served) or ok."""
    judged = asset_view_access(requests, assets, permissions, memberships, users, now, auth_enabled)
    granted = judged.where("status = 'ok'").select(F.col("asset_id").alias("id")).distinct()
    plans = access_plan(assets.join(granted, "id", "left_semi"), now).withColumnRenamed("status", "_plan")
    found = judged.withColumn("_granted", F.when(F.col("status") == "ok", F.col("asset_id"))).join(plans, F.col("_granted") == F.col("id"), "left")
    return found.withColumn("status", F.coalesce("_plan", "status")).drop("_plan", "_granted", "id", "resource")


def access_plan(assets: DataFrame, now) -> DataFrame:
    """PRJ-09: how a caller would reach each asset (no token is minted).

    Unmanaged: passthrough, credential fields NULL.  Managed ``gs://``: provider
    ``gcs`` with bucket, prefix and the prefix condition; a malformed GCS URI or
    another scheme is an error row.  Expired assets are not found.
    """
    # the URI is parsed in a projection of its own: its parts are used several times below
    parsed = assets.select("id", "uri", "format", "is_managed", is_expired(now).alias("_expired"), U.uri_scheme("uri").alias("_scheme"),
                           U.gcs_bucket("uri").alias("_bucket"), U.gcs_prefix("uri").alias("_prefix"))
    scheme, bucket, prefix = F.col("_scheme"), F.col("_bucket"), F.col("_prefix")
    error = (
        F.when(F.col("_expired"), F.lit("Asset not found"))
        .when(~F.col("is_managed"), F.lit(None).cast("string"))
        .when(scheme != "gs", F.concat(F.lit("Unsupported storage scheme: '"), scheme, F.lit("'")))
        .otherwise(U.gcs_parts_error(F.col("uri"), scheme, bucket, prefix))
    )
    judged = parsed.withColumn("error", error)
    gcs = F.col("error").isNull() & F.col("is_managed")
    return judged.select(
        "id", "uri", "format", "is_managed",
        F.when(F.col("error").isNull(), F.lit("ok")).when(F.col("_expired"), F.lit("not_found")).otherwise(F.lit("error")).alias("status"),
        "error",
        F.when(gcs, F.lit("gcs")).alias("storage_provider"),
        F.when(gcs, F.lit("Bearer")).alias("token_type"),
        F.when(gcs, bucket).alias("bucket"),
        F.when(gcs, prefix).alias("prefix"),
        F.when(gcs, U.prefix_condition(bucket, prefix)).alias("condition"),
    )
