"""Reference objects of a datastack: tables and views with their fields
(SRC-07 .. SRC-10, SCL-08, SET-01).

``mat_objects(datastack, version, object_type, object_name, is_current, fields)``
is a small dimension table (tables per datastack, not per asset); joins against
it use a size-checked broadcast (see ``operators.joins``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_bbox(field: Column | str) -> Column:
    """Drop one trailing ``_bbox`` (spatial filter suffix)."""
    f = F.col(field) if isinstance(field, str) else field
    return F.regexp_replace(f, r"_bbox\z", "")


def mat_tables_at(mat: DataFrame, datastack: str | None = None, version: int | None = None) -> DataFrame:
    """SRC-07: table names at a version (all datastacks when ``datastack`` is None)."""
    m = mat.where(F.col("object_type") == "table")
    if datastack is not None:
        m = m.where(F.col("datastack") == datastack)
    if version is not None:
        m = m.where(F.col("version") == version)
    return m.select("datastack", "version", "object_name")


def mat_tables_current(mat: DataFrame, datastack: str | None = None) -> DataFrame:
    """SRC-08: current table names per datastack."""
    m = mat.where((F.col("object_type") == "table") & F.col("is_current"))
    if datastack is not None:
        m = m.where(F.col("datastack") == datastack)
    return m.select("datastack", "object_name").distinct()


def mat_objects_of(mat: DataFrame, object_type: str, datastack: str | None = None, version: int | None = None) -> DataFrame:
    """SRC-09: tables or views for a datastack; no version means the current ones."""
    m = mat.where(F.col("object_type") == object_type)
    if datastack is not None:
        m = m.where(F.col("datastack") == datastack)
    m = m.where(F.col("is_current")) if version is None else m.where(F.col("version") == version)
    return m.select("datastack", "object_name").distinct()


def target_columns(mat: DataFrame, requests: DataFrame) -> DataFrame:
    """SRC-10: fields of each requested target, ``_bbox`` stripped, in field order.

    ``requests(datastack, target_name, target_type)``: ``view`` looks among
    views, anything else among tables.  Where they have a column ``version``, it is the version
    to look at, NULL standing for the current one; without it all ask for the current one.
    """
    asked = F.col("version").cast("string") if "version" in requests.columns else F.lit(None).cast("string")
    r = requests.withColumn("_otype", F.when(F.col("target_type") == "view", "view").otherwise("table")).withColumn(
        "_at", F.coalesce(asked, F.lit("current")))
    known = ["datastack", F.col("object_type").alias("_otype"), F.col("object_name").alias("target_name"), "fields"]
    # every object under its version and, if it is current, under that name too: one equality join serves both
    objects = mat.select(*known, F.explode(F.array_compact(F.array(F.col("version").cast("string"), F.when(F.col("is_current"), F.lit("current"))))).alias("_at"))
    j = r.join(objects, ["datastack", "_otype", "target_name", "_at"], "inner")
    out = ["datastack", "target_name", "target_type", *(["version"] if "version" in requests.columns else [])]
    return j.select(*out, F.posexplode("fields").alias("pos", "f")).select(*out, F.col("pos").cast("int").alias("pos"), strip_bbox("f").alias("column_name"))


def linkable_targets(mat: DataFrame, datastack: str | None = None, version: int | None = None) -> DataFrame:
    """SET-01: tables UNION ALL views, current or of a version, tagged; ordered by name, table before view on ties."""
    t = mat_objects_of(mat, "table", datastack, version).select("datastack", F.col("object_name").alias("name"), F.lit("table").alias("target_type"))
    v = mat_objects_of(mat, "view", datastack, version).select("datastack", F.col("object_name").alias("name"), F.lit("view").alias("target_type"))
    return t.unionByName(v).orderBy("datastack", "name", "target_type")
