"""Registered queries: column merge and annotation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as FX
from ..operators import annotations as A
from ..operators import forms
from .fixture_sql import with_fixtures
from .q_scalars import FORM_ROWS_SQL, dtype_class_sql
from .registry import query

KF = "kind, target_table, target_column, node_level, resolution, axis, point_group, axis_resolution"
KF_FLAT = ("kind, target_table, target_column, node_level, array_to_string(list_transform(resolution, lambda x: CAST(x AS VARCHAR)), ',') AS resolution, "
           "axis, point_group, axis_resolution")


def flat_kind(df):
    return df.withColumn("resolution", F.array_join(F.transform("resolution", lambda x: x.cast("string")), ","))


def _tables(spark, d):
    return FX.assets(spark, d).where(F.col("asset_type") == "table")


def _table_annotations(spark, d):
    ids = _tables(spark, d).select(F.col("id").alias("asset_id"))
    return FX.annotations(spark, d).join(ids, "asset_id", "left_semi")


TABLE_ANN_SQL = "SELECT * FROM cat_annotations WHERE asset_id IN (SELECT id FROM cat_assets WHERE asset_type = 'table')"
LAST_SQL = f"""SELECT asset_id, column_name, pos, tie, description, {KF} FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, column_name ORDER BY pos DESC, tie DESC) AS rn FROM cat_annotations) WHERE rn = 1"""


@query("explode_columns", with_fixtures("SELECT asset_id, pos, name, dtype FROM cat_columns", "cat_columns"))
def explode_columns(spark, d):
    return A.explode_columns(FX.assets(spark, d))


@query("last_annotation_wins", with_fixtures(
    f"SELECT asset_id, column_name, pos, tie, description, {KF_FLAT} FROM ({LAST_SQL})", "cat_annotations"))
def last_annotation_wins(spark, d):
    return flat_kind(A.last_annotation_wins(FX.annotations(spark, d)))


@query("merge_columns", with_fixtures(
    "SELECT c.asset_id, c.pos, c.name, c.dtype, l.description, l.kind, l.target_table, l.target_column, l.node_level, "
    "array_to_string(list_transform(l.resolution, lambda x: CAST(x AS VARCHAR)), ',') AS resolution, "
    "l.axis, l.point_group, l.axis_resolution "
    f"FROM cat_columns c LEFT JOIN ({LAST_SQL}) l ON c.asset_id = l.asset_id AND c.name = l.column_name",
    "cat_columns", "cat_annotations"))
def merge_columns(spark, d):
    cols = A.explode_columns(FX.assets(spark, d))
    return flat_kind(A.merge_columns(cols, FX.annotations(spark, d)))


TARGET_SQL = """SELECT a.asset_id, a.pos, a.tie, a.column_name, 'materialization' AS kind,
  'Table ''' || a.target_table || ''' not found in materialization service for datastack ''' || s.datastack || '''' AS reason
FROM ta a JOIN cat_assets s ON a.asset_id = s.id
WHERE a.kind = 'materialization' AND coalesce(a.target_table, '') <> ''
  AND s.datastack IN (SELECT datastack FROM cat_mat_objects)
  AND NOT EXISTS (SELECT 1 FROM cat_mat_objects m WHERE m.object_type = 'table' AND m.is_current
                  AND m.datastack = s.datastack AND m.object_name = a.target_table)"""


@query("kind_target_check", with_fixtures(TARGET_SQL, "cat_assets", "cat_annotations", "cat_mat_objects", ta=TABLE_ANN_SQL))
def kind_target_check(spark, d):
    return A.kind_target_check(_table_annotations(spark, d), FX.assets(spark, d, with_columns=False), FX.mat_objects(spark, d))


DTYPE_SQL = f"""SELECT a.asset_id, a.pos, a.tie, a.column_name, a.kind,
  CASE WHEN a.kind = 'segmentation' THEN 'Segmentation kind requires an integer column, but ''' || a.column_name || ''' has dtype ''' || c.dtype || ''''
    ELSE 'Point kind requires a numeric column (int or float), but ''' || a.column_name || ''' has dtype ''' || c.dtype || '''' END AS reason
FROM cat_annotations a JOIN cat_columns c ON a.asset_id = c.asset_id AND a.column_name = c.name
WHERE (a.kind = 'segmentation' AND {dtype_class_sql('c.dtype')} <> 'integer')
   OR (a.kind IN ('packed_point', 'split_point') AND {dtype_class_sql('c.dtype')} NOT IN ('integer', 'float'))"""


@query("kind_dtype_check", with_fixtures(DTYPE_SQL, "cat_columns", "cat_annotations"))
def kind_dtype_check(spark, d):
    return A.kind_dtype_check(FX.annotations(spark, d), A.explode_columns(FX.assets(spark, d)))


GROUP_SQL = """SELECT asset_id, pos, tie, column_name, 'split_point' AS kind,
  'Duplicate (point_group=''' || point_group || ''', axis=''' || axis || '''): already assigned to column ''' || first_column || '''' AS reason
FROM (SELECT *, row_number() OVER w AS rn, first_value(column_name) OVER w AS first_column FROM cat_annotations
      WHERE kind = 'split_point' AND coalesce(point_group, '') <> '' AND coalesce(axis, '') <> ''
      WINDOW w AS (PARTITION BY asset_id, point_group, axis ORDER BY pos, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE rn > 1"""


@query("point_group_uniqueness", with_fixtures(GROUP_SQL, "cat_annotations"))
def point_group_uniqueness(spark, d):
    return A.point_group_uniqueness(FX.annotations(spark, d))


@query("kind_errors_per_asset", with_fixtures(
    """SELECT asset_id, count(*) FILTER (WHERE c = 'kind_targets') AS n_target_errors,
  count(*) FILTER (WHERE c = 'point_groups') AS n_group_errors, count(*) FILTER (WHERE c = 'dtypes') AS n_dtype_errors,
  count(*) AS n_errors
FROM (SELECT asset_id, 'kind_targets' AS c FROM t1 UNION ALL SELECT asset_id, 'point_groups' FROM t2
      UNION ALL SELECT asset_id, 'dtypes' FROM t3 WHERE asset_id IN (SELECT id FROM cat_assets WHERE asset_type = 'table'))
GROUP BY asset_id""", "cat_assets", "cat_annotations", "cat_mat_objects", "cat_columns",
    ta=TABLE_ANN_SQL, t1=TARGET_SQL, t2=GROUP_SQL.replace("FROM cat_annotations", "FROM ta"), t3=DTYPE_SQL))
def kind_errors_per_asset(spark, d):
    assets = FX.assets(spark, d)
    # one join gives both the table filter and the datastack the target check needs
    tables = assets.where(F.col("asset_type") == "table").select(F.col("id").alias("asset_id"), "datastack")
    ann = FX.annotations(spark, d).join(tables, "asset_id")
    return A.kind_errors_per_asset(
        A.kind_target_check(ann, assets, FX.mat_objects(spark, d)),
        A.point_group_uniqueness(ann),
        A.kind_dtype_check(ann, A.explode_columns(assets)))


CELLS_SQL = f"""SELECT asset_id, idx, tie, name AS column_name, nullif(trim("desc"), '') AS description,
  CASE WHEN k = 'materialization' AND tt IS NOT NULL AND tc IS NOT NULL THEN 'materialization'
       WHEN k = 'segmentation' AND lvl IS NOT NULL THEN 'segmentation' WHEN k = 'packed_point' THEN 'packed_point'
       WHEN k = 'split_point' AND ax IS NOT NULL THEN 'split_point' END AS kind,
  CASE WHEN k = 'materialization' AND tt IS NOT NULL AND tc IS NOT NULL THEN tt END AS target_table,
  CASE WHEN k = 'materialization' AND tt IS NOT NULL AND tc IS NOT NULL THEN tc END AS target_column,
  CASE WHEN k = 'segmentation' THEN lvl END AS node_level,
  CASE WHEN k = 'packed_point' AND nullif(trim(resolution), '') IS NOT NULL AND len(p) = 3
       THEN array_to_string(list_transform(p, lambda x: CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR)), ',') END AS resolution,
  CASE WHEN k = 'split_point' THEN ax END AS axis,
  CASE WHEN k = 'split_point' AND ax IS NOT NULL THEN nullif(trim(point_group), '') END AS point_group,
  CASE WHEN k = 'split_point' AND ax IS NOT NULL THEN TRY_CAST(nullif(trim(resolution), '') AS DOUBLE) END AS axis_resolution,
  CASE WHEN (k = 'packed_point' AND len(list_filter(p, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0)
         OR (k = 'split_point' AND ax IS NOT NULL AND nullif(trim(resolution), '') IS NOT NULL AND TRY_CAST(trim(resolution) AS DOUBLE) IS NULL)
       THEN 'could not convert string to float' END AS form_error
FROM (SELECT *, nullif(trim(kind), '') AS k, nullif(trim(target_table), '') AS tt, nullif(trim(target_column), '') AS tc,
        nullif(trim(axis), '') AS ax,
        CASE WHEN coalesce(lv, '') <> '' AND lv <> 'custom' THEN lv END AS lvl,
        list_filter(list_transform(string_split(coalesce(resolution, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS p
      FROM (SELECT *, CASE WHEN trim(node_level) = 'custom' AND coalesce(trim(custom_level), '') <> ''
                      THEN 'level' || trim(custom_level) || '_id' ELSE trim(node_level) END AS lv FROM form_rows))"""


@query("annotation_cells_to_structs", with_fixtures(
    f"SELECT * FROM ({CELLS_SQL}) WHERE description IS NOT NULL OR kind IS NOT NULL", "cat_form_cells", form_rows=FORM_ROWS_SQL))
def annotation_cells_to_structs(spark, d):
    out = forms.cells_to_annotations(FX.form_cells(spark, d), keep_empty=False)
    return out.select("asset_id", "idx", "tie", "column_name", "description", "kind.*", "form_error").transform(flat_kind)


@query("annotation_edit_cells", with_fixtures(f"SELECT * FROM ({CELLS_SQL})", "cat_form_cells", form_rows=FORM_ROWS_SQL))
def annotation_edit_cells(spark, d):
    """PRJ-10 on the edit form, which keeps rows with neither description nor kind."""
    out = forms.cells_to_annotations(FX.form_cells(spark, d), keep_empty=True)
    return out.select("asset_id", "idx", "tie", "column_name", "description", "kind.*", "form_error").transform(flat_kind)

