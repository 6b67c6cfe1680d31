"""The fixture derivations of ``assetdeck.fixtures`` written as plain SQL.

These are used only by the DuckDB oracles: each oracle query is
``WITH <the fixtures it needs> <its own SELECT>``.
"""

from __future__ import annotations

from ..fixtures import DEFAULT_NOW, DTYPE_CYCLE

NOW_SQL = f"TIMESTAMP '{DEFAULT_NOW}'"

_DTYPE_CASE = "CASE (o_orderkey + i) % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DTYPE_CYCLE)) + " END"

CTES: dict[str, str] = {}

CTES["cat_assets"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS id,
  'ds' || CAST(o_orderkey % 4 AS VARCHAR) AS datastack,
  'tbl_' || CAST(o_orderkey % 500 AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '.by_key' ELSE '' END AS name,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 900 + o_orderkey % 7 END AS INTEGER) AS mat_version,
  CAST(o_orderkey // 500 AS INTEGER) AS revision,
  'gs://bucket-' || CAST(o_orderkey % 10 AS VARCHAR) || '/t/' || CAST(o_orderkey AS VARCHAR) AS uri,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'delta' WHEN '2-HIGH' THEN 'parquet'
    WHEN '3-MEDIUM' THEN 'delta' WHEN '4-NOT SPECIFIED' THEN 'precomputed' ELSE NULL END AS format,
  CASE WHEN o_orderkey % 6 = 0 THEN 'asset' ELSE 'table' END AS asset_type,
  o_custkey AS owner,
  o_orderkey % 2 = 0 AS is_managed,
  CASE WHEN o_orderkey % 4 = 0 THEN 'mutable' ELSE 'static' END AS mutability,
  CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'draft' ELSE 'deprecated' END AS maturity,
  CASE o_orderkey % 10
    WHEN 0 THEN '{"source": "materialization", "source_table": "nation_' || CAST(o_orderkey % 25 AS VARCHAR)
      || '", "mat_version": ' || CAST(900 + o_orderkey % 7 AS VARCHAR) || '}'
    WHEN 5 THEN '{"tag": "t' || CAST(o_orderkey % 3 AS VARCHAR) || '", "nested": {"level": ' || CAST(o_orderkey % 4 AS VARCHAR) || '}}'
    ELSE '{}' END AS properties,
  CASE WHEN o_orderkey % 8 = 0 THEN 'grp' || CAST(o_custkey % 5 AS VARCHAR) WHEN o_orderkey % 8 = 4 THEN '' END AS access_group,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS expires_at,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'materialization' ELSE 'user' END AS source,
  CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey % 1000003) * 7919) % 100000007 END AS n_rows,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 6 AS INTEGER) END AS n_columns,
  CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE ((o_orderkey % 1000003) * 1048573) % 1099511627776 END AS n_bytes,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS metadata_cached_at
FROM orders"""

CTES["cat_columns"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, CAST(i AS INTEGER) AS pos,
  'col_' || CAST(i AS VARCHAR) AS name, {_DTYPE_CASE} AS dtype
FROM (SELECT o_orderkey, unnest(range(1, 2 + o_orderkey % 6)) AS i FROM orders WHERE o_orderkey % 6 <> 0)"""

CTES["cat_annotations"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS asset_id, l_linenumber AS pos, l_partkey * 100003 + l_suppkey % 100003 AS tie,
  CASE WHEN l_partkey % 10 = 0 THEN 'orphan_' || CAST(l_linenumber AS VARCHAR)
    WHEN l_partkey % 7 = 0 THEN 'col_1' ELSE 'col_' || CAST(l_linenumber AS VARCHAR) END AS column_name,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'note ' || CAST(l_partkey AS VARCHAR) END AS description,
  CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'materialization' WHEN 2 THEN 'segmentation'
    WHEN 3 THEN 'packed_point' ELSE 'split_point' END AS kind,
  CASE WHEN l_partkey % 5 = 1 THEN CASE WHEN l_suppkey % 6 = 0 THEN ''
    ELSE 'nation_' || CAST(l_suppkey % 30 AS VARCHAR) END END AS target_table,
  CASE WHEN l_partkey % 5 = 1 THEN CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'id' END END AS target_column,
  CASE WHEN l_partkey % 5 = 2 THEN CASE l_suppkey % 4 WHEN 0 THEN 'root_id' WHEN 1 THEN 'supervoxel_id'
    WHEN 2 THEN 'level' || CAST(l_suppkey % 9 AS VARCHAR) || '_id' ELSE 'level_x' END END AS node_level,
  CASE WHEN l_partkey % 5 = 3 THEN CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN [4.0, 4.0, 40.0]::DOUBLE[]
    ELSE [8.0, 8.0]::DOUBLE[] END END AS resolution,
  CASE WHEN l_partkey % 5 = 4 THEN CASE l_suppkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' END END AS axis,
  CASE WHEN l_partkey % 5 = 4 AND l_partkey % 3 <> 0 THEN 'pt' || CAST(l_partkey % 2 AS VARCHAR) END AS point_group,
  CASE WHEN l_partkey % 5 = 4 THEN l_tax END AS axis_resolution
FROM lineitem"""

CTES["cat_candidates"] = """
SELECT event_id AS seq, user_id,
  CASE WHEN event_id % 23 = 0 THEN 'ds' || CAST(event_id % 4 AS VARCHAR) ELSE 'ds' || CAST(user_id % 5 AS VARCHAR) END AS datastack,
  CASE WHEN event_id % 23 = 0 THEN 'tbl_' || CAST(event_id % 500 AS VARCHAR) || CASE WHEN event_id % 7 = 0 THEN '.by_key' ELSE '' END
    WHEN event_id % 11 = 0 THEN upper(event_type) || '_' || CAST(user_id % 40 AS VARCHAR)
    WHEN event_id % 13 = 0 THEN event_type || '_' || CAST(user_id % 40 AS VARCHAR) || '.'
    WHEN event_id % 17 = 0 THEN 'nation_' || CAST(user_id % 25 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '.by_root' ELSE '' END
    ELSE event_type || '_' || CAST(user_id % 40 AS VARCHAR) END AS name,
  CAST(CASE WHEN event_id % 23 = 0 THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE 900 + event_id % 7 END
    WHEN event_id % 4 = 0 THEN NULL ELSE 900 + user_id % 7 END AS INTEGER) AS mat_version,
  CAST(CASE WHEN event_id % 23 = 0 THEN event_id // 500 ELSE event_id % 3 END AS INTEGER) AS revision,
  CASE WHEN event_id % 19 = 0 THEN 'gs://bucket-' || CAST(event_id % 10 AS VARCHAR) || '/t/' || CAST(event_id AS VARCHAR)
    ELSE 'gs://bucket-' || CAST(user_id % 10 AS VARCHAR) || '/c/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS uri,
  CASE event_id % 5 WHEN 0 THEN 'delta' WHEN 1 THEN 'parquet' WHEN 2 THEN 'Parquet' WHEN 3 THEN 'precomputed' END AS format,
  CASE WHEN event_id % 2 = 0 THEN 'table' ELSE 'asset' END AS asset_type,
  CASE WHEN event_id % 41 <> 0 THEN event_id % 3 = 0 END AS is_managed,
  CASE WHEN event_id % 37 = 0 THEN 'frozen' WHEN event_id % 4 = 1 THEN 'mutable' ELSE 'static' END AS mutability,
  CASE event_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'draft' ELSE 'deprecated' END AS maturity,
  CASE WHEN event_id % 31 = 0 THEN 'not json' WHEN event_id % 47 = 0 THEN '[1, 2]' WHEN event_id % 53 = 0 THEN '7'
    WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '{"source": "materialization", "source_table": "nation_' || CAST(user_id % 30 AS VARCHAR)
      || '", "mat_version": ' || CAST(900 + user_id % 7 AS VARCHAR) || '}'
    WHEN event_id % 43 = 0 THEN '{"source": "materialization"}'
    ELSE props END AS properties,
  CASE WHEN event_id % 8 = 0 THEN 'grp' || CAST(user_id % 5 AS VARCHAR) END AS access_group,
  CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 30 DAY END AS expires_at
FROM events"""

CTES["cat_mat_objects"] = """
SELECT 'ds' || CAST(n_nationkey % 4 AS VARCHAR) AS datastack, CAST(900 + n_nationkey % 7 AS INTEGER) AS version,
  'table' AS object_type, lower(n_name) AS object_name, n_nationkey % 5 <> 4 AS is_current,
  CASE WHEN n_nationkey % 2 = 0 THEN ['id', 'pt_position_bbox', 'size'] ELSE ['id', 'pre_pt_position_bbox', 'post_pt_position'] END AS fields
FROM nation
UNION ALL
SELECT 'ds' || CAST(r_regionkey % 4 AS VARCHAR), CAST(900 + r_regionkey % 7 AS INTEGER),
  'view', lower(replace(r_name, ' ', '_')) || '_view', true, ['id', 'region_bbox']
FROM region"""

CTES["cat_users"] = "SELECT c_custkey AS user_id, c_custkey % 97 = 0 AS is_admin FROM customer"

CTES["cat_permissions"] = """
SELECT c_custkey AS user_id, 'ds' || CAST(c_nationkey % 4 AS VARCHAR) AS resource,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'view' WHEN 'HOUSEHOLD' THEN 'view'
    WHEN 'AUTOMOBILE' THEN 'edit' WHEN 'FURNITURE' THEN 'edit' ELSE 'admin' END AS permission
FROM customer
UNION ALL
SELECT c_custkey, 'grp' || CAST(c_custkey % 5 AS VARCHAR), 'view' FROM customer WHERE c_custkey % 3 = 0"""

CTES["cat_memberships"] = """
SELECT c_custkey AS user_id, 'grp' || CAST((c_custkey + 1) % 5 AS VARCHAR) AS group_name
FROM customer WHERE c_custkey % 2 = 0"""

CTES["cat_view_requests"] = "SELECT event_id AS request_id, user_id, CAST(event_id AS VARCHAR) AS asset_id FROM events"

CTES["cat_form_cells"] = """
SELECT asset_id, idx, tie, field, value FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS asset_id, CAST(l_linenumber - 1 AS INTEGER) AS idx, l_partkey * 100003 + l_suppkey % 100003 AS tie,
    unnest([
      {'field': 'name', 'value': 'col_' || CAST(l_linenumber AS VARCHAR)},
      {'field': 'desc', 'value': CASE WHEN l_suppkey % 3 = 0 THEN '  ' ELSE ' note ' || CAST(l_partkey AS VARCHAR) END},
      {'field': 'kind', 'value': ['', 'materialization', 'segmentation', 'packed_point', 'split_point'][1 + l_partkey % 5]},
      {'field': 'target_table', 'value': CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'nation_' || CAST(l_suppkey % 30 AS VARCHAR) END},
      {'field': 'target_column', 'value': CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE 'id' END},
      {'field': 'node_level', 'value': ['root_id', 'supervoxel_id', 'custom', 'custom'][1 + l_suppkey % 4]},
      {'field': 'custom_level', 'value': CASE WHEN l_suppkey % 4 = 3 THEN '' ELSE CAST(l_partkey % 9 AS VARCHAR) END},
      {'field': 'resolution', 'value': ['4, 4, 40', '', '8,8', '1.5,,2.5, 3', '2'][1 + l_suppkey % 5]},
      {'field': 'axis', 'value': ['x', 'y', 'z', ' '][1 + l_partkey % 4]},
      {'field': 'point_group', 'value': CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'pt' || CAST(l_partkey % 2 AS VARCHAR) END}
    ], max_depth := 2)
  FROM lineitem)"""

CTES["cat_storage"] = """
SELECT 'gs://bucket-' || CAST(o_orderkey % 10 AS VARCHAR) || '/t/' || CAST(o_orderkey AS VARCHAR) AS uri,
  CASE o_orderkey % 3 WHEN 0 THEN 'parquet' WHEN 1 THEN 'delta' ELSE 'other' END AS actual_format
FROM orders WHERE o_orderkey % 17 <> 0
UNION ALL
SELECT DISTINCT 'gs://bucket-' || CAST(user_id % 10 AS VARCHAR) || '/c/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR),
  CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'parquet' ELSE 'delta' END
FROM events WHERE CAST(floor(value) AS BIGINT) % 3 <> 0"""


CTES["cat_errors"] = """
SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'parquet' ELSE 'delta' END AS format,
  CASE event_id % 9 WHEN 0 THEN 'No such file or directory: ' || event_type || '/' || CAST(user_id AS VARCHAR)
    WHEN 1 THEN '404 Not Found: object ' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'bucket-' || CAST(user_id % 10 AS VARCHAR) || ' does not exist'
    WHEN 3 THEN 'PERMISSION denied for user ' || CAST(user_id AS VARCHAR) WHEN 4 THEN '403 Forbidden' WHEN 5 THEN 'no Access to ' || event_type
    WHEN 6 THEN 'Invalid magic number in footer of ' || event_type WHEN 7 THEN 'access denied or key not found' END AS message
FROM events"""

CTES["cat_patches"] = """
SELECT event_id AS request_id, user_id, CAST(event_id // 4 * 4 AS VARCHAR) AS id, event_id % 3 = 0 AS maturity_set,
  CASE WHEN event_id % 33 = 0 THEN NULL WHEN event_id % 21 = 0 THEN 'bogus' WHEN event_id % 3 = 0 THEN 'deprecated' ELSE 'draft' END AS maturity,
  event_id % 4 = 0 AS access_group_set,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'grp' || CAST(user_id % 5 AS VARCHAR) END AS access_group,
  event_id % 5 = 0 AS expires_at_set,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 15 = 0 THEN TIMESTAMP '1990-01-01'
    ELSE ts + INTERVAL 60 DAY END AS expires_at
FROM events"""

CTES["cat_deletes"] = ("SELECT event_id AS request_id, user_id, CAST(event_id // 4 * 5 AS VARCHAR) AS id "
                       "FROM events WHERE event_id % 2 = 1")


CTES["cat_forms"] = """
SELECT event_id AS seq,
  CASE WHEN event_id % 50 = 0 THEN '  ' ELSE 'ds' || CAST(user_id % 5 AS VARCHAR) END AS datastack,
  ' ' || event_type || '_' || CAST(user_id % 40 AS VARCHAR) || ' ' AS name,
  CASE WHEN event_id % 47 = 0 THEN '' ELSE 'gs://bucket-' || CAST(user_id % 10 AS VARCHAR) || '/f/' || CAST(event_id AS VARCHAR) END AS uri,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'parquet' WHEN 2 THEN ' delta ' ELSE 'precomputed' END AS format,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 903 ' WHEN 2 THEN 'abc' ELSE CAST(900 + user_id % 7 AS VARCHAR) END AS mat_version,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x1' ELSE CAST(event_id % 3 AS VARCHAR) END AS revision,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'mutable' ELSE 'static' END AS mutability,
  CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'draft' ELSE 'stable' END AS maturity,
  CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS is_managed,
  CASE WHEN event_id % 7 = 0 THEN ' grp' || CAST(user_id % 5 AS VARCHAR) || ' ' ELSE '  ' END AS access_group,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '   ' ELSE props END AS properties,
  CASE event_id % 6 WHEN 0 THEN ' 2030-01-02 03:04:05 ' WHEN 1 THEN 'soon' WHEN 2 THEN '' WHEN 3 THEN '2031-05-06' END AS expires_at
FROM events"""


def with_fixtures(body: str, *names: str, **extra: str) -> str:
    """``WITH`` clause defining the named fixtures (then ``extra`` CTEs in order), followed by ``body``."""
    parts = [f"{n} AS ({CTES[n]}\n)" for n in names] + [f"{n} AS ({q}\n)" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
