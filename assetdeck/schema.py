"""Asset schemas, enumerations and fixed values.

Every asset lives in one wide row; table-only columns are NULL for other
asset types.  Timestamps are UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------
MUTABILITY_VALUES = ("static", "mutable")
MATURITY_VALUES = ("stable", "draft", "deprecated")
DEFAULT_MUTABILITY = "static"
DEFAULT_MATURITY = "stable"
DEFAULT_TABLE_SOURCE = "user"

NAME_SEGMENT_PATTERN = r"^[a-z][a-z0-9_]*\z"
NAME_FORMAT_MESSAGE = (
    "Name must be lowercase alphanumeric with underscores only "
    "(e.g. 'my_table', 'synapses_v4'). "
    "Each segment must start with a letter. "
    "Layout suffixes (dot-separated) follow the same rules."
)
NODE_LEVEL_PATTERN = r"^(root_id|supervoxel_id|level[0-9]+_id)\z"
INTEGER_DTYPES = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")
FLOAT_DTYPES = ("float32", "float64")
KIND_TAGS = ("materialization", "segmentation", "packed_point", "split_point")
SPLIT_AXES = ("x", "y", "z")
SUPPORTED_EXTRACT_FORMATS = ("delta", "parquet")
GCS_BUCKET_PATTERN = r"^[a-z0-9][a-z0-9._-]{1,61}[a-z0-9]\z"
GCS_PREFIX_PATTERN = r"^[a-zA-Z0-9/_\-.=+]*\z"
MISSING_MARK = "—"  # em dash shown for NULL cells
LIST_LIMIT_MAX = 1000
EXPLORE_LIMIT_DEFAULT = 25
EXPLORE_LIMIT_MAX = 100
# ---------------------------------------------------------------------------

ASSET_SORTABLE = (
    "id", "datastack", "name", "mat_version", "revision", "uri", "format", "asset_type",
    "owner", "is_managed", "mutability", "maturity", "properties", "access_group",
    "created_at", "expires_at", "source", "metadata_cached_at",
)

COLUMN_INFO = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("dtype", T.StringType()),
])

KIND = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("target_table", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("node_level", T.StringType()),
    T.StructField("resolution", T.ArrayType(T.DoubleType())),
    T.StructField("axis", T.StringType()),
    T.StructField("point_group", T.StringType()),
    T.StructField("axis_resolution", T.DoubleType()),
])

ANNOTATION = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("kind", KIND),
])

TABLE_METADATA = T.StructType([
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_columns", T.IntegerType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("columns", T.ArrayType(COLUMN_INFO)),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
])

ASSET_BASE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("datastack", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("mat_version", T.IntegerType()),
    T.StructField("revision", T.IntegerType(), False),
    T.StructField("uri", T.StringType(), False),
    T.StructField("format", T.StringType()),
    T.StructField("asset_type", T.StringType(), False),
    T.StructField("owner", T.LongType(), False),
    T.StructField("is_managed", T.BooleanType(), False),
    T.StructField("mutability", T.StringType(), False),
    T.StructField("maturity", T.StringType(), False),
    T.StructField("properties", T.StringType()),
    T.StructField("access_group", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("expires_at", T.TimestampType()),
])

TABLE_EXTRA = [
    T.StructField("source", T.StringType()),
    T.StructField("cached_metadata", TABLE_METADATA),
    T.StructField("metadata_cached_at", T.TimestampType()),
    T.StructField("column_annotations", T.ArrayType(ANNOTATION)),
]

ASSET = T.StructType(list(ASSET_BASE.fields) + TABLE_EXTRA)

BASE_COLUMNS = [f.name for f in ASSET_BASE.fields]
ASSET_COLUMNS = [f.name for f in ASSET.fields]

CANDIDATE = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("datastack", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("mat_version", T.IntegerType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("uri", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("is_managed", T.BooleanType()),
    T.StructField("mutability", T.StringType()),
    T.StructField("maturity", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("access_group", T.StringType()),
    T.StructField("expires_at", T.TimestampType()),
])

MAT_OBJECT = T.StructType([
    T.StructField("datastack", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("object_type", T.StringType()),
    T.StructField("object_name", T.StringType()),
    T.StructField("is_current", T.BooleanType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
])
