"""dtype vocabulary (SCL-09).

Discovered dtypes arrive in Arrow, Polars, Spark and Delta spellings; they are
normalised to the Arrow-style name before the integer / numeric test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLOAT_DTYPES, INTEGER_DTYPES

# Spark / Delta / Arrow aliases -> canonical lower-case names.
DTYPE_ALIASES = {
    "byte": "int8",
    "tinyint": "int8",
    "short": "int16",
    "smallint": "int16",
    "int": "int32",
    "integer": "int32",
    "long": "int64",
    "bigint": "int64",
    "decimal(20,0)": "uint64",
    "float": "float32",
    "real": "float32",
    "double": "float64",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_dtype(dtype: Column | str) -> Column:
    low = F.lower(F.trim(_c(dtype)))
    mapping = F.create_map(*[F.lit(x) for kv in DTYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, low), low)


def dtype_class(dtype: Column | str) -> Column:
    """``integer``, ``float`` or ``other`` after normalisation."""
    n = normalize_dtype(dtype)
    return (
        F.when(n.isin(*INTEGER_DTYPES), F.lit("integer"))
        .when(n.isin(*FLOAT_DTYPES), F.lit("float"))
        .otherwise(F.lit("other"))
    )


def is_integer_dtype(dtype: Column | str) -> Column:
    return dtype_class(dtype) == "integer"


def is_numeric_dtype(dtype: Column | str) -> Column:
    return dtype_class(dtype).isin("integer", "float")


def spark_type_name(dt) -> str:
    """Arrow-style dtype name for a Spark DataType discovered by a scan."""
    from pyspark.sql import types as T

    simple = {
        T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
        T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "string", T.BooleanType: "bool",
        T.BinaryType: "binary", T.DateType: "date32", T.TimestampType: "timestamp[us, tz=UTC]",
        T.TimestampNTZType: "timestamp[us]",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return "uint64" if (dt.precision, dt.scale) == (20, 0) else f"decimal128({dt.precision}, {dt.scale})"
    if isinstance(dt, T.ArrayType):
        return f"list<item: {spark_type_name(dt.elementType)}>"
    return dt.simpleString()
