"""Join helpers: size-checked broadcast, and a filter ahead of a join of wide rows.

A side gets a broadcast hint only when the optimizer's size estimate for it
is below the session's broadcast threshold (a plan-time check, no job).
Sides that are larger, or whose estimate is unknown, are left to Catalyst
and AQE: at run time AQE re-checks the real shuffle size and switches to a
broadcast join only under ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
beyond it the join stays sort-merge / shuffled-hash with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 64 * 1024 * 1024
#: Words of 64 bits in the table of ``among``, at most, whatever the number of keys; a power of two.
WORDS = 1 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (upper bound for file scans and their filters)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - no estimate available
        return None


def maybe_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(df)`` when its estimated size is proven under ``max_bytes``, else ``df``."""
    limit = max_bytes
    if limit is None:
        conf = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
        try:
            limit = min(int(str(conf).rstrip("bB")), DEFAULT_MAX_BYTES)
        except ValueError:
            limit = 10 * 1024 * 1024
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and 0 <= size <= limit else df


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be one of ``keys`` (one column): none of these is lost, few others stay.

    Goes before the exact join where rows are wide and few of them match: the others are dropped where they are read
    instead of being shuffled. Each key sets the bit of its hash in a broadcast table of at most ``WORDS`` words; when
    keys are many times 64 ``WORDS``, most rows stay. Keys of another type hash otherwise, so then all rows stay."""
    name = keys.columns[0]
    if keys.schema[name].dataType != rows.schema[key].dataType:
        return rows
    word, bit = f"xxhash64({{0}}) & {WORDS - 1}L", "CAST(shiftrightunsigned(xxhash64({0}), 58) AS INT)"
    table = keys.selectExpr(f"{word.format(name)} AS _word", f"{bit.format(name)} AS _bit").groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    hit = F.expr(f"{word.format(key)} = _word AND shiftright(_bits, {bit.format(key)}) & 1L = 1L")
    return rows.join(F.broadcast(table), hit, "left_semi")
