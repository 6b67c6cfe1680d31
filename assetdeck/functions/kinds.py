"""Column-kind rules (SCL-03, SCL-04, SCL-06, SCL-07, SCL-20).

A kind is one wide struct (see ``schema.KIND``); its ``kind`` tag says which
of the other fields apply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KIND_TAGS, NODE_LEVEL_PATTERN, SPLIT_AXES


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_node_level(level: Column | str) -> Column:
    """``root_id``, ``supervoxel_id`` or ``level<digits>_id``."""
    return F.coalesce(_c(level).rlike(NODE_LEVEL_PATTERN), F.lit(False))


def kind_error(kind: Column | str) -> Column:
    """NULL when the kind struct is acceptable (or absent), else a reason."""
    k = _c(kind)
    tag = k.getField("kind")
    return (
        F.when(k.isNull(), F.lit(None).cast("string"))
        .when(~tag.isin(*KIND_TAGS) | tag.isNull(), F.concat(F.lit("Unknown kind '"), F.coalesce(tag, F.lit("")), F.lit("'")))
        .when((tag == "materialization") & (k.getField("target_table").isNull() | k.getField("target_column").isNull()),
              F.lit("Materialization kind requires target_table and target_column"))
        .when((tag == "segmentation") & ~valid_node_level(k.getField("node_level")),
              F.concat(F.lit("Invalid node_level '"), F.coalesce(k.getField("node_level"), F.lit("")),
                       F.lit("'. Must be 'root_id', 'supervoxel_id', or 'level{N}_id' (e.g., 'level2_id').")))
        .when((tag == "packed_point") & k.getField("resolution").isNotNull() & (F.size(k.getField("resolution")) != 3),
              F.lit("Packed point resolution must be a list of exactly 3 values [rx, ry, rz]."))
        .when((tag == "split_point") & ~F.coalesce(k.getField("axis").isin(*SPLIT_AXES), F.lit(False)),
              F.lit("Split point axis must be one of 'x', 'y', 'z'"))
    )


def node_level_from_form(node_level: Column | str, custom_level: Column | str) -> Column:
    """Form value -> node level: ``custom`` + N gives ``levelN_id``; bare ``custom`` or blank gives NULL."""
    nl = F.trim(_c(node_level))
    cl = F.trim(_c(custom_level))
    level = F.when((nl == "custom") & (F.coalesce(cl, F.lit("")) != ""), F.concat(F.lit("level"), cl, F.lit("_id"))).otherwise(nl)
    return F.when((F.coalesce(level, F.lit("")) != "") & (level != "custom"), level)


def resolution_parts(raw: Column | str) -> Column:
    """Comma list -> trimmed non-blank parts (strings)."""
    parts = F.transform(F.split(F.coalesce(_c(raw), F.lit("")), ",", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse_resolution(raw: Column | str) -> Column:
    """Exactly three numbers -> array<double>; any other count -> NULL."""
    parts = resolution_parts(raw)
    nums = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.size(nums) == 3, nums)


def resolution_has_non_number(raw: Column | str) -> Column:
    """True when a non-blank part is not a number (the form submit then fails)."""
    return F.exists(resolution_parts(raw), lambda x: x.try_cast("double").isNull())


def _num_text(x: Column) -> Column:
    return x.cast("string")


def kind_label(kind: Column | str) -> Column:
    """Short human label, e.g. ``mat → t.c``, ``seg root_id``, ``packed point res=4.0×4.0×40.0``."""
    k = _c(kind)
    tag = k.getField("kind")
    res = k.getField("resolution")
    ares = k.getField("axis_resolution")
    pg = k.getField("point_group")
    return (
        F.when(k.isNull(), F.lit(None).cast("string"))
        .when(tag == "materialization",
              F.concat_ws("", F.lit("mat → "), k.getField("target_table"), F.lit("."), k.getField("target_column")))
        .when(tag == "segmentation", F.concat_ws("", F.lit("seg "), k.getField("node_level")))
        .when(tag == "packed_point",
              F.concat(F.lit("packed point"),
                       F.when(F.coalesce(F.size(res), F.lit(0)) > 0,
                              F.concat(F.lit(" res="), F.array_join(F.transform(res, _num_text), "×"))).otherwise(F.lit(""))))
        .when(tag == "split_point",
              F.concat(F.lit("split point "), F.coalesce(k.getField("axis"), F.lit("")),
                       F.when(F.coalesce(pg, F.lit("")) != "", F.concat(F.lit(" ("), pg, F.lit(")"))).otherwise(F.lit("")),
                       F.when(F.coalesce(ares, F.lit(0.0)) != 0.0, F.concat(F.lit(" res="), _num_text(ares))).otherwise(F.lit(""))))
    )
