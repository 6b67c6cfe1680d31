"""Asset-name rules as Column expressions (SCL-01, SCL-02)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAME_FORMAT_MESSAGE, NAME_SEGMENT_PATTERN


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_segments(name: Column | str) -> Column:
    # limit -1 keeps trailing empty segments ("a." -> ["a", ""])
    return F.split(_c(name), r"\.", -1)


def name_error(name: Column | str) -> Column:
    """NULL for a valid name, else the first failing rule's message.

    Rules in order: non-empty; at most two dot segments; then per segment, in
    order, non-empty and ``[a-z][a-z0-9_]*``.
    """
    n = _c(name)
    segs = name_segments(n)
    first_bad = F.try_element_at(F.filter(segs, lambda s: (s == "") | ~s.rlike(NAME_SEGMENT_PATTERN)), F.lit(1))
    return (
        F.when(n.isNull() | (n == ""), F.lit("Name must not be empty."))
        .when(F.size(segs) > 2, F.concat(F.lit("Name '"), n, F.lit("' has too many dot-separated segments (max 2). " + NAME_FORMAT_MESSAGE)))
        .when(first_bad == "", F.concat(F.lit("Name '"), n, F.lit("' has an empty segment. " + NAME_FORMAT_MESSAGE)))
        .when(first_bad.isNotNull(), F.concat(F.lit("Name segment '"), first_bad, F.lit("' is invalid. " + NAME_FORMAT_MESSAGE)))
    )


def name_error_code(name: Column | str) -> Column:
    """Short code for the failing rule: empty / too_many / empty_segment / bad_segment / NULL."""
    n = _c(name)
    segs = name_segments(n)
    first_bad = F.try_element_at(F.filter(segs, lambda s: (s == "") | ~s.rlike(NAME_SEGMENT_PATTERN)), F.lit(1))
    return (
        F.when(n.isNull() | (n == ""), F.lit("empty"))
        .when(F.size(segs) > 2, F.lit("too_many"))
        .when(first_bad == "", F.lit("empty_segment"))
        .when(first_bad.isNotNull(), F.lit("bad_segment"))
    )


def is_valid_name(name: Column | str) -> Column:
    return name_error(name).isNull()


def base_name(name: Column | str) -> Column:
    """Part before the first dot (the whole name when there is none)."""
    return F.split_part(_c(name), F.lit("."), F.lit(1))
