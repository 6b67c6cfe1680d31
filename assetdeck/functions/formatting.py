"""Display formatters as Column expressions (SCL-14 .. SCL-19, SCL-22).

Rounding: ``format_number`` rounds the exact binary value half-even, the same
as Python's ``'%.1f'``; ``format_string('%.1f')`` does not and is avoided.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MISSING_MARK


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed1(x: Column) -> Column:
    """One decimal, no grouping."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def format_number(x: Column | str, grouping: bool = True, integral: bool = True) -> Column:
    """Integers with thousands separators (or plain); floats with one decimal."""
    v = _c(x)
    if integral:
        return F.format_number(v, 0) if grouping else v.cast("string")
    return F.format_number(v, 1) if grouping else fixed1(v)


_BIN_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def format_bytes(x: Column | str) -> Column:
    """B as an integer, then KB..PB with one decimal (base 1024), then EB.

    The unit is chosen before rounding, so 1048575 B is ``1024.0 KB``; the number is then formatted once.
    """
    n = _c(x).cast("double")

    def by_size(values: list) -> Column:
        out = F.when(F.abs(n) < 1024.0**2, F.lit(values[0]))
        for k, v in enumerate(values[1:-1], 3):
            out = out.when(F.abs(n) < 1024.0**k, F.lit(v))
        return out.otherwise(F.lit(values[-1]))

    scaled = fixed1(n / by_size([1024.0**k for k in range(1, 7)]))
    return (F.when(n.isNull(), F.lit(MISSING_MARK)).when(F.abs(n) < 1024.0, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
            .otherwise(F.concat(scaled, F.lit(" "), by_size(list(_BIN_UNITS)))))


def format_bytes_preview(x: Column | str) -> Column:
    """Preview variant: B, KB, MB, GB only, thresholds on the raw byte count."""
    n = _c(x)
    d = n.cast("double")
    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n >= 1073741824, F.concat(fixed1(d / F.lit(1073741824.0)), F.lit(" GB")))
        .when(n >= 1048576, F.concat(fixed1(d / F.lit(1048576.0)), F.lit(" MB")))
        .when(n >= 1024, F.concat(fixed1(d / F.lit(1024.0)), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


# decimal (base 1000) size units of the template engine's size filter
_DEC_PREFIXES = ("kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
_DEC_UNITS = (1e6, 1e9, 1e12, 1e15, 1e18, 1e21, 1e24, 1e27)


def format_bytes_decimal(x: Column | str) -> Column:
    """``1 Byte``, ``N Bytes`` below 1000, then ``x.y kB`` .. ``YB`` (base 1000)."""
    b = _c(x).cast("double")
    expr = (
        F.when(b.isNull(), F.lit(MISSING_MARK))
        .when(b == 1.0, F.lit("1 Byte"))
        .when(b < 1000.0, F.concat(b.cast("bigint").cast("string"), F.lit(" Bytes")))
    )
    scaled = b * F.lit(1000.0)
    for prefix, unit in zip(_DEC_PREFIXES, _DEC_UNITS):
        expr = expr.when(b < F.lit(unit), F.concat(fixed1(scaled / F.lit(unit)), F.lit(" " + prefix)))
    return expr.otherwise(F.concat(fixed1(scaled / F.lit(_DEC_UNITS[-1])), F.lit(" " + _DEC_PREFIXES[-1])))


def format_datetime(ts: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC; NULL -> dash."""
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(MISSING_MARK))


def format_text(x: Column | str, is_bool: bool = False) -> Column:
    """Plain text; booleans render as ``True`` / ``False``; NULL -> dash."""
    v = _c(x)
    if is_bool:
        v = F.when(v, F.lit("True")).when(~v, F.lit("False"))
    return F.coalesce(v.cast("string"), F.lit(MISSING_MARK))


format_badge = format_text


def triage_error(message: Column | str) -> Column:
    """Classify an extraction error: missing / denied / unreadable (first match wins)."""
    low = F.lower(_c(message))

    def any_of(*words):
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        return cond

    # fixed trigger words, in checking order
    return (
        F.when(low.isNull(), F.lit(None).cast("string"))
        .when(any_of("not found", "no such", "does not exist"), F.lit("missing"))
        .when(any_of("permission", "forbidden", "access"), F.lit("denied"))
        .otherwise(F.lit("unreadable"))
    )


def triage_message(message: Column | str, fmt: Column | str) -> Column:
    """Full diagnostic text for a failed preview."""
    m = _c(message)
    t = triage_error(m)
    return (
        F.when(t == "missing", F.concat(F.lit("URI unreachable — the path does not exist or is not accessible: "), m))
        .when(t == "denied", F.concat(F.lit("URI unreachable — permission denied: "), m))
        .when(t == "unreadable", F.concat(F.lit("Failed to read "), _c(fmt), F.lit(" data: "), m))
    )
