"""Scalar functions where Spark's own differ from the host database: nulls, rounding, patterns.

All are expressions of built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).asc_nulls_last()


def desc(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).desc_nulls_last()


def strlen(s: Column) -> Column:
    """Bytes of a string."""
    return F.octet_length(s).cast("bigint")


def length(s: Column) -> Column:
    """Characters of a string."""
    return F.length(s).cast("bigint")


def substring(s: Column, start: int, size: int) -> Column:
    """From 1; a start of 0 is one before the first, a negative one counts from the end; a negative length takes what stands before the start."""
    if start > 0 <= size:
        return F.substring(s, start, size)
    begin = F.lit(start - 1) if start >= 0 else F.length(s) + start
    low, high = (begin, begin + size) if size >= 0 else (begin + size, begin)
    low = F.greatest(low, F.lit(0))
    return F.substring(s, low + 1, F.greatest(high - low, F.lit(0)))


def like(s: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash stands for itself."""
    return s.like(pattern.replace("\\", "\\\\"))


def contains(s: Column, part: str) -> Column:
    return s.contains(part)


def prefix(s: Column, part: str) -> Column:
    return s.startswith(part)


def suffix(s: Column, part: str) -> Column:
    return s.endswith(part)


def _java_pattern(pattern: str) -> str:
    """The pattern as Java reads it: `$` is the end of the text only, and `.` any character but a line feed."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append("\\z" if c == "$" and not inside else c)
        k += 1
    return "(?d)" + "".join(out)


def _java_replacement(replacement: str, before: int) -> str:
    r"""\0 to \9 as groups that `before` others stand before, all else as it is."""
    parts = re.split(r"\\(\d|\\)", replacement)
    literal = lambda x: re.sub(r"([\\$0-9])", r"\\\1", x)  # noqa: E731  digits too, which could join a group's number
    return "".join(literal(x) if k % 2 == 0 else "\\\\" if x == "\\" else f"${int(x) + before}" for k, x in enumerate(parts))


def regexp_replace(s: Column, pattern: str, replacement: str, everywhere: bool = False) -> Column:
    r"""Replace the first match, or all; \1 in the replacement is the first group, \0 the match."""
    if everywhere:
        # An empty match may not stand where the match before has ended.
        return F.regexp_replace(s, rf"(?>{_java_pattern(pattern)})(?:(?!\G)|\A)", _java_replacement(replacement, 0))
    # What stands before the first match is the first group, the match the second, and the rest of the text isn't looked at again.
    return F.regexp_replace(s, rf"\A((?s:.*?))({_java_pattern(pattern)})", "$1" + _java_replacement(replacement, 2))


def year(t: Column) -> Column:
    return F.year(t).cast("bigint")


def month(t: Column) -> Column:
    return F.month(t).cast("bigint")


def day(t: Column) -> Column:
    return F.dayofmonth(t).cast("bigint")


def hour(t: Column) -> Column:
    return F.hour(t).cast("bigint")


def minute(t: Column) -> Column:
    return F.minute(t).cast("bigint")


def second(t: Column) -> Column:
    return F.second(t).cast("bigint")


def microsecond(t: Column) -> Column:
    """Microseconds since the minute began."""
    return (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def millisecond(t: Column) -> Column:
    """Milliseconds since the minute began."""
    return F.floor(microsecond(t) / 1000).cast("bigint")


def date_trunc(unit: str, t: Column) -> Column:
    """The beginning of the unit; time zones play no part."""
    if unit in ("year", "quarter", "month", "week", "day"):
        return (F.to_date(t) if unit == "day" else F.trunc(F.to_date(t), unit)).cast("timestamp_ntz")
    part = {"second": 1_000_000, "millisecond": 1000, "microsecond": 1}
    if unit not in ("hour", "minute", *part):
        raise ValueError(f"no such unit: {unit}")
    micros = F.lit(0) if unit in ("hour", "minute") else F.floor(microsecond(t) / part[unit]) * part[unit]
    minute_ = F.lit(0) if unit == "hour" else F.minute(t)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), minute_, (micros.cast("decimal(18,0)") / 1_000_000).cast("decimal(16,6)"))


def try_cast(x: Column, kind: str) -> Column:
    """Null where the value can't be cast."""
    return x.try_cast(kind)


def row(*columns: Column) -> Column:
    """A struct whose fields have no names of their own."""
    return F.struct(*[c.alias(f"col{k + 1}") for k, c in enumerate(columns)])


def to_integer(x: Column, kind: str = "bigint", exact: bool = False) -> Column:
    """Rounds: a double's half goes to the even neighbour, a decimal's (exact) away from zero."""
    return (F.round(x, 0) if exact else F.rint(x)).cast(kind)


def integer_division(a: Column, b: Column) -> Column:
    """Truncates; null where the divisor is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def modulo(a: Column, b: Column) -> Column:
    """The sign is the dividend's; null where the divisor is 0."""
    return F.when(b != 0, a % b)


def not_distinct(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
