"""String functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tostring(x: Column, decimals: int | None = None) -> Column:
    """A number with so many decimals, or as it is."""
    return F.coalesce(F.format_string(f"%.{decimals}f", x.cast("double")) if decimals is not None else x.cast("string"), F.lit("NaN"))


def volume(x: Column) -> Column:
    """Thousands, millions and billions as K, M and B with three decimals at most."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.3f", x / d), r"\.?0+$", ""), F.lit(unit))
    return F.when(x >= 1e9, short(1e9, "B")).when(x >= 1e6, short(1e6, "M")).when(x >= 1e3, short(1e3, "K")).otherwise(short(1, ""))


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.2f", x), F.lit("%"))


def format_(template: str, *args: Column) -> Column:
    """{k} stands for the k-th argument, {k,#.00} for it with so many decimals."""
    parts: list[Column] = []
    for text, k, spec in re.findall(r"([^{]*)(?:\{(\d+)(?:,([^}]*))?\})?", template):
        if text:
            parts.append(F.lit(text))
        if k:
            decimals = len(spec.partition(".")[2]) if spec else None
            parts.append(tostring(args[int(k)], decimals))
    return F.concat(*parts) if parts else F.lit("")


def format_time(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), F.timestamp_millis(ms).cast("timestamp_ntz")), pattern)


def replace_first(x: Column, target: str, replacement: str) -> Column:
    at = F.locate(target, x)
    return F.when((at > 0) & F.lit(bool(target)), F.overlay(x, F.lit(replacement), at, F.lit(len(target)))).otherwise(x)


def replace_all(x: Column, target: str, replacement: str) -> Column:
    return F.replace(x, F.lit(target), F.lit(replacement)) if target else x


def contains(x: Column, y: Column) -> Column:
    return F.contains(x, y)


def startswith(x: Column, y: Column) -> Column:
    return F.startswith(x, y)


def endswith(x: Column, y: Column) -> Column:
    return F.endswith(x, y)


def length(x: Column) -> Column:
    return F.char_length(x)


def substring(x: Column, begin: Column, end: Column | None = None) -> Column:
    """From begin (0-based) up to end, both held to the text's length."""
    size = F.char_length(x)
    begin = F.greatest(F.lit(0), F.least(begin, size))
    end = size if end is None else F.greatest(begin, F.least(end, size))
    return F.substring(x, begin + 1, end - begin)


def split(x: Column, separator: str = ",") -> Column:
    return F.split(x, re.escape(separator) if separator else "$^", -1) if separator else F.array(x)


def join(x: Column, separator: str = ", ") -> Column:
    return F.array_join(x, separator)


def repeat(x: Column, n: Column) -> Column:
    return F.repeat(x, F.greatest(F.lit(0), n))


def pos(x: Column, part: Column) -> Column:
    """Where a part first stands, from 0; -1 if nowhere."""
    return F.instr(x, part) - 1


def match(x: Column, pattern: str) -> Column:
    """Whether the expression matches somewhere; NULL if it is no expression."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(None).cast("boolean")
    return x.rlike(pattern)


lower, upper, trim = F.lower, F.upper, F.trim
