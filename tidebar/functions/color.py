"""Colours as #RRGGBBAA text; transparency runs from 0 (opaque) to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column, transparency: Column | None = None) -> Column:
    alpha = F.round(255 * (1 - (F.lit(0) if transparency is None else transparency) / 100)).cast("int")
    channel = lambda x: F.round(F.greatest(F.lit(0), F.least(x, F.lit(255)))).cast("int")
    return F.format_string("#%02X%02X%02X%02X", channel(r), channel(g), channel(b), alpha)


def cast(x: Column) -> Column:
    """A colour as it is, a text or number as the text of a colour; NULL stays."""
    return x.cast("string")


def _channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")


def red(c: Column) -> Column:
    return _channel(c, 0)


def green(c: Column) -> Column:
    return _channel(c, 1)


def blue(c: Column) -> Column:
    return _channel(c, 2)


def transparency(c: Column) -> Column:
    return F.round(100 * (1 - _channel(c, 3) / 255)).cast("int")


def new(c: Column, transp: Column) -> Column:
    return rgb(red(c), green(c), blue(c), transp)


def from_gradient(value: Column, low: Column, high: Column, at_low: Column, at_high: Column) -> Column:
    """The colour between two by where a value lies between two bounds."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))
    mix = lambda f: f(at_low) + (f(at_high) - f(at_low)) * share
    return rgb(mix(red), mix(green), mix(blue), mix(transparency))
