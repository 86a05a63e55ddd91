"""Rectangles (x0, y0, x1, y1; y grows downwards) as Column expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

x0, y0, x1, y1 = (lambda b, i=i: F.get(b, F.lit(i)) for i in range(4))


def box(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.array(*(x.cast("double") for x in (a, b, c, d)))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), x1(b) - x0(b))


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), y1(b) - y0(b))


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (x0(b) + x1(b)) / 2


def center_y(b: Column) -> Column:
    return (y0(b) + y1(b)) / 2


def intersection(a: Column, b: Column) -> Column:
    w = F.least(x1(a), x1(b)) - F.greatest(x0(a), x0(b))
    h = F.least(y1(a), y1(b)) - F.greatest(y0(a), y0(b))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def inner_overlap(a: Column, b: Column) -> Column:
    """The intersection's share of the smaller rectangle."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def overlap_of_first(a: Column, b: Column) -> Column:
    """The intersection's share of ``a``."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """The common width's share of the narrower rectangle."""
    return F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least(x1(a), x1(b)) - F.greatest(x0(a), x0(b))), F.least(width(a), width(b))), F.lit(0.0))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), y0(b) - y1(a), y0(a) - y1(b))


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), x0(b) - x1(a), x0(a) - x1(b))


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(x0(a), x0(b)), F.least(y0(a), y0(b)), F.greatest(x1(a), x1(b)), F.greatest(y1(a), y1(b)))


def expanded(b: Column, dx: Column | float, dy: Column | float) -> Column:
    return F.array(x0(b) - dx, y0(b) - dy, x1(b) + dx, y1(b) + dy)


def contains_center(outer: Column, inner: Column) -> Column:
    return center_x(inner).between(x0(outer), x1(outer)) & center_y(inner).between(y0(outer), y1(outer))


def clamped(b: Column, page_width: Column, page_height: Column) -> Column:
    """Inside the page, where its size is known."""
    inside = lambda v, most: F.when(most > 0, F.least(F.greatest(v, F.lit(0.0)), most)).otherwise(F.greatest(v, F.lit(0.0)))
    return F.array(inside(x0(b), page_width), inside(y0(b), page_height), inside(x1(b), page_width), inside(y1(b), page_height))


def union_all(b: Column) -> Column:
    """Aggregate: the rectangle around a group's rectangles."""
    return F.array(F.min(x0(b)), F.min(y0(b)), F.max(x1(b)), F.max(y1(b)))


def column_of(b: Column, page_width: Column, gutter: float = 0.5) -> Column:
    """left, right or full by the rectangle's centre and width."""
    return F.when(width(b) >= 0.72 * page_width, "full").when(center_x(b) < gutter * page_width, "left").otherwise("right")
