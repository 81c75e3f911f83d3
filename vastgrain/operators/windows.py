"""Projections, ranges and windows. All are Column expressions, so filters and column lists reach the scan.

Bounds: ``range_search`` is inclusive; windows are half-open; bins of some width are in a window when they overlap it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise KeyError naming what is missing and what there is."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def _pick(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    if columns is None:
        return df
    check_columns(df, columns)
    return df.select(*columns)


def range_search(df: DataFrame, column: str, lo: float, hi: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose value lies in [lo, hi]; null and NaN never match; a text column is an error. The column joins the projection."""
    check_columns(df, [column])
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{column} is {kind.simpleString()}, not a number")
    wanted = None if columns is None else list(dict.fromkeys([*columns, column]))
    return _pick(df.filter(F.col(column).between(lo, hi)), wanted)


def half_open(column: str | Column, lo, hi) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c >= lo) & (c < hi)


def lazy_window(df: DataFrame, x: str, x0, x1, y: str | None = None, y0=None, y1=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in [x0, x1) and, with ``y``, in [y0, y1); filtered before the projection, so bounds needn't be selected."""
    cond = half_open(x, x0, x1)
    if y is not None:
        cond = cond & half_open(y, y0, y1)
    return _pick(df.filter(cond), columns)


def overlap_window(df: DataFrame, window: tuple[int, int, int, int], width: int, x: str = "x", y: str = "y", gene: str = "gene", genes: Sequence[str] | None = None) -> DataFrame:
    """Bins of ``width`` that overlap (x0, x1, y0, y1): x > x0 - width and x < x1, with the low bound not under 0."""
    x0, x1, y0, y1 = window
    cond = half_open(x, max(0, x0 - width + 1), x1) & half_open(y, max(0, y0 - width + 1), y1)
    if genes is not None:
        cond = cond & F.col(gene).isin(list(genes))
    return df.filter(cond)


def stride_rows(df: DataFrame, index: str | Column, lo: int, stride: int) -> DataFrame:
    """The rows whose place is ``lo`` plus a multiple of ``stride``; the place is a column, since rows have no order of their own."""
    i = F.col(index) if isinstance(index, str) else index
    return df.filter(F.pmod(i - F.lit(lo), F.lit(stride)) == 0)


def compare(column: str, op: str, value) -> Column:
    """One comparison out of <, <=, >, >=, ==, !=; null never matches."""
    c = F.col(column)
    return {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "==": c == value, "!=": c != value}[op]


def describe_values(df: DataFrame, column: str, lo, hi, value: str, op: str, bound) -> DataFrame:
    """Rows, first, last, smallest and largest value of a half-open range that also meet one comparison."""
    return df.filter(half_open(column, lo, hi) & compare(value, op, bound)).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("first"), F.max(column).alias("last"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def in_polygon(x: str | Column, y: str | Column, points: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: an edge counts when it spans y strictly and crosses right of x."""
    px, py = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    crossings = []
    for k, (xi, yi) in enumerate(points):
        xj, yj = points[k - 1]
        if yi == yj:
            continue
        spans = (F.lit(float(yi)) > py) != (F.lit(float(yj)) > py)
        at = F.lit(float(xj - xi)) * (py - F.lit(float(yi))) / F.lit(float(yj - yi)) + F.lit(float(xi))
        crossings.append(F.when(spans & (px < at), 1).otherwise(0))
    return sum(crossings[1:], crossings[0]) % 2 == 1


def polygon_area(points: Sequence[tuple[float, float]]) -> float:
    """Shoelace area."""
    return abs(sum(points[k - 1][0] * points[k][1] - points[k][0] * points[k - 1][1] for k in range(len(points)))) / 2


def overlap_share(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    """Intersection of two rectangles over the smaller one's area."""
    w = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    least = min((a[1] - a[0]) * (a[3] - a[2]), (b[1] - b[0]) * (b[3] - b[2]))
    return w * h / least if least > 0 else 0.0
