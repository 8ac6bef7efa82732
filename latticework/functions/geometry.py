"""Column expressions on points, boxes and spheres."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(coords: Sequence[str], lows: Sequence[Column | float], highs: Sequence[Column | float]) -> Column:
    """Closed box test; literal bounds reach the Parquet scan as pushed filters. NaN and null are outside."""
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip(coords, lows, highs)])


def distance(coords: Sequence[str], centre: Sequence[Column | float]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - x) * (F.col(c) - x) for c, x in zip(coords, centre)]))


def finite(column: str) -> Column:
    """A coordinate as a double; null if it is null, NaN or infinite."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def rounded(x: Column, digits: int = 5) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def box_around(centre: Column, radius: Column, low: float, high: float) -> tuple[Column, Column]:
    """centre - radius to centre + radius, clipped to the domain."""
    return F.greatest(centre - radius, F.lit(low)), F.least(centre + radius, F.lit(high))


def literals(values: Sequence[float]) -> Column:
    """An array of literal doubles, made by one call of the parser however many there are."""
    return F.expr("array(" + ", ".join(_literal(v) for v in values) + ")")


def _literal(value: float) -> str:
    return f"double('{float(value)!r}')"


def search_right(x: Column | str, bounds: Sequence[float]) -> Column:
    """Number of sorted literal ``bounds`` that are <= x, as a balanced tree of comparisons that stays in generated code.

    ``x`` is a column, or SQL text of one, which is quicker to plan.
    """
    return F.expr(_sql(x, list(bounds), 0, "<")) if isinstance(x, str) else _tree(x, list(bounds), 0, lambda a, b: a < b)


def search_left(x: Column | str, bounds: Sequence[float]) -> Column:
    """Number of sorted literal ``bounds`` that are < x."""
    return F.expr(_sql(x, list(bounds), 0, "<=")) if isinstance(x, str) else _tree(x, list(bounds), 0, lambda a, b: a <= b)


def _sql(x: str, bounds: list, at: int, below: str) -> str:
    if not bounds:
        return str(at)
    m = len(bounds) // 2
    return f"CASE WHEN {x} {below} {_literal(bounds[m])} THEN {_sql(x, bounds[:m], at, below)} ELSE {_sql(x, bounds[m + 1 :], at + m + 1, below)} END"


def _tree(x: Column, bounds: list, at: int, below) -> Column:
    if not bounds:
        return F.lit(at)
    m = len(bounds) // 2
    return F.when(below(x, F.lit(float(bounds[m]))), _tree(x, bounds[:m], at, below)).otherwise(_tree(x, bounds[m + 1 :], at + m + 1, below))


def upper_bound(sorted_array: Column, x: Column) -> Column:
    """Number of array elements <= x; for small tables such as queries, not for points."""
    return F.size(F.filter(sorted_array, lambda b: b <= x))
