"""Vector cells: reductions within a row, element access and element-wise work. NULL elements are skipped by reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.numeric import _c


def _known(v) -> Column:
    return F.filter(_c(v), lambda x: x.isNotNull())


def _reduced(v, start: Column, step, finish=None) -> Column:
    known = _known(v)
    return F.when(F.size(known) > 0, F.aggregate(known, start, step, finish) if finish else F.aggregate(known, start, step))


def vec_sum(v, kind: str = "double") -> Column:
    """NULL if all elements are; booleans count as 0 and 1."""
    return _reduced(v, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def vec_mean(v) -> Column:
    known = _known(v)
    return vec_sum(v) / F.size(known)


def vec_std(v) -> Column:
    """Sample deviation; 0 for one element or none."""
    known, mean = _known(v), vec_mean(v)
    squares = F.aggregate(F.zip_with(known, F.array_repeat(mean, F.size(known)), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 1, F.sqrt(squares / (F.size(known) - 1))).otherwise(F.lit(0.0))


def vec_median(v) -> Column:
    """The lower median, of the elements' own type."""
    known = F.sort_array(_known(v))
    return F.get(known, F.floor((F.size(known) - 1) / 2).cast("int"))


def vec_min(v) -> Column:
    return F.array_min(_c(v))


def vec_max(v) -> Column:
    return F.array_max(_c(v))


def n_elements(v) -> Column:
    return F.size(_c(v)).cast("long")


def n_valid(v) -> Column:
    return F.size(_known(v)).cast("long")


def element(v, *index: int, shape: tuple[int, ...] = ()) -> Column:
    """One element, counted from 1, the first index running fastest; an error outside the cell."""
    at, step = 0, 1
    for k, i in enumerate(index):
        if shape and not 1 <= i <= shape[k]:
            raise IndexError(f"index {i} outside 1..{shape[k]}")
        at += (i - 1) * step
        step *= shape[k] if shape else 1
    return F.element_at(_c(v), F.lit(at + 1))


def plane(v, shape: tuple[int, ...], last: int) -> Column:
    """The cell of one less dimension at a place of the last index."""
    n = 1
    for s in shape[:-1]:
        n *= s
    return F.slice(_c(v), F.lit((last - 1) * n + 1), F.lit(n))


def each(v, f) -> Column:
    return F.transform(_c(v), f)


def both(a, b, f) -> Column:
    """Element by element of two cells of one size."""
    return F.zip_with(_c(a), _c(b), f)


def scaled(v, scale: float = 1.0, zero: float = 0.0) -> Column:
    """Stored values to physical ones: first times scale, then plus zero."""
    return F.transform(_c(v), lambda x: x.cast("double") * scale + zero)


def resized(v, n: int, fill) -> Column:
    """A cell of n elements: cut, or filled up."""
    return F.slice(F.concat(_c(v), F.array_repeat(F.lit(fill), n)), F.lit(1), F.lit(n))
