"""Arithmetic, comparison and geometry as Spark columns.

Where a value is undefined the result is NULL, never an error: division and remainder by zero, logarithms and roots
outside their domain, conversions that overflow. NaN counts as undefined; ``defined`` turns it into NULL at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two numbers closer than this are approximately equal.
NEARLY = 1e-7


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def defined(x, null=None) -> Column:
    """NULL for NaN and for the column's own null value."""
    x = _c(x)
    out = F.when(~F.isnan(x.cast("double")), x)
    return out if null is None else F.when(x != F.lit(null), out)


def plus(a, b) -> Column:
    """Sum; NULL where it overflows. So are minus and times."""
    return F.try_add(_c(a), _c(b))


def minus(a, b) -> Column:
    return F.try_subtract(_c(a), _c(b))


def times(a, b) -> Column:
    return F.try_multiply(_c(a), _c(b))


def int_div(a, b) -> Column:
    """Division of whole numbers, cut toward zero."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.when(b != 0, F.try_divide((a - F.try_mod(a, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)"))).cast("long")


def divide(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def remainder(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return F.try_mod(_c(a), _c(b))


def power(a, b, whole: bool = False) -> Column:
    out = F.pow(_c(a), _c(b))
    return out.try_cast("long") if whole else out


def to_int(x) -> Column:
    """Cut toward zero; NULL where it doesn't fit."""
    return _c(x).try_cast("long")


def square_root(x) -> Column:
    x = _c(x)
    return F.when(x >= 0, F.sqrt(x))


def natural_log(x) -> Column:
    x = _c(x)
    return F.when(x > 0, F.log(x))


def decimal_log(x) -> Column:
    x = _c(x)
    return F.when(x > 0, F.log10(x))


def arc_sine(x) -> Column:
    x = _c(x)
    return F.when(F.abs(x) <= 1, F.asin(x))


def arc_cosine(x) -> Column:
    x = _c(x)
    return F.when(F.abs(x) <= 1, F.acos(x))


def round_up_half(x) -> Column:
    """floor(x + 0.5) as a double, so -2.5 becomes -2."""
    return F.floor(_c(x) + 0.5).cast("double")


def whole_floor(x) -> Column:
    return F.floor(_c(x)).cast("double")


def whole_ceil(x) -> Column:
    return F.ceil(_c(x)).cast("double")


def nearly_equal(a, b) -> Column:
    return F.abs(_c(a) - _c(b)) < NEARLY


def near(a, b, tolerance) -> Column:
    return F.abs(_c(a) - _c(b)) < _c(tolerance)


def within(x, low, high) -> Column:
    """Between, both ends included."""
    return _c(x).between(_c(low), _c(high))


def choose(condition, yes, no) -> Column:
    """NULL where the condition is."""
    condition = _c(condition)
    return F.when(condition.isNull(), None).when(condition, _c(yes)).otherwise(_c(no))


def default_null(x, other) -> Column:
    return F.coalesce(_c(x), _c(other))


def as_number(condition) -> Column:
    """A condition as 0 or 1, for products."""
    return _c(condition).cast("int")


def lesser(*xs) -> Column:
    """The least that is not NULL."""
    return F.least(*map(_c, xs))


def greater(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Angle between two positions, all in degrees, by the haversine."""
    ra1, dec1, ra2, dec2 = (F.radians(_c(x)) for x in (ra1, dec1, ra2, dec2))
    a = F.pow(F.sin((dec2 - dec1) / 2), 2) + F.cos(dec1) * F.cos(dec2) * F.pow(F.sin((ra2 - ra1) / 2), 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.degrees(2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def _turned(x, y, xc, yc, angle) -> tuple[Column, Column]:
    """Offsets from a centre, in axes turned by an angle in degrees."""
    dx, dy, t = _c(x) - _c(xc), _c(y) - _c(yc), F.radians(_c(angle).cast("double"))
    return dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)


def in_circle(xc, yc, r, x, y) -> Column:
    return F.pow(_c(x) - _c(xc), 2) + F.pow(_c(y) - _c(yc), 2) <= _c(r) * _c(r)


def in_box(xc, yc, width, height, angle, x, y) -> Column:
    u, v = _turned(x, y, xc, yc, angle)
    return (F.abs(u) <= _c(width) / 2) & (F.abs(v) <= _c(height) / 2)


def in_ellipse(xc, yc, a, b, angle, x, y) -> Column:
    u, v = _turned(x, y, xc, yc, angle)
    return F.pow(u / _c(a), 2) + F.pow(v / _c(b), 2) <= 1.0


def uniform(seed: int | None = None) -> Column:
    return F.rand(seed)


def normal(seed: int | None = None) -> Column:
    return F.randn(seed)


def poisson(mean, seed: int = 0) -> Column:
    """Whole Poisson numbers for means up to about 700: the count of uniform products before they fall below exp(-mean),
    by inversion of one uniform number through the running distribution."""
    mean = _c(mean).cast("double")
    u = F.rand(seed)
    top = F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).cast("long").alias("n"), u.alias("u"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["sum"] + s["p"] * mean / k).alias("sum"), (s["n"] + F.when(s["u"] > s["sum"], 1).otherwise(0)).cast("long").alias("n"), s["u"].alias("u"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["n"])
