"""Pixels to sky positions and back, for common projections, as closed-form columns. Angles are degrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.numeric import _c

PROJECTIONS = ("-CAR", "-TAN", "-SIN", "-ARC")


@dataclass
class Wcs:
    """Reference position and pixel, degrees a pixel, rotation, projection."""

    xref: float
    yref: float
    xpix: float
    ypix: float
    xinc: float
    yinc: float
    rotation: float = 0.0
    projection: str = "-TAN"

    def __post_init__(self):
        if self.projection not in PROJECTIONS:
            raise ValueError(f"projection {self.projection!r} is not one of {PROJECTIONS}")


def sky_of(w: Wcs, x, y) -> tuple[Column, Column]:
    """Right ascension (0 to 360) and declination of a pixel; NULL off the sky."""
    t = F.radians(F.lit(w.rotation))
    dx, dy = (_c(x) - w.xpix) * w.xinc, (_c(y) - w.ypix) * w.yinc
    u, v = dx * F.cos(t) - dy * F.sin(t), dy * F.cos(t) + dx * F.sin(t)
    if w.projection == "-CAR":
        return F.pmod(w.xref + u, F.lit(360.0)), w.yref + v
    ra0, dec0 = F.radians(F.lit(w.xref)), F.radians(F.lit(w.yref))
    l, m = F.radians(u), F.radians(v)
    r = F.sqrt(l * l + m * m)
    if w.projection == "-TAN":
        depth, side, good = 1 / F.sqrt(1 + r * r), 1 / F.sqrt(1 + r * r), F.lit(True)
    elif w.projection == "-SIN":
        good = r <= 1
        depth, side = F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)), F.lit(1.0)
    else:
        good = r <= F.pi()
        depth, side = F.cos(r), F.when(r == 0, 1.0).otherwise(F.sin(r) / F.when(r == 0, 1.0).otherwise(r))
    ml, mm = l * side, m * side
    dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mm * F.cos(dec0) + depth * F.sin(dec0))))
    ra = ra0 + F.atan2(ml, depth * F.cos(dec0) - mm * F.sin(dec0))
    return F.when(good, F.pmod(F.degrees(ra), F.lit(360.0))), F.when(good, F.degrees(dec))


def pixel_of(w: Wcs, ra, dec) -> tuple[Column, Column]:
    """Pixel of a sky position; NULL on the far side of the sky for -TAN and -SIN."""
    t = F.radians(F.lit(w.rotation))
    good = F.lit(True)
    if w.projection == "-CAR":
        u = F.pmod(_c(ra) - w.xref + 180, F.lit(360.0)) - 180
        v = _c(dec) - w.yref
    else:
        da, d, d0 = F.radians(_c(ra) - w.xref), F.radians(_c(dec)), F.radians(F.lit(w.yref))
        l, m = F.cos(d) * F.sin(da), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da)
        c = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(da)
        if w.projection == "-ARC":
            s = F.sqrt(l * l + m * m)
            stretch = F.when(s == 0, 1.0).otherwise(F.atan2(s, c) / F.when(s == 0, 1.0).otherwise(s))
        else:
            good = c > 0
            stretch = 1 / F.when(good, c) if w.projection == "-TAN" else F.lit(1.0)
        u, v = F.degrees(l * stretch), F.degrees(m * stretch)
    dx, dy = u * F.cos(t) + v * F.sin(t), v * F.cos(t) - u * F.sin(t)
    return F.when(good, dx / w.xinc + w.xpix), F.when(good, dy / w.yinc + w.ypix)
