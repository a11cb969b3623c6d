"""Region shapes as conditions on x and y. Angles are degrees, counted from the x axis; edges belong to the shape."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.numeric import _c, _turned, in_box, in_circle, in_ellipse

EDGE = 1e-10


def _polar(x, y, xc, yc) -> Column:
    """Angle of a point around a centre, 0 to 360."""
    a = F.degrees(F.atan2(_c(y) - yc, _c(x) - xc))
    return F.when(a < 0, a + 360).otherwise(a)


def _between_angles(a: Column, low: float, high: float) -> Column:
    low, high = low % 360, high if high == 360 else high % 360
    return a.between(low, high) if low <= high else (a >= low) | (a <= high)


def point(x, y, xc, yc):
    dx, dy = _c(x) - xc, _c(y) - yc
    return (dx >= -0.5) & (dx < 0.5) & (dy >= -0.5) & (dy < 0.5)


def line(x, y, x1, y1, x2, y2):
    """Half a pixel wide on both sides."""
    length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
    if not length:
        return point(x, y, x1, y1)
    u = ((_c(x) - x1) * (x2 - x1) + (_c(y) - y1) * (y2 - y1)) / length
    v = ((_c(y) - y1) * (x2 - x1) - (_c(x) - x1) * (y2 - y1)) / length
    return (v >= -0.5) & (v < 0.5) & (u >= -0.5) & (u < length)


def circle(x, y, xc, yc, r):
    return in_circle(xc, yc, r, x, y)


def annulus(x, y, xc, yc, inner, outer):
    d = F.pow(_c(x) - xc, 2) + F.pow(_c(y) - yc, 2)
    return (d >= inner * inner) & (d <= outer * outer)


def ellipse(x, y, xc, yc, a, b, angle=0.0):
    return in_ellipse(xc, yc, a, b, angle, x, y)


def elliptannulus(x, y, xc, yc, a1, b1, a2, b2, angle=0.0, outer_angle=None):
    u, v = _turned(x, y, xc, yc, angle)
    return (F.pow(u / a1, 2) + F.pow(v / b1, 2) >= 1.0) & in_ellipse(xc, yc, a2, b2, angle if outer_angle is None else outer_angle, x, y)


def box(x, y, xc, yc, width, height, angle=0.0):
    return in_box(xc, yc, width, height, angle, x, y)


def boxannulus(x, y, xc, yc, w1, h1, w2, h2, angle=0.0, inner_angle=None):
    return in_box(xc, yc, w2, h2, angle, x, y) & ~in_box(xc, yc, w1, h1, angle if inner_angle is None else inner_angle, x, y)


def rectangle(x, y, x1, y1, x2, y2, angle=0.0):
    """By two corners, turned around its centre."""
    return in_box((x1 + x2) / 2, (y1 + y2) / 2, abs(x2 - x1), abs(y2 - y1), angle, x, y)


def diamond(x, y, xc, yc, width, height, angle=0.0):
    u, v = _turned(x, y, xc, yc, angle)
    return F.abs(u / (width / 2)) + F.abs(v / (height / 2)) <= 1


def sector(x, y, xc, yc, low, high):
    """The centre counts as inside."""
    return ((_c(x) == xc) & (_c(y) == yc)) | _between_angles(_polar(x, y, xc, yc), low, high)


def polygon(x, y, *corners):
    """Crossings of a ray; points on an edge are inside."""
    x, y = _c(x), _c(y)
    points = list(zip(corners[::2], corners[1::2], strict=True))
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        crosses = F.lit(False) if y1 == y2 else ((y < max(y1, y2)) & (y >= min(y1, y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1))
        crossings = crossings + crosses.cast("int")
        area = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((F.abs(area) <= EDGE) & x.between(min(x1, x2) - EDGE, max(x1, x2) + EDGE) & y.between(min(y1, y2) - EDGE, max(y1, y2) + EDGE))
    return on_edge | (crossings % 2 == 1)


def panda(x, y, xc, yc, low, high, n_angle, inner, outer, n_radius):
    """Part of a ring; the numbers of parts say only how the whole was divided."""
    return annulus(x, y, xc, yc, inner, outer) & sector(x, y, xc, yc, low, high)


def epanda(x, y, xc, yc, low, high, n_angle, a1, b1, a2, b2, n_radius, angle=0.0):
    u, v = _turned(x, y, xc, yc, angle)
    turned = F.degrees(F.atan2(v, u))
    a = F.when(turned < 0, turned + 360).otherwise(turned)
    return in_ellipse(xc, yc, a2, b2, angle, x, y) & ~in_ellipse(xc, yc, a1, b1, angle, x, y) & _between_angles(a, low, high)


def bpanda(x, y, xc, yc, low, high, n_angle, w1, h1, w2, h2, n_radius, angle=0.0):
    u, v = _turned(x, y, xc, yc, angle)
    turned = F.degrees(F.atan2(v, u))
    a = F.when(turned < 0, turned + 360).otherwise(turned)
    return in_box(xc, yc, w2, h2, angle, x, y) & ~in_box(xc, yc, w1, h1, angle, x, y) & _between_angles(a, low, high)


SHAPES = {f.__name__: f for f in (point, line, circle, annulus, ellipse, elliptannulus, box, boxannulus, rectangle, diamond, sector, polygon, panda, epanda, bpanda)}
#: Other names that region files use for the same shapes; fixed values.
ALIASES = {"rotbox": "box", "rotrectangle": "rectangle", "rotdiamond": "diamond", "rhombus": "diamond", "rotrhombus": "diamond", "pie": "sector"}


def in_region(shapes: list[tuple[str, str, tuple]], x, y) -> Column:
    """``shapes``: (sign, name, parameters) in order. Includes add and excludes remove; an exclude that comes first
    takes from everything."""
    inside = None
    for sign, name, parameters in shapes:
        name = ALIASES.get(name.lower(), name.lower())
        if name == "ellipse" and len(parameters) >= 6:
            name = "elliptannulus"
        if name == "box" and len(parameters) >= 6:
            name = "boxannulus"
        one = SHAPES[name](x, y, *parameters)
        if sign == "-":
            inside = (F.lit(True) if inside is None else inside) & ~one
        else:
            inside = one if inside is None else inside | one
    return F.lit(False) if inside is None else inside


def any_region(components: list[list], x, y) -> Column:
    return reduce(lambda a, b: a | b, (in_region(c, x, y) for c in components))


def read_region_lines(lines: list[str]) -> list[tuple[str, str, tuple]]:
    """Shapes of a region file in pixel coordinates: [+-]name(a, b, ...), # comments, several to a line with ;."""
    out = []
    for piece in (p for text in lines for p in text.split("#")[0].split(";")):
        if m := re.fullmatch(r"\s*(?:image|physical|linear)?\s*([+\-!]?)\s*([a-zA-Z]+)\s*\(([^)]*)\)\s*", piece):
            out.append(("-" if m[1] in "-!" and m[1] else "+", m[2].lower(), tuple(float(v) for v in re.split(r"[,\s]+", m[3].strip()))))
    return out
