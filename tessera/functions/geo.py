"""Spatial expressions over latitude and longitude columns (degrees)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

RADIUS_M = 6371008.8
DEGREE_M = 111_320.0
#: Boundary tolerance of polygons, in degrees.
EDGE = 1e-12
#: Rings of more edges are folded over an array literal, which keeps the plan small.
UNROLLED = 64
_METRICS = {
    "haversine": "haversine",
    "geodesic": "haversine",
    "geodesica": "haversine",
    "geografica": "haversine",
    "metros": "haversine",
    "euclidean": "euclidean",
    "euclidiana": "euclidean",
    "euclidea": "euclidean",
    "l2": "euclidean",
}


def metric_name(name: str | None) -> str:
    """``haversine`` (metres) or ``euclidean`` (degrees) for any accepted spelling."""
    key = (name or "haversine").strip().lower()
    if key not in _METRICS:
        raise EngineError(f"unknown spatial metric: {name}")
    return _METRICS[key]


def unit(name: str | None) -> str:
    return "m" if metric_name(name) == "haversine" else "grados"


def check_point(lat: float, lon: float) -> tuple[float, float]:
    """The point as floats; out of range, not finite or not numeric is an error."""
    try:
        lat, lon = float(lat), float(lon)
    except (TypeError, ValueError) as e:
        raise EngineError(f"not a point: {lat}, {lon}") from e
    if not (math.isfinite(lat) and math.isfinite(lon)) or abs(lat) > 90 or abs(lon) > 180:
        raise EngineError(f"point out of range: {lat}, {lon}")
    return lat, lon


def valid(lat: Column, lon: Column) -> Column:
    """Whether a row has usable coordinates."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres along the great circle; arguments are columns or numbers."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def euclidean(lat1, lon1, lat2, lon2) -> Column:
    """Plain distance in degrees."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    return F.hypot(lat2 - lat1, lon2 - lon1)


def distance(lat: Column, lon: Column, point: tuple[float, float], metric: str | None = None) -> Column:
    f = haversine if metric_name(metric) == "haversine" else euclidean
    return f(lat, lon, *check_point(*point))


def circle_box(point: tuple[float, float], radius: float, metric: str | None = None) -> tuple[float, float, float, float] | None:
    """(south, west, north, east) that holds the circle; None where it wraps over a pole or the date line."""
    lat, lon = check_point(*point)
    if radius < 0:
        raise EngineError("radius must not be negative")
    if metric_name(metric) == "euclidean":
        return lat - radius, lon - radius, lat + radius, lon + radius
    angle = radius / RADIUS_M * 1.002  # a little wider, so rounding never drops an edge point
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90 or angle >= math.pi / 2:
        return None
    turn = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * 1.002
    if lon - turn < -180 or lon + turn > 180:
        return None
    return south, lon - turn, north, lon + turn


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def within(lat: Column, lon: Column, point: tuple[float, float], radius: float, metric: str | None = None, strict: bool = False) -> Column:
    """Distance test with a box in front of it, which Parquet statistics can use to skip row groups."""
    d = distance(lat, lon, point, metric)
    test = d < radius if strict else d <= radius
    box = circle_box(point, radius, metric)
    return test if box is None else in_box(lat, lon, box) & test


def _ring(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = [check_point(*p) for p in ring]
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    if len(points) < 3:
        raise EngineError("a polygon needs three points")
    return points


def ring_box(ring: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    lats, lons = zip(*_ring(ring))
    return min(lats), min(lons), max(lats), max(lons)


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule, with the boundary inside."""
    points = _ring(ring)
    edges = list(zip(points, points[1:] + points[:1]))
    south, west, north, east = ring_box(points)
    box = in_box(lat, lon, (south - EDGE, west - EDGE, north + EDGE, east + EDGE))

    def touches(a, b, c, d) -> Column:
        cross = (lat - a) * (d - b) - (lon - b) * (c - a)
        return (
            (F.abs(cross) <= EDGE)
            & (lat >= F.least(a, c) - EDGE)
            & (lat <= F.greatest(a, c) + EDGE)
            & (lon >= F.least(b, d) - EDGE)
            & (lon <= F.greatest(b, d) + EDGE)
        )

    def crosses(a, b, c, d) -> Column:
        # a ray to the east along the row's latitude
        return ((a > lat) != (c > lat)) & (lon < (d - b) * (lat - a) / F.nullif(c - a, F.lit(0.0)) + b)

    if len(edges) <= UNROLLED:
        on, odd = F.lit(False), F.lit(0)
        for (a, b), (c, d) in edges:
            args = [F.lit(x) for x in (a, b, c, d)]
            on = on | touches(*args)
            if a != c:
                odd = odd + crosses(*args).cast("int")
        return box & (on | (odd % 2 == 1))
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((*p, *q), "abcd")]) for p, q in edges])
    on = F.exists(table, lambda e: touches(e["a"], e["b"], e["c"], e["d"]))
    odd = F.aggregate(table, F.lit(0), lambda n, e: n + F.coalesce(crosses(e["a"], e["b"], e["c"], e["d"]), F.lit(False)).cast("int"))
    return box & (on | (odd % 2 == 1))


def area(ring: list[tuple[float, float]]) -> float:
    """Planar area in square degrees."""
    p = _ring(ring)
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, p[1:] + p[:1]))) / 2


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS_M * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def perimeter(ring: list[tuple[float, float]]) -> float:
    """Metres around the ring."""
    p = _ring(ring)
    return sum(_metres(a, b) for a, b in zip(p, p[1:] + p[:1]))


def degrees_box(point: tuple[float, float], radius_m: float) -> tuple[float, float, float, float]:
    """The map panel's simple box: 111 320 m a degree, longitude scaled by the cosine (0.01 at least)."""
    lat, lon = check_point(*point)
    dlat = radius_m / DEGREE_M
    dlon = dlat / max(0.01, math.cos(math.radians(lat)))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def cell(lat: Column, lon: Column, degrees: float = 0.05) -> Column:
    """Grid cell for layout: tables written by it let box filters skip files."""
    return F.concat_ws("_", F.floor(lat / degrees), F.floor(lon / degrees))
