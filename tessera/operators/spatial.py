"""Spatial searches: circle, nearest neighbours, polygon, bounds."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import geo
from tessera.workspace import ship

ship()

LAT_NAMES = ("lat", "latitud", "latitude")
LON_NAMES = ("lon", "lng", "longitud", "longitude")
#: Query points that are sent to every task together.
BATCH_POINTS = 100_000


def coordinates(df: DataFrame, lat: str | None = None, lon: str | None = None) -> tuple[str, str]:
    """The coordinate columns, named or by the usual names."""
    low = {c.lower(): c for c in df.columns}
    lat = lat or next((low[n] for n in LAT_NAMES if n in low), None)
    lon = lon or next((low[n] for n in LON_NAMES if n in low), None)
    if not lat or not lon or lat not in df.columns or lon not in df.columns:
        raise EngineError("no coordinate columns")
    return lat, lon


def _placed(df: DataFrame, lat: str, lon: str, d: Column) -> DataFrame:
    return df.withColumns({"_lat": F.col(lat), "_lon": F.col(lon), "_distance": d})


def in_circle(df: DataFrame, point: tuple[float, float], radius: float, metric: str | None = None, strict: bool = False, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Rows in the circle with ``_lat``, ``_lon``, ``_distance``, nearest first."""
    lat, lon = coordinates(df, lat, lon)
    a, o = F.col(lat), F.col(lon)
    found = df.filter(geo.within(a, o, point, radius, metric, strict))
    return _placed(found, lat, lon, geo.distance(a, o, point, metric)).orderBy("_distance")


def nearest(df: DataFrame, point: tuple[float, float], k: int, key: str, metric: str | None = None, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """The k nearest rows; ties by key. Each partition keeps k rows before anything moves."""
    if k < 1:
        raise EngineError("k must be 1 or more")
    lat, lon = coordinates(df, lat, lon)
    d = geo.distance(F.col(lat), F.col(lon), point, metric)
    usable = df.filter(geo.valid(F.col(lat), F.col(lon)))
    return _placed(usable, lat, lon, d).orderBy(F.col("_distance").asc(), F.col(key).asc()).limit(k)


def in_polygon(df: DataFrame, ring: list[tuple[float, float]], lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Rows in the polygon, boundary included, by latitude and longitude."""
    lat, lon = coordinates(df, lat, lon)
    return df.filter(geo.in_polygon(F.col(lat), F.col(lon), ring)).withColumns({"_lat": F.col(lat), "_lon": F.col(lon)}).orderBy("_lat", "_lon")


def bounds(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """One row: south, west, north, east and the number of usable points."""
    lat, lon = coordinates(df, lat, lon)
    a, o = F.col(lat), F.col(lon)
    return df.filter(geo.valid(a, o)).agg(F.min(a).alias("south"), F.min(o).alias("west"), F.max(a).alias("north"), F.max(o).alias("east"), F.count(F.lit(1)).alias("n_points"))


def points(df: DataFrame, label: str, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """All usable points with a label, for a map."""
    lat, lon = coordinates(df, lat, lon)
    return df.filter(geo.valid(F.col(lat), F.col(lon))).select(F.col(label).alias("label"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def panel(df: DataFrame, kind: str, key: str, point: tuple[float, float] | None = None, radius_m: float = 0.0, k: int = 10, ring: list[tuple[float, float]] | None = None, metric: str | None = None) -> DataFrame:
    """The map panel's query: ``range`` (radius in metres for both metrics), ``knn`` or ``polygon``."""
    if kind == "range":
        radius = radius_m / geo.DEGREE_M if geo.metric_name(metric) == "euclidean" else radius_m
        return in_circle(df, point, radius, metric)
    if kind == "knn":
        return nearest(df, point, k, key, metric)
    if kind == "polygon":
        return in_polygon(df, ring)
    raise EngineError(f"unknown spatial query: {kind}")


def nearest_batch(df: DataFrame, queries: list[tuple[int, float, float]], k: int, key: str, metric: str | None = None, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """(query, key, distance, rank) of the k nearest rows to each of many points.

    Points travel to the rows (at most BATCH_POINTS of them); every batch of rows keeps k per point.
    """
    if len(queries) > BATCH_POINTS:
        raise EngineError("too many query points for one call")
    lat, lon = coordinates(df, lat, lon)
    name = geo.metric_name(metric)
    q = np.array([(a, b) for _, a, b in queries], float).reshape(-1, 2)
    ids = np.array([i for i, _, _ in queries], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros(0)] * len(q), [np.zeros(0, np.int64)] * len(q)
        for b in batches:
            p, key_ = b[["a", "o"]].to_numpy(float), b["k"].to_numpy(np.int64)
            for i in range(len(q)):
                if name == "haversine":
                    x, y = np.radians(q[i]), np.radians(p)
                    h = np.sin((y[:, 0] - x[0]) / 2) ** 2 + np.cos(x[0]) * np.cos(y[:, 0]) * np.sin((y[:, 1] - x[1]) / 2) ** 2
                    d = 2 * geo.RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
                else:
                    d = np.hypot(*(p - q[i]).T)
                all_d, all_k = np.r_[best[0][i], d], np.r_[best[1][i], key_]
                o = np.lexsort((all_k, all_d))[:k]
                best[0][i], best[1][i] = all_d[o], all_k[o]
        for i in range(len(q)):
            if len(best[0][i]):
                yield pd.DataFrame({"query": ids[i], "key": best[1][i], "distance": best[0][i]})

    rows = df.filter(geo.valid(F.col(lat), F.col(lon))).select(F.col(key).cast("bigint").alias("k"), F.col(lat).alias("a"), F.col(lon).alias("o"))
    w = Window.partitionBy("query").orderBy("distance", "key")
    return rows.mapInPandas(run, "query bigint, key bigint, distance double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def clustered_points(n: int, seed: int = 17, spread_km: float = 25.0, centre: tuple[float, float] = (-12.0464, -77.0428), spots: int = 8, uniform: float = 0.2) -> list[tuple[float, float]]:
    """Points around hotspots near a centre, some of them spread evenly."""
    rng = random.Random(seed)
    degrees = spread_km * 1000 / geo.DEGREE_M
    hot = [(centre[0] + rng.uniform(-degrees, degrees), centre[1] + rng.uniform(-degrees, degrees)) for _ in range(spots)]
    out = []
    for _ in range(n):
        if rng.random() < uniform:
            p = centre[0] + rng.uniform(-degrees, degrees), centre[1] + rng.uniform(-degrees, degrees)
        else:
            a, o = rng.choice(hot)
            p = rng.gauss(a, degrees / 12), rng.gauss(o, degrees / 12)
        out.append((max(-90.0, min(90.0, p[0])), max(-180.0, min(180.0, p[1]))))
    return out
