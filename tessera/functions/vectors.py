"""Vector expressions over array<double> columns."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

_METRICS = {
    "euclidean": "euclidean",
    "euclidiana": "euclidean",
    "euclidea": "euclidean",
    "l2": "euclidean",
    "cosine": "cosine",
    "coseno": "cosine",
    "cos": "cosine",
    "dot": "dot",
    "dot_product": "dot",
    "producto_punto": "dot",
    "inner_product": "dot",
}


def metric_name(name: str | None) -> str:
    key = (name or "euclidean").strip().lower()
    if key not in _METRICS:
        raise EngineError(f"unknown vector metric: {name}")
    return _METRICS[key]


def parse(text: Column) -> Column:
    """JSON list or comma list to array<double>; empty, scalar or not numeric gives null."""
    t = F.trim(text)
    as_json = F.from_json(t, "array<double>")
    numbers = F.transform(F.split(F.regexp_replace(t, r"^[\[(]|[\])]$", ""), ","), lambda x: F.trim(x).try_cast("double"))
    got = F.coalesce(as_json, numbers)
    fine = (F.size(got) > 0) & ~F.exists(got, lambda x: x.isNull() | F.isnan(x))
    listed = t.startswith("[") | t.contains(",")
    return F.when(t.isNotNull() & listed & fine, got)


def literal(value) -> list[float]:
    """A query vector from a list, a JSON list or a comma list."""
    if isinstance(value, str):
        body = value.strip()
        try:
            value = json.loads(body) if body.startswith("[") else [float(x) for x in body.strip("()").split(",")]
        except ValueError as e:
            raise EngineError(f"not a vector: {body[:60]}") from e
    try:
        out = [float(x) for x in value]
    except (TypeError, ValueError) as e:
        raise EngineError("a vector needs numbers") from e
    if not out or not all(map(math.isfinite, out)):
        raise EngineError("a vector needs finite numbers")
    return out


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; within -1 to 1."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def raw(metric: str, a: Column, b: Column) -> Column:
    return {"euclidean": euclidean, "cosine": cosine, "dot": dot}[metric_name(metric)](a, b)


def score(metric: str, value: Column) -> Column:
    """Higher is better: 1/(1+d), the cosine, or the product."""
    return 1 / (1 + value) if metric_name(metric) == "euclidean" else value


def cost(metric: str, value: Column) -> Column:
    """Lower is better: d, 1 - cosine, or minus the product."""
    return {"euclidean": value, "cosine": 1 - value, "dot": -value}[metric_name(metric)]
