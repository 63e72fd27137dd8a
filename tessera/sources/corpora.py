"""Small generated data with fixed seeds, for tests and measurements."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.audio import RATE
from tessera.operators.media import wav_bytes
from tessera.operators.spatial import clustered_points


def texts(spark: SparkSession, n: int, seed: int = 202602, topics: int = 12) -> DataFrame:
    """id, texto, topic: 45 to 75 words, half of them of the text's topic."""
    rng = random.Random(seed)
    common = [f"comun{i}" for i in range(200)]
    own = [[f"tema{t}palabra{i}" for i in range(40)] for t in range(topics)]
    rows = []
    for i in range(n):
        t = rng.randrange(topics)
        rows.append((i, " ".join(rng.choice(own[t] if rng.random() < 0.5 else common) for _ in range(rng.randint(45, 75))), t))
    return spark.createDataFrame(rows, "id int, texto string, topic int")


def clustered_vectors(spark: SparkSession, n: int, dim: int = 32, groups: int = 8, spread: float = 0.15, seed: int = 7) -> DataFrame:
    """id, embedding, label: points around unit-cube centres."""
    rng = np.random.default_rng(seed)
    centres = rng.random((groups, dim))
    label = rng.integers(0, groups, n)
    x = centres[label] + rng.normal(0, spread, (n, dim))
    return spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))], "id int, embedding array<double>, label int")


def places(spark: SparkSession, n: int, seed: int = 17, spread_km: float = 25.0) -> DataFrame:
    """id, nombre, categoria, lat, lon."""
    rng = random.Random(seed + 1)
    return spark.createDataFrame([(i, f"Tienda {i}", rng.choice("ABC"), a, o) for i, (a, o) in enumerate(clustered_points(n, seed, spread_km))], "id int, nombre string, categoria string, lat double, lon double")


def tone(hertz: float, seconds: float, rate: int = RATE, level: float = 0.5, seed: int = 0) -> bytes:
    """A WAV with a tone, its overtones and a little noise."""
    t = np.arange(int(rate * seconds)) / rate
    rng = np.random.default_rng(seed)
    x = sum(np.sin(2 * np.pi * hertz * k * t) / k for k in (1, 2, 3)) + rng.normal(0, 0.01, len(t))
    return wav_bytes(level * x / max(1e-9, np.abs(x).max()), rate)


def shape_image(shape: str, size: int = 96, seed: int = 0) -> np.ndarray:
    """A grey picture of a disc, a square, a triangle or stripes, with noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size] / size - 0.5
    inside = {"disc": x * x + y * y < 0.09, "square": (abs(x) < 0.28) & (abs(y) < 0.28), "triangle": (y > -0.3) & (y < 0.3) & (abs(x) < (y + 0.3) / 2), "stripes": (x * 10 % 1) < 0.5}[shape]
    return np.clip(0.2 + 0.6 * inside + rng.normal(0, 0.03, (size, size)), 0, 1)


def store(spark: SparkSession, products: int = 30, stores: int = 5, users: int = 40, purchases: int = 200, seed: int = 5) -> dict[str, DataFrame]:
    """productos, tiendas, stock, compras with the columns of a shop."""
    rng = random.Random(seed)
    kinds = ["Audio", "Hogar", "Libros", "Moda"]
    p = [(i, f"Producto {i}", kinds[i % 4], round(rng.uniform(5, 300), 2), f"Descripcion de {kinds[i % 4]} numero {i % 7}", f"{i}.npy", [rng.random() for _ in range(8)]) for i in range(1, products + 1)]
    t = [(i, f"Tienda {i}", a, o, f"Distrito {i % 3}") for i, (a, o) in enumerate(clustered_points(stores, seed), 1)]
    s = [(i, rng.randint(1, stores), rng.randint(1, products), rng.randint(0, 9)) for i in range(1, products * 3 + 1)]
    c = [(i, rng.randint(1, users), rng.randint(1, products), f"2026-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}", rng.randint(1, 3)) for i in range(1, purchases + 1)]
    return {
        "productos": spark.createDataFrame(p, "id int, nombre string, categoria string, precio double, descripcion string, imagen string, embedding array<double>"),
        "tiendas": spark.createDataFrame(t, "id int, nombre string, lat double, lon double, distrito string"),
        "stock": spark.createDataFrame(s, "id int, tienda_id int, producto_id int, cantidad int"),
        "compras": spark.createDataFrame(c, "id int, usuario_id int, producto_id int, fecha string, cantidad int"),
    }
