"""Bags of visual or acoustic words: codebook, histograms, TF-IDF vectors, model files."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import vectors as V
from tessera.sources import files
from tessera.workspace import ship

ship()

#: Descriptors that a codebook is trained on at most.
SAMPLE = 20_000


def class_means(df: DataFrame, label: str, column: str) -> np.ndarray:
    """One word per class: the mean of its vectors, in order of the class."""
    flat = df.select(F.col(label).alias("w"), F.posexplode(column).alias("i", "x"))
    rows = flat.groupBy("w", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v")).orderBy("w").collect()
    return np.array([[x["m"] for x in r["v"]] for r in rows])


def train_codebook(descriptors: DataFrame, column: str, words: int, seed: int = 42, key: str | None = None, sample: int = SAMPLE, iterations: int = 25) -> np.ndarray:
    """k-means centres of a bounded, hash-drawn sample of the descriptors."""
    n = descriptors.count()
    if not n:
        raise EngineError("no descriptors")
    drawn = descriptors
    if n > sample:
        source = F.col(key) if key else F.to_json(column)
        drawn = descriptors.filter(F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    model = KMeans(k=min(words, n), seed=seed, maxIter=iterations).fit(drawn.select(array_to_vector(F.col(column).cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def assign(descriptors: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """Adds ``word``, the nearest centroid; the codebook travels with the function."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64)
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T))
        return pd.Series(np.round(d, 9).argmin(axis=1).astype(np.int32))

    return descriptors.withColumn("word", nearest(F.col(column).cast("array<double>")))


def histogram(descriptors: DataFrame, item: str, column: str, centroids: np.ndarray) -> DataFrame:
    """(item, word, n)."""
    return assign(descriptors.filter(F.col(column).isNotNull()), column, centroids).groupBy(item, "word").agg(F.count(F.lit(1)).alias("n"))


def word_idf(hist: DataFrame, item: str = "object") -> DataFrame:
    """(word, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    n = hist.agg(F.count_distinct(item).alias("items")).first()["items"]
    return hist.groupBy("word").agg(F.count_distinct(item).alias("df")).select("word", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(hist: DataFrame, idf: DataFrame | None = None, item: str = "object") -> DataFrame:
    """(item, word, weight): share of the item's words times idf, of unit length."""
    idf = word_idf(hist, item) if idf is None else idf
    total = hist.groupBy(item).agg(F.sum("n").alias("_total"))
    raw = hist.join(idf, "word").join(total, item).select(item, "word", (F.col("n") / F.col("_total") * F.col("idf")).alias("_w"))
    size = raw.groupBy(item).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return raw.join(size, item).select(item, "word", (F.col("_w") / F.col("_l")).alias("weight"))


def similar(weights: DataFrame, item: str = "object") -> DataFrame:
    """(query, key, score): cosine of items that share words."""
    a = weights.select(F.col(item).alias("query"), "word", F.col("weight").alias("_a"))
    b = weights.select(F.col(item).alias("key"), "word", F.col("weight").alias("_b"))
    return a.join(b, "word").filter("query <> key").groupBy("query", "key").agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))


@dataclass
class BowModel:
    """Codebook and weights of one kind of media."""

    kind: str
    centroids: np.ndarray
    idf: np.ndarray
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    backend: str = "dense"
    version: int = 1
    extra: dict = field(default_factory=dict)

    def prepare(self, d: np.ndarray) -> np.ndarray:
        d = np.asarray(d, np.float64)
        if d.size and d.shape[1] != self.centroids.shape[1]:
            raise EngineError("descriptors of another dimension than the codebook")
        if self.mean is not None and d.size:
            d = (d - self.mean) / np.where(self.std > 1e-9, self.std, 1.0)
        return d

    def histogram(self, d: np.ndarray) -> np.ndarray:
        d = self.prepare(d)
        out = np.zeros(len(self.centroids))
        for i in range(0, len(d), 4096):
            x = d[i : i + 4096]
            near = ((self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T).argmin(1)
            out += np.bincount(near, minlength=len(out))
        return out

    def encode(self, d: np.ndarray) -> list[float]:
        """Unit TF-IDF vector rounded to 6 decimals; no word at all is an error."""
        n = self.histogram(d)
        if not n.sum():
            raise EngineError("no descriptors to encode")
        w = n / n.sum() * self.idf
        return np.round(w / np.linalg.norm(w), 6).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        as_list = lambda x: None if x is None else np.asarray(x).tolist()
        files.write_text(spark, path, json.dumps({"kind": self.kind, "centroids": as_list(self.centroids), "idf": as_list(self.idf), "mean": as_list(self.mean), "std": as_list(self.std), "backend": self.backend, "version": self.version, "extra": self.extra}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, backend: str = "dense") -> BowModel:
        d = json.loads(files.read_text(spark, path))
        if d["backend"] != backend:
            raise EngineError(f"the model was made by {d['backend']}, not by {backend}")
        back = lambda x: None if x is None else np.array(x)
        return cls(d["kind"], np.array(d["centroids"]), np.array(d["idf"]), back(d["mean"]), back(d["std"]), d["backend"], d["version"], d["extra"])


def train(descriptors: DataFrame, item: str, column: str, kind: str, words: int, seed: int = 42, standardise: bool | None = None) -> BowModel:
    """Codebook, standardisation (audio by default) and idf from (item, descriptor) rows."""
    standardise = kind == "audio" if standardise is None else standardise
    mean = std = None
    if standardise:
        flat = descriptors.select(F.posexplode(F.col(column).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
        mean, std = np.array([r["m"] for r in flat]), np.array([r["s"] for r in flat])
        scale = np.where(std > 1e-9, std, 1.0)
        z = F.zip_with(F.zip_with(F.col(column).cast("array<double>"), V.constant(mean.tolist()), lambda a, b: a - b), V.constant(scale.tolist()), lambda a, b: a / b)
        descriptors = descriptors.withColumn(column, z)
    centroids = train_codebook(descriptors, column, words, seed)
    idf = np.full(len(centroids), math.nan)
    hist = histogram(descriptors, item, column, centroids)
    n = hist.select(item).distinct().count()
    for r in word_idf(hist, item).collect():
        idf[r["word"]] = r["idf"]
    idf[np.isnan(idf)] = math.log(1 + n) + 1
    return BowModel(kind, centroids, idf, mean, std)
