"""Vector search: exact top-k, batches, inverted file, recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import vectors as V
from tessera.workspace import ship

ship()

#: Numbers in the query matrix of one batch call; it travels to every task.
BATCH_NUMBERS = 50_000_000
VECTOR_NAMES = ("embedding", "vector", "vectors", "features", "descriptor", "histogram")


def scored(df: DataFrame, column: str, query: list[float], metric: str = "euclidean") -> DataFrame:
    """Adds ``_score``, ``_raw_metric``, ``_metric``; rows without a vector go, other dimensions are an error."""
    name = V.metric_name(metric)
    v = F.col(column)
    wrong = F.raise_error(F.lit("vectors of different dimensions"))
    value = F.when(F.size(v) == len(query), V.raw(name, v, V.constant(query))).otherwise(wrong.cast("double"))
    rows = df.filter(v.isNotNull() & (F.size(v) > 0)).withColumn("_raw_metric", value)
    return rows.withColumns({"_score": V.score(name, F.col("_raw_metric")), "_metric": F.lit(name)})


def top_k(df: DataFrame, column: str, query: list[float], k: int, key: str, metric: str = "euclidean", where: Column | None = None) -> DataFrame:
    """The k best rows after the filter, best first, ties by key: a heap per partition, then one merge."""
    if k < 1:
        raise EngineError("k must be 1 or more")
    rows = df if where is None else df.filter(where)
    return scored(rows, column, query, metric).orderBy(F.col("_score").desc(), F.col(key).asc()).limit(k)


def vector_column(df: DataFrame, name: str | None = None) -> str:
    """The named column, else a usual name, else the only column of vectors."""
    if name:
        if name not in df.columns:
            raise EngineError(f"unknown column: {name}")
        return name
    for n in VECTOR_NAMES:
        if n in df.columns:
            return n
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("array<double>", "array<float>")]
    if len(arrays) != 1:
        raise EngineError("name the vector column")
    return arrays[0]


def batch_top_k(df: DataFrame, column: str, key: str, queries: DataFrame, query_key: str, query_column: str, k: int, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """(query, key, score, rank) of the k best rows for each query.

    Queries become matrices of at most BATCH_NUMBERS numbers, one pass over the rows each; every task multiplies its batches by
    it and keeps k per query, so what is shuffled is tasks x queries x k rows. Vectors of other dimensions or with numbers
    that are not finite are an error; rows without a vector go.
    """
    name = V.metric_name(metric)
    found = queries.select(F.col(query_key).cast("bigint").alias("q"), F.col(query_column).alias("v")).collect()
    found = [r for r in found if r["v"]]
    if len({len(r["v"]) for r in found}) > 1:
        raise EngineError("vectors of different dimensions")
    at_once = max(1, BATCH_NUMBERS // max(1, len(found[0]["v"]) if found else 1))
    parts = [_one_batch(df, column, key, found[i : i + at_once], k, name, skip_self) for i in range(0, max(1, len(found)), at_once)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_batch(df: DataFrame, column: str, key: str, found: list, k: int, name: str, skip_self: bool) -> DataFrame:
    ids = np.array([r["q"] for r in found], np.int64)
    matrix = np.array([r["v"] for r in found], np.float64)
    if not np.isfinite(matrix).all():
        raise EngineError("a vector holds a number that is not finite")
    size = np.linalg.norm(matrix, axis=1) if len(matrix) else np.zeros(0)
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, q_size = shared.value
        best_s, best_k = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if (np.diff(b.column(1).offsets.to_numpy()) != q.shape[1]).any():
                raise EngineError("vectors of different dimensions")
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            if not np.isfinite(x).all():
                raise EngineError("a vector holds a number that is not finite")
            dots = q @ x.T if name != "euclidean" else None
            if name == "dot":
                s = dots
            elif name == "cosine":
                n = q_size[:, None] * np.linalg.norm(x, axis=1)[None, :]
                s = np.clip(np.divide(dots, n, out=np.zeros_like(dots), where=n > 0), -1, 1)
            else:
                s = np.stack([1 / (1 + np.sqrt(((x - y) ** 2).sum(axis=1))) for y in q])
            kk = np.broadcast_to(keys, s.shape)
            if skip_self:
                s = np.where(kk == ids[:, None], -np.inf, s)
            s, kk = np.concatenate([best_s, s], 1), np.concatenate([best_k, kk], 1)
            order = np.lexsort((kk, -np.round(s, 12)), axis=1)[:, :k]
            best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(kk, order, 1)
        w = best_s.shape[1]
        keep = np.isfinite(best_s.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, w)[keep]), pa.array(best_k.ravel()[keep]), pa.array(best_s.ravel()[keep])], names=["query", "key", "score"]
        )

    rows = df.filter(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("v"))
    w = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), F.col("key").asc())
    return rows.mapInArrow(run, "query bigint, key bigint, score double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lists_for(n: int) -> int:
    return max(1, math.isqrt(n))


#: Recall at NEIGHBOURS that the number of probed lists is chosen for, and the vectors it is measured with.
RECALL, NEIGHBOURS, MEASURED = 0.95, 10, 64


class InvertedFile:
    """Vectors in lists by nearest centroid. Centroids come from a bounded sample; every row is assigned.

    The number of lists to probe is measured at the build: over a bounded sample of vectors, the fewest that reach RECALL of
    their exact neighbours (``recall`` holds what was reached). Search goes on to further lists until it has k candidates;
    ``probes`` of all lists is the exact way.
    """

    def __init__(self, df: DataFrame, column: str, key: str, centroids: np.ndarray, metric: str, probes: int | None = None, recall: float | None = None):
        self.df, self.column, self.key, self.centroids, self.metric = df, column, key, centroids, metric
        self.probes, self.recall, self._sizes = probes or len(centroids), recall, None

    @classmethod
    def build(cls, df: DataFrame, column: str, key: str, metric: str = "euclidean", lists: int | None = None, seed: int = 42, sample_per_list: int = 256) -> InvertedFile:
        name = V.metric_name(metric)
        usable = df.filter(F.col(column).isNotNull())
        n = usable.count()
        lists = max(1, min(lists or lists_for(n), max(n, 1)))
        v = F.col(column).cast("array<double>")
        unit = F.when(V.norm(v) > 0, F.transform(v, lambda x: x / V.norm(v))).otherwise(v) if name == "cosine" else v
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
        share = lambda wanted: usable if n <= wanted else usable.filter(draw < int(wanted / n * (1 << 40)))
        model = KMeans(k=lists, seed=seed, maxIter=25, initMode="k-means||").fit(share(sample_per_list * lists).select(array_to_vector(unit).alias("features")))
        centroids = np.array(model.clusterCenters())
        index = cls(cls._assigned(usable, column, centroids, name), column, key, centroids, name)
        index._measure(usable.orderBy(draw, key).limit(MEASURED))
        return index

    def _measure(self, queries: DataFrame) -> None:
        exact = batch_top_k(self.df, self.column, self.key, queries, self.key, self.column, NEIGHBOURS, self.metric, skip_self=True)
        near = exact.join(self.df.select(F.col(self.key).cast("bigint").alias("key"), "list_id"), "key").join(queries.select(F.col(self.key).cast("bigint").alias("query"), F.col(self.column).alias("v")), "query")
        place = np.sort([self.order([float(x) for x in r["v"]]).index(r["list_id"]) for r in near.select("v", "list_id").collect()])
        if len(place):
            self.probes = int(place[min(len(place) - 1, math.ceil(RECALL * len(place)) - 1)]) + 1
            self.recall = float((place < self.probes).mean())

    @staticmethod
    def _assigned(df: DataFrame, column: str, centroids: np.ndarray, metric: str) -> DataFrame:
        @F.pandas_udf("int")
        def nearest(v):
            x = np.array(v.tolist(), np.float64)
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cost = -(x @ centroids.T) if metric in ("dot", "cosine") else (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T
            import pandas as pd

            return pd.Series(cost.argmin(axis=1).astype(np.int32))

        return df.withColumn("list_id", nearest(F.col(column).cast("array<double>")))

    def save(self, folder: str) -> InvertedFile:
        """Write the lists as partitions, so a probe reads only its own files."""
        spark = self.df.sparkSession
        self.df.write.mode("overwrite").partitionBy("list_id").parquet(folder)
        return InvertedFile(spark.read.parquet(folder), self.column, self.key, self.centroids, self.metric, self.probes, self.recall)

    def order(self, query: list[float]) -> list[int]:
        q = np.array(query, float)
        if self.metric == "cosine":
            q = q / max(float(np.linalg.norm(q)), 1e-12)
        cost = -(self.centroids @ q) if self.metric in ("dot", "cosine") else ((self.centroids - q) ** 2).sum(1)
        return np.argsort(cost, kind="stable").tolist()

    def top_k(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        rows = self.df if where is None else self.df.filter(where)
        order, take = self.order(query), probes or self.probes
        if where is None:
            self._sizes = self._sizes or self._counted(rows)
        sizes = self._sizes if where is None else self._counted(rows)
        while take < len(order) and sum(sizes.get(i, 0) for i in order[:take]) < k:
            take += 1
        return top_k(rows.filter(F.col("list_id").isin(*order[:take])), self.column, query, k, self.key, self.metric).drop("list_id")

    @staticmethod
    def _counted(rows: DataFrame) -> dict[int, int]:
        return {r["list_id"]: r["count"] for r in rows.groupBy("list_id").count().collect()}  # one row per list

    def batch_top_k(self, queries: DataFrame, query_key: str, query_column: str, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, score, rank): every query joins the rows of its nearest lists, all in one plan."""
        take, centroids, metric = min(probes or self.probes, len(self.centroids)), self.centroids, self.metric

        @F.pandas_udf("array<int>")
        def nearest(v):
            import pandas as pd

            x = np.array(v.tolist(), np.float64)
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cost = -(x @ centroids.T) if metric in ("dot", "cosine") else (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T
            return pd.Series(list(cost.argsort(axis=1, kind="stable")[:, :take].astype(np.int32)))

        v = F.col(query_column).cast("array<double>")
        asked = queries.filter(v.isNotNull()).select(F.col(query_key).cast("bigint").alias("query"), v.alias("_q"), F.explode(nearest(v)).alias("list_id"))
        rows = self.df.select("list_id", F.col(self.key).cast("bigint").alias("key"), F.col(self.column).cast("array<double>").alias("_v"))
        scores = rows.join(asked, "list_id").select("query", "key", V.score(metric, V.raw(metric, F.col("_v"), F.col("_q"))).alias("score"))
        w = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), F.col("key").asc())
        return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, by: str = "query", key: str = "key") -> DataFrame:
    """(query, recall): share of the exact neighbours that were found."""
    hits = exact.join(found.select(by, key).withColumn("_hit", F.lit(1)), [by, key], "left")
    return hits.groupBy(by).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
