"""Recommendation sources, score fusion, and learning of fusion weights."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import geo
from tessera.operators import text as text_ops
from tessera.operators import vector as vector_ops

#: Buyers of the product that are looked at, in order of their id.
BUYERS = 300


def copurchase(purchases: DataFrame, product: int, user: str = "usuario_id", item: str = "producto_id", buyers: int | None = BUYERS, exclude_user: int | None = None) -> DataFrame:
    """(item, score, evidence): share of the product's buyers who bought each other item; best first.

    ``exclude_user`` takes out the items that this user owns. The set of buyers is the sorted first
    ``buyers`` (None: all) and joins on the user, so nothing is listed in the plan.
    """
    pairs = purchases.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct()
    base = pairs.filter(F.col("i") == product).select("u")
    if buyers is not None:
        base = base.orderBy("u").limit(buyers)
    n = base.agg(F.count(F.lit(1)).alias("buyers_used"))
    found = pairs.filter(F.col("i") != product).join(base, "u").groupBy("i").agg(F.count(F.lit(1)).alias("evidence"))
    if exclude_user is not None:
        found = found.join(pairs.filter(F.col("u") == exclude_user).select("i"), "i", "left_anti")
    used = n.first()["buyers_used"]
    return found.select(F.col("i").alias(item), (F.col("evidence") / F.lit(max(used, 1))).alias("score"), "evidence").orderBy(F.col("score").desc(), F.col(item))


def metadata(products: DataFrame, product: int, key: str = "id", category: str = "categoria", price: str = "precio") -> DataFrame:
    """Products of the same category by nearness of price."""
    own = products.filter(F.col(key) == product).select(category, price).first()
    if own is None:
        raise EngineError(f"unknown product: {product}")
    gap = F.abs(F.col(price) - F.lit(own[price])) / max(abs(own[price]), 1.0)
    return (
        products.filter((F.col(category) == own[category]) & (F.col(key) != product))
        .select(key, (1 / (1 + gap)).alias("score"))
        .orderBy(F.col("score").desc(), F.col(key))
    )


def visual(products: DataFrame, product: int | None = None, k: int = 10, key: str = "id", column: str = "embedding", metric: str = "cosine", query: list[float] | None = None) -> DataFrame:
    """Neighbours of a product's vector (itself left out), or of a given vector; cosines as (1 + cos) / 2."""
    if query is None:
        row = products.filter(F.col(key) == product).select(column).first()
        if row is None or row[0] is None:
            raise EngineError(f"no vector for product {product}")
        query = list(row[0])
    rows = products if product is None else products.filter(F.col(key) != product)
    found = vector_ops.top_k(rows, column, query, k, key, metric)
    s = (F.col("_score") + 1) / 2 if vector_ops.V.metric_name(metric) == "cosine" else F.col("_score")
    return found.select(key, s.alias("score"))


def similar_text(products: DataFrame, product: int, k: int = 10, key: str = "id", column: str = "descripcion") -> DataFrame:
    """BM25 of the product's own text against all, the product left out; equal texts tie and go by key."""
    row = products.filter(F.col(key) == product).select(column).first()
    if row is None:
        raise EngineError(f"unknown product: {product}")
    # a whole description has many terms: they are joined, not listed in the plan
    query = products.sparkSession.createDataFrame([(0, row[0] or "")], "q int, words string")
    found = text_ops.batch_bm25(products, key, column, query, "q", "words", reproducible=True)
    best = found.orderBy(F.col("score").desc(), F.col("key")).limit(k + 1)
    return best.filter(F.col("key") != product).select(F.col("key").alias(key), "score").orderBy(F.col("score").desc(), F.col(key)).limit(k)


def stores_with_stock(stores: DataFrame, stock: DataFrame, product: int, point: tuple[float, float], radius_m: float, limit: int | None = None, store: str = "tienda_id", item: str = "producto_id", amount: str = "cantidad") -> DataFrame:
    """Stores in the circle that have the product, nearest first."""
    d = geo.distance(F.col("lat"), F.col("lon"), point)
    near = stores.filter(geo.within(F.col("lat"), F.col("lon"), point, radius_m)).withColumn("distance_m", d)
    have = stock.filter((F.col(item) == product) & (F.col(amount) > 0)).groupBy(F.col(store).alias("id")).agg(F.sum(amount).alias("amount"))
    out = near.join(have, "id").orderBy("distance_m", "id")
    return out if limit is None else out.limit(limit)


def availability(stores: DataFrame) -> float:
    """1 / (1 + km to the nearest of them); 0 without any."""
    d = stores.agg(F.min("distance_m")).first()[0]
    return 0.0 if d is None else 1 / (1 + d / 1000)


def normalised(scores: DataFrame, by: tuple[str, ...] = ("source",), key: str = "id") -> DataFrame:
    """Best finite score of a key in each source, stretched to 0..1; a source of one value gives 1."""
    s = F.col("score")
    best = scores.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).groupBy(*by, key).agg(F.max("score").alias("score"))
    # one row per source and window key: extremes are aggregated first, so no source is sorted in one place
    ends = best.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    out = best.join(ends, list(by)).withColumn("score", F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0))
    return out.drop("_lo", "_hi")


def fuse(scores: DataFrame, weights: dict[str, float] | None = None, product: int | None = None, k: int | None = 10, key: str = "id") -> DataFrame:
    """Weighted sum of normalised sources with each one's part; best first, then by number of sources, then by key.

    Weights default to 1 and are divided by the sum over sources that are there; a weight of 0 or less turns a source off.
    """
    weights = weights or {}
    if product is not None:
        scores = scores.filter(F.col(key) != product)
    active = normalised(scores, key=key)
    table = F.create_map(*[x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w)))]) if weights else None
    weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(1.0)) if table is not None else F.lit(1.0)
    active = active.withColumn("_w", weight).filter("_w > 0")
    total = active.select("source", "_w").distinct().agg(F.sum("_w").alias("_total"))
    part = F.col("_w") / F.col("_total") * F.col("score")
    out = (
        active.join(F.broadcast(total))  # one row
        .groupBy(key)
        .agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_sources"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", part)))).alias("parts"))
        .orderBy(F.round("score", 12).desc(), F.col("n_sources").desc(), F.col(key))
    )
    return out if k is None else out.limit(k)


def gather(sources: dict[str, Callable[[], DataFrame]], key: str = "id") -> tuple[DataFrame | None, dict[str, str]]:
    """(source, key, score) of all sources, and the errors of those that failed; the others go on."""
    out, errors = None, {}
    for name, make in sources.items():
        try:
            df = make().select(F.lit(name).alias("source"), F.col(key), F.col("score").cast("double").alias("score"))
            df.limit(1).count()
        except Exception as e:  # noqa: BLE001  isolation is the point
            errors[name] = str(e).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df)
    return out, errors


def baskets(purchases: DataFrame, user: str, day: str, item: str) -> DataFrame:
    """(user, day, anchor, relevant): each product of a basket of two or more, with the others."""
    made = purchases.groupBy(user, day).agg(F.sort_array(F.collect_set(item)).alias("items")).filter(F.size("items") > 1)
    return made.withColumn("anchor", F.explode("items")).select(user, day, "anchor", F.filter("items", lambda x: x != F.col("anchor")).alias("relevant"))


def user_folds(users: DataFrame, user: str, k: int, seed: int = 42) -> DataFrame:
    """(user, fold): users in seeded random order, dealt by a hash of their id, so folds are of nearly equal size."""
    if k < 2:
        raise EngineError("two folds or more")
    return users.select(user).distinct().withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(user)), F.lit(k)).cast("int"))


def weight_grid(sources: list[str], steps: tuple[float, ...] = (0, 0.5, 1, 1.5, 2, 2.5, 3)) -> list[dict[str, float]]:
    """All weight vectors that differ in proportion, equal weights first among ties."""
    seen: dict[tuple, tuple] = {}
    for w in itertools.product(steps, repeat=len(sources)):
        total = sum(w)
        if total:
            seen.setdefault(tuple(round(x / total, 9) for x in w), w)
    even = 1 / len(sources)
    order = sorted(seen, key=lambda p: (round(sum((x - even) ** 2 for x in p), 12), p))
    return [dict(zip(sources, p)) for p in order]


def learn_weights(cases: DataFrame, grid: list[dict[str, float]], k: int = 10, case: str = "case_id", key: str = "id") -> tuple[dict[str, float], float]:
    """The grid's best weights by mean precision at k over cases.

    ``cases``: (case, source, key, score, relevant) with normalised scores. The grid (a stated, small table)
    meets the rows, and only sums per grid point come back.
    """
    spark = cases.sparkSession
    rows = [(g, s, float(w)) for g, ws in enumerate(grid) for s, w in ws.items() if w > 0]
    table = F.broadcast(spark.createDataFrame(rows, "g int, source string, w double"))
    fused = cases.join(table, "source").groupBy("g", case, key).agg(F.sum(F.col("w") * F.col("score")).alias("s"), F.count(F.lit(1)).alias("n"), F.max(F.col("relevant").cast("int")).alias("rel"))
    w = Window.partitionBy("g", case).orderBy(F.round("s", 12).desc(), F.col("n").desc(), F.col(key))
    hits = fused.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("g", case).agg((F.sum("rel") / k).alias("p"))
    n_cases = cases.select(case).distinct().count()
    means = {r["g"]: r["p"] / max(n_cases, 1) for r in hits.groupBy("g").agg(F.sum("p").alias("p")).collect()}
    best = min(range(len(grid)), key=lambda g: (-round(means.get(g, 0.0), 12), g))  # the grid runs from the most even weights on
    return grid[best], means.get(best, 0.0)


def cross_validate(cases: DataFrame, grid: list[dict[str, float]], k: int = 10, case: str = "case_id", key: str = "id", fold: str = "fold") -> list[dict]:
    """Weights learned on the other folds and scored on each one."""
    out = []
    for r in cases.select(fold).distinct().orderBy(fold).collect():
        weights, train = learn_weights(cases.filter(F.col(fold) != r[fold]), grid, k, case, key)
        _, test = learn_weights(cases.filter(F.col(fold) == r[fold]), [weights], k, case, key)
        out.append({"fold": r[fold], "weights": weights, "train": train, "test": test})
    return out


def nested_presets(cases: DataFrame, presets: list[dict[str, float]], k: int = 10, inner: int = 3, case: str = "case_id", key: str = "id", fold: str = "fold") -> list[dict]:
    """Outer folds test the preset that inner folds of the other users choose."""
    out = []
    for r in cases.select(fold).distinct().orderBy(fold).collect():
        train = cases.filter(F.col(fold) != r[fold]).withColumn("_inner", F.pmod(F.xxhash64(F.lit(9), F.col(case)), F.lit(inner)))
        mean = [sum(learn_weights(train.filter(F.col("_inner") == i), [p], k, case, key)[1] for i in range(inner)) / inner for p in presets]
        best = max(range(len(presets)), key=lambda i: (mean[i], -i))
        out.append({"fold": r[fold], "preset": best, "score": learn_weights(cases.filter(F.col(fold) == r[fold]), [presets[best]], k, case, key)[1]})
    return out


def leave_last(purchases: DataFrame, user: str, item: str, order: list[Column]) -> DataFrame:
    """(user, anchor, held): the last purchase of each user and the one before it."""
    w = Window.partitionBy(user).orderBy(*order)
    ranked = purchases.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return ranked.groupBy(user).agg(F.max(F.when(F.col("_r") == 1, F.col(item))).alias("held"), F.max(F.when(F.col("_r") == 2, F.col(item))).alias("anchor")).filter("anchor is not null")


