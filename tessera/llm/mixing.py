"""Mixing sources to target weights by Pareto order sampling.

A document of a source is worth ``rate * min(words, FULL) / FULL`` copies, ``cap`` at most: short ones less. The rate of a source makes
the words of all copies add up to its target. The whole part of a document's copies is certain and given outright; the rest is its
inclusion probability p. Documents are ranked by ``(U / (1 - U)) / (p / (1 - p))`` with U a hash of the row, and the smallest
ranks of each source are taken until their words fill what is left of its target: a sample of fixed size with unequal probabilities.

The cut is found without sorting a source in one place: ranks fall into BINS bins and these into BINS each, words are summed per source
and bin (partial sums before the shuffle), and only the bin in which the target falls is ordered. It holds about 1 / BINS^2 of a source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import discard, settle

BINS = 1 << 8
#: Words from which on a document counts in full.
FULL = 100
#: Sources, whose sizes go to the driver and whose targets are broadcast; more are an error.
SOURCES = 100_000
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and the controls 09 to 0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("bigint")


def targets(sizes: Iterable[tuple[str | None, int]], share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words wanted of each source: by weight, none above ``cap`` times what it has."""
    known = dict(sizes)
    order = sorted((s for s in known if s is not None)) + [None] * (None in known)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(known.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > cap * known[s]]
        if not above:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            out[s] = cap * known[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _rates(rows: DataFrame, goals: DataFrame, cap: float, full: int) -> DataFrame:
    """(_s, _rate): the copies of a document in full, so that all copies of a source's documents add up to its target.

    Documents of one level, min(words, full), get the same number of copies. From the highest level down, levels reach the
    cap; the first level that stays under it with the rate that the rest would need settles the rate.
    """
    level = F.least("_size", F.lit(full))
    words = rows.filter("_size > 0").groupBy("_source", level.alias("_level")).agg(F.sum("_size").alias("_n"))
    words = words.join(F.broadcast(goals), F.col("_source").eqNullSafe(F.col("_s")))
    by = Window.partitionBy("_s").orderBy(F.desc("_level"))
    above = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("_n") * F.col("_level") / full).over(by.rowsBetween(0, Window.unboundedFollowing))
    words = words.withColumn("_rate", (F.col("target") - cap * above) / below)
    fits = words.filter(F.col("_rate") * F.col("_level") / full <= cap * (1 + 1e-9))
    return fits.groupBy("_s").agg(F.max_by("_rate", "_level").alias("_rate"))


def _cut(rows: DataFrame, bin_: Column, room: str) -> DataFrame:
    """(_s, _bin, _before): each source's bin in which its sum of words passes ``room``, and the words before it."""
    before = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("_s", bin_.alias("_bin")).agg(F.sum("_size").alias("_n"), F.first(room).alias("_room"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return bins.filter((F.col("_before") < F.col("_room")) & (F.col("_before") + F.col("_n") >= F.col("_room"))).select("_s", "_bin", "_before")


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 7, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, full: int = FULL, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, copies, taken, and ``carry`` as one struct of these columns.

    Null sources form one source of their own, last in order; null and empty texts have no words and are not taken; a null key is
    a key like others. Rows equal in key, text and source share a hash and stand side by side; which of them is cut does not show in the result.
    An empty table gives no rows. Sources number SOURCES at most: their sizes, one row each, go to the driver. Columns of ``docs``
    of any names are carried unharmed.
    """
    spark = docs.sparkSession
    noise = F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(source))
    kept = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("_size"), ((F.shiftrightunsigned(noise, 11) + 0.5) / float(1 << 53)).alias("_u"), *kept)
    rows = settle(rows, "mix-sizes")
    sums = [(r["_source"], r["n"]) for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).limit(SOURCES + 1).collect()]
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goal = targets(sums, share, cap, weights)
    goals = spark.createDataFrame([(s, n, float(goal[s])) for s, n in sums], "_s string, source_size bigint, target double")
    rates = _rates(rows, goals, cap, full).withColumnRenamed("_s", "_r")
    goals = goals.join(rates, F.col("_s").eqNullSafe(F.col("_r")), "left").drop("_r")
    copies = F.least(F.lit(float(cap)), F.coalesce("_rate", F.lit(0.0)) * F.least("_size", F.lit(full)) / full)
    ranked = rows.join(F.broadcast(goals), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_copies", copies)
    ranked = ranked.withColumn("_whole", F.floor(F.col("_copies") + 1e-9)).withColumn("_p", F.greatest(F.col("_copies") - F.col("_whole"), F.lit(0.0)))
    odds = (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_p")) / F.col("_p"))
    # odds mapped to (0, 1); no rank where there is nothing left to draw
    ranked = settle(ranked.withColumn("_rank", F.when((F.col("_p") > 1e-9) & (F.col("_size") > 0), odds / (1 + odds))).drop("_u", "_p", "_copies", "_rate", "_source"), "mix-ranks")
    discard(rows)

    same = lambda name: F.col("_s").eqNullSafe(F.col(name))
    small = lambda df, name: F.broadcast(df.withColumnRenamed("_s", name))  # noqa: E731  (a row per source)
    rest = ranked.groupBy("_s").agg((F.first("target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_rest"))
    open_ = ranked.filter("_rank is not null").join(small(rest, "_rs"), same("_rs")).drop("_rs")
    bin_ = lambda n: F.least(F.floor(F.col("_rank") * n), F.lit(n - 1))
    coarse = _cut(open_, bin_(BINS), "_rest").select(F.col("_s").alias("_cs"), F.col("_bin").alias("_coarse"), F.col("_before").alias("_from"))
    inner = open_.join(F.broadcast(coarse), same("_cs") & (bin_(BINS) == F.col("_coarse"))).withColumn("_left", F.col("_rest") - F.col("_from"))
    fine = _cut(inner, bin_(BINS * BINS), "_left").select("_s", F.col("_bin").alias("_cut"), F.col("_before").alias("_inside"))
    fine = coarse.join(fine, F.col("_cs").eqNullSafe(F.col("_s"))).select("_cs", "_cut", (F.col("_from") + F.col("_inside")).alias("_before"))
    cuts = settle(rest.withColumnRenamed("_s", "_rs").join(fine, F.col("_rs").eqNullSafe(F.col("_cs")), "left").drop("_cs"), "mix-cuts")
    placed = ranked.join(F.broadcast(cuts), same("_rs"))
    at_cut = F.col("_rank").isNotNull() & (bin_(BINS * BINS) == F.col("_cut"))
    order = Window.partitionBy("_s").orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    # the last one is taken if that ends nearer to the target
    edge = placed.filter(at_cut).withColumn("_extra", (sofar + F.col("_size") / 2 <= F.col("_rest")).cast("int"))
    # a source whose ranks all fit has no cut
    all_fit = F.col("_cut").isNull() & (F.col("_rest") > 0)
    others = placed.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("_extra", F.coalesce((F.col("_rank").isNotNull() & ((bin_(BINS * BINS) < F.col("_cut")) | all_fit)).cast("int"), F.lit(0)))
    copies = F.col("_whole") + F.col("_extra")
    return edge.unionByName(others).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("_size")).cast("bigint").alias("taken"), *(["carried"] if carry else [])
    )


def mixed(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The documents of the mix with all their columns, of whatever names, repeated as often as they are taken."""
    chosen = mix(docs, size, carry=tuple(docs.columns), **options)
    return chosen.filter("copies > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("carried.*")
