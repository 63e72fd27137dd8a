"""Song recognition: one fingerprint a second, candidates, and alignment in time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import vectors as V
from tessera.operators import media, vector
from tessera.sources.media import read_wav
from tessera.workspace import ship

ship()

RATE = 16_000
SILENCE_DB, BELOW_PEAK_DB = -48.0, 32.0
SIMILAR, MATCHED, CANDIDATES = 0.60, 2, 25
CLIP_SECONDS, SCAN_SECONDS, CLIP_DB, CLIP_ACTIVE = 20, 90, -55.0, 3


def rms_db(x: np.ndarray) -> float:
    return 20 * math.log10(max(float(np.sqrt(np.mean(np.square(x)))), 1e-12)) if len(x) else -240.0


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(x):
        return x
    return np.interp(np.arange(int(len(x) * to / rate)) * rate / to, np.arange(len(x)), x)


def fingerprint(samples: np.ndarray) -> list[tuple[int, float, bool, list[float]]]:
    """(second, dB, active, mean and deviation of the MFCCs) of each full second at 16 kHz."""
    n = len(samples) // RATE
    if not n:
        raise EngineError("less than a second of sound")
    x = np.asarray(samples[: n * RATE], np.float64)
    db = [rms_db(x[i * RATE : (i + 1) * RATE]) for i in range(n)]
    loud = max(SILENCE_DB, max(db) - BELOW_PEAK_DB)
    frames = media.mfcc(x, RATE, most=None)
    second = np.arange(len(frames)) // 100  # a frame every 10 ms
    out = []
    for i in range(n):
        f = frames[second == i]
        out.append((i, db[i], db[i] >= loud, np.r_[f.mean(0), f.std(0)].tolist()))
    return out


def best_clip(samples: np.ndarray, seconds: int = CLIP_SECONDS, scan: int = SCAN_SECONDS) -> tuple[np.ndarray, int]:
    """The loudest stretch of the first ``scan`` seconds, and where it starts."""
    x = np.asarray(samples, np.float64)[: scan * RATE]
    n = len(x) // RATE
    if n < seconds:
        raise EngineError("the track is too short")
    energy = np.square(x[: n * RATE]).reshape(n, RATE).mean(1)
    at = int(np.convolve(energy, np.ones(seconds), "valid").argmax())
    clip = x[at * RATE : (at + seconds) * RATE]
    if rms_db(clip) < CLIP_DB:
        raise EngineError("the track is silent")
    return clip, at


def corpus(files: DataFrame) -> DataFrame:
    """(path, start, second, db, active, raw, error) of each file's best clip; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    clip, at = best_clip(resample(*read_wav(bytes(content))))
                    rows = [(path, at, s, db, a, raw, None) for s, db, a, raw in fingerprint(clip)]
                    if sum(r[4] for r in rows) < CLIP_ACTIVE:
                        raise EngineError("too few active seconds")
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "start", "second", "db", "active", "raw", "error"]).astype({"start": "Int64", "second": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, start long, second long, db double, active boolean, raw array<double>, error string")


def scale_of(segments: DataFrame, column: str = "raw") -> tuple[list[float], list[float]]:
    """Mean and deviation of each dimension over active seconds."""
    rows = segments.filter("active").select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return [r["m"] for r in rows], [r["s"] for r in rows]


def normalised(segments: DataFrame, mean: list[float], std: list[float], column: str = "raw", to: str = "v") -> DataFrame:
    """z-scores (deviation 1e-4 at least), then unit length, rounded to 6 decimals."""
    z = F.zip_with(F.zip_with(F.col(column), V.constant(mean), lambda a, b: a - b), V.constant([max(s, 1e-4) for s in std]), lambda a, b: a / b)
    out = segments.withColumn("_z", z)
    size = V.norm(F.col("_z"))
    return out.withColumn(to, F.transform("_z", lambda x: F.when(size > 1e-12, F.round(x / size, 6)).otherwise(0.0))).drop("_z")


def candidates(segments: DataFrame, query: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(q_second, track, second, score): the k most similar seconds of the corpus for each second of the query."""
    packed = segments.select((F.col("track").cast("bigint") * 1_000_000 + F.col("second")).alias("id"), "v")
    found = vector.batch_top_k(packed, "v", "id", query, "q_second", "v", k, "cosine")
    return found.select(F.col("query").cast("int").alias("q_second"), F.floor(F.col("key") / 1_000_000).cast("int").alias("track"), (F.col("key") % 1_000_000).cast("int").alias("second"), "score")


def align(found: DataFrame, active: int, min_similarity: float = SIMILAR, min_matched: int = MATCHED, top: int | None = 10) -> DataFrame:
    """Tracks by agreement in time: for each offset the seconds that match it, each once at its best; the best offset of a track counts."""
    s = F.col("score")
    good = found.filter((s >= min_similarity) & ~F.isnan(s)).withColumn("offset_seconds", F.col("second") - F.col("q_second"))
    seconds = good.groupBy("track", "offset_seconds", "q_second").agg(F.max("score").alias("s"))
    offsets = seconds.groupBy("track", "offset_seconds").agg(F.count(F.lit(1)).alias("matched_seconds"), F.avg("s").alias("mean_similarity")).filter(F.col("matched_seconds") >= min_matched)
    share = F.col("matched_seconds") / F.lit(float(max(active, 1)))
    w = Window.partitionBy("track").orderBy(F.round("score", 12).desc(), "offset_seconds")
    out = offsets.withColumns({"coverage": share, "score": share * F.col("mean_similarity")}).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    out = out.withColumns({"reference_start": F.greatest(F.lit(0), "offset_seconds"), "query_start": F.greatest(F.lit(0), -F.col("offset_seconds"))})
    out = out.orderBy(F.round("score", 6).desc(), "track")
    return out if top is None else out.limit(top)


def recognise(samples: np.ndarray, mean: list[float], std: list[float], provider: Callable[[DataFrame], DataFrame], spark, top: int = 10, min_similarity: float = SIMILAR) -> dict:
    """Status, seconds and matches of a recording; ``provider`` maps (q_second, v) to candidates."""
    seconds = fingerprint(samples)
    active = [x for x in seconds if x[2]]
    out = {"status": "ok", "total_seconds": len(seconds), "active_seconds": len(active), "silent_seconds": len(seconds) - len(active), "seconds": [{"second": s, "active": a, "rms_db": round(db, 2)} for s, db, a, _ in seconds], "matches": []}
    if len(active) < MATCHED:
        return out | {"status": "silent_or_too_short"}
    query = spark.createDataFrame([(s, raw) for s, _, _, raw in active], "q_second int, raw array<double>")
    found = align(provider(normalised(query, mean, std).select("q_second", "v")), len(active), min_similarity, top=top)
    return out | {"matches": [r.asDict() for r in found.collect()]}
