"""Contiguous shards of near equal bytes, cut by global prefix sums.

Rows get one order by a range shuffle of their digests (texts stay where they are read),
every partition sums its own sizes, and the running totals of the partitions, one row
each, turn local sums into global ones. Cuts lie at equal targets of bytes. Equal texts lie side by side; a cut inside such a group moves to
its nearer end if that is within SLACK of a shard's bytes, else to the nearer end of the row, so only larger groups are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import settle, ship

ship()

#: A cut moves to an end of a group of equal texts over at most this part of a shard.
SLACK = 0.03


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, for each row, bytes and rows before it, and bytes before its group."""
    part = TaskContext.get().partitionId()
    bytes_, rows, last, start = 0, 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        size, digest = b.column("size").to_numpy(), b.column("digest").to_numpy()
        before = bytes_ + np.cumsum(size) - size
        first = np.r_[last is None or digest[0] != last, digest[1:] != digest[:-1]]
        at = np.where(first, before, -1)
        at[0] = before[0] if first[0] else start
        at = np.maximum.accumulate(at)
        extra = [pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(before), pa.array(rows + np.arange(b.num_rows)), pa.array(at)]
        yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "part", "before", "row", "group_at"])
        bytes_, rows, last, start = int(bytes_ + size.sum()), rows + b.num_rows, digest[-1], int(at[-1])


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slack: float = SLACK, partitions: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and the checksum of no bytes. Null keys sort first; repeated rows
    are placed one by one; an empty table gives no rows; a text larger than a shard fills one and leaves others short or empty. ``slot`` counts
    from 0 in each shard. Other columns are not looked at.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("crc"),
        F.xxhash64(raw).alias("digest"),
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "digest", "key").sortWithinPartitions("digest", "key")
    local = ranged.mapInArrow(_running, ranged.schema.simpleString()[7:-1].replace(":", " ") + ", part bigint, before bigint, row bigint, group_at bigint")
    local = settle(local, "shard-rows")
    # one row per partition
    totals = (
        local.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("digest").alias("first"), F.max(F.struct("before", "digest", "group_at")).alias("last"))
        .orderBy("part")
        .collect()
    )
    offsets, bytes_, count, last, start = [], 0, 0, None, 0
    for t in totals:
        first_at = start if last is not None and t["first"] == last else bytes_
        offsets.append((t["part"], bytes_, count, t["first"], first_at))
        start = bytes_ + t["last"]["group_at"] if t["last"]["digest"] != t["first"] else first_at
        bytes_, count, last = bytes_ + t["bytes"], count + t["rows"], t["last"]["digest"]
    table = F.broadcast(spark.createDataFrame(offsets, "part bigint, part_bytes bigint, part_rows bigint, first bigint, first_at bigint"))
    total = max(bytes_, 1)
    at = F.col("part_bytes") + F.col("before")
    group_at = F.when(F.col("digest") == F.col("first"), F.col("first_at")).otherwise(F.col("part_bytes") + F.col("group_at"))
    spread = local.join(table, "part").select("key", "size", "crc", at.alias("at"), group_at.alias("group_at"), (F.col("part_rows") + F.col("row")).alias("global_row"))
    goals = [k * total / shards for k in range(1, shards)]
    # the rows over which a goal falls, and the ends of their groups: a row per cut
    over = F.lit(False)
    for g in goals:
        over = over | ((F.col("at") <= g) & (F.col("at") + F.col("size") > g))
    rows_at = spread.filter(over).select("at", "size", "group_at").collect()
    groups = sorted({r["group_at"] for r in rows_at})
    ends = {r["group_at"]: r["end"] for r in spread.filter(F.col("group_at").isin(groups)).groupBy("group_at").agg(F.max(F.col("at") + F.col("size")).alias("end")).collect()}
    cuts = []
    for g in goals:
        r = next((r for r in rows_at if r["at"] <= g < r["at"] + r["size"]), None)
        if r is not None:
            nearer = lambda *x: min(x, key=lambda y: abs(y - g))  # noqa: B023, E731
            whole = nearer(r["group_at"], ends[r["group_at"]])
            cuts.append(whole if abs(whole - g) <= slack * total / shards else nearer(r["at"], r["at"] + r["size"]))
    shard_of = F.lit(0)
    for c in cuts:
        shard_of = shard_of + (F.col("at") >= c).cast("int")
    placed = spread.select("key", "size", "crc", shard_of.cast("int").alias("shard"), "global_row")
    firsts = placed.groupBy("shard").agg(F.min("global_row").alias("first_row")).collect()
    bases = F.broadcast(spark.createDataFrame(firsts, "shard int, first_row bigint"))
    return placed.join(bases, "shard").select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
