"""SimHash near-duplicates by anchor points.

Fingerprints of 64 bits link at four or fewer differing bits. The bits fall into three
parts with allowances 1, 1 and 0: four differences cannot exceed all three, so two linked
fingerprints agree to within the allowance on some part. Each part has a covering code whose
words are the anchors: every value is within the code's radius R of an anchor, its home. A
fingerprint is sent to all anchors within R + allowance, so whoever links to it in that part
meets it at its home. Parts of 23 bits use the Hamming code of 15 bits beside 8 free bits
(R = 1, 2^19 anchors, 16 or 37 copies); the part of 18 bits takes every value as an anchor (R = 0).

Only distinct fingerprints travel, so groups of exact copies cost one row. What meets at an
anchor is compared whole; links of one anchor leave as stars (as many rows as
members), never as all pairs. An anchor with more than CROWD members is dealt out again in
pairs of chunks, so no task holds more than two chunks of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.workspace import discard, release_memory, release_shuffles, settle, ship

ship()

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Members of an anchor that are compared in one piece.
CROWD = 1 << 14
#: Pairs that are compared in one vectorised step.
STEP = 1 << 21
#: (first bit, bits, allowance) of each part.
PARTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
CODE_BITS = 15


def fingerprint(data: bytes) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words at ASCII white space, 4-word shingles with repeats."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    a, b = starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    for i in range(0, len(a), 1 << 16):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[i : i + (1 << 16)], b[i : i + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])
    release_memory()


def _patterns(bits: int, radius: int) -> list[np.ndarray]:
    """By syndrome of the low 15 bits: the flips of up to ``radius`` bits that lead to a code word."""
    flips = [0]
    for weight in range(1, radius + 1):
        flips += [sum(1 << i for i in c) for c in _choices(bits, weight)]
    by: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for f in flips:
        by[int(_syndrome(np.array([f], np.uint64))[0])].append(f)
    return [np.array(x, np.uint64) for x in by]


def _choices(n: int, k: int, first: int = 0) -> Iterator[tuple[int, ...]]:
    if not k:
        yield ()
        return
    for i in range(first, n):
        for rest in _choices(n, k - 1, i + 1):
            yield (i, *rest)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the (one-based) places of the set bits among the low 15: zero for code words."""
    out = np.zeros(len(x), np.uint64)
    for i in range(CODE_BITS):
        out ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, home) of every copy that fingerprints send out."""
    out_anchor, out_row, out_home = [], [], []
    for k, (first, bits, allowance) in enumerate(PARTS):
        value = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        tag = np.uint64(k << 32)
        if not allowance:
            out_anchor.append(value | tag)
            out_row.append(np.arange(len(fp)))
            out_home.append(np.ones(len(fp), bool))
            continue
        syndrome = _syndrome(value)
        home = value ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
        for s, flips in enumerate(_patterns(bits, 1 + allowance)):
            rows = np.flatnonzero(syndrome == s)
            if len(rows):
                at = value[rows][:, None] ^ flips[None, :]
                out_anchor.append((at | tag).ravel())
                out_row.append(np.repeat(rows, len(flips)))
                out_home.append((at == home[rows][:, None]).ravel())
    return np.concatenate(out_anchor), np.concatenate(out_row), np.concatenate(out_home)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        anchor, row, home = anchors(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components as (node, smallest node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= DISTANCE


def _crowd(fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one large group: every home against all members, joined as they are found."""
    label = np.arange(len(fp))
    for i in np.flatnonzero(home):
        found = np.unique(label[_close(fp, fp[i])])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    keep = label != np.arange(len(fp))
    return fp[keep], fp[label[keep]]


def _meet(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars of all groups in rows sorted by anchor."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    out = []
    big = homes * size > STEP
    for g in np.flatnonzero(big):
        out.append(_crowd(fp[first[g] : first[g] + size[g]], home[first[g] : first[g] + size[g]]))
    small = (~big) & (homes > 0) & (size > 1)
    group = np.repeat(np.arange(len(first)), size)
    mine = np.flatnonzero(home & small[group])  # each home, against its whole group
    width = size[group[mine]]
    cut = np.searchsorted(np.cumsum(width), np.arange(0, width.sum() + STEP, STEP)) if len(mine) else []
    for lo, hi in zip(cut[:-1], cut[1:]):
        m, w = mine[lo:hi], width[lo:hi]
        if not len(m):
            continue
        left = np.repeat(m, w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[group[m]], w)
        near = _close(fp[left], fp[right]) & (fp[left] != fp[right])
        if near.any():
            out.append(_stars(fp[left[near]], fp[right[near]]))
    return out


_LINKS = "a bigint, b bigint, anchor bigint, chunk int, home boolean"


def _link_rows(stars: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    stars = [s for s in stars if len(s[0])]
    if stars:
        a, b = _stars(np.concatenate([s[0] for s in stars]), np.concatenate([s[1] for s in stars]))
        n = len(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())],
            names=["a", "b", "anchor", "chunk", "home"],
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to links; members of a crowded anchor leave again with a chunk number."""
    held: list[np.ndarray] = []  # the group that may go on in the next batch
    sent = 0  # members of that group which have left
    last = None

    def over(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        nonlocal sent
        n = len(fp)
        chunk = (sent + np.arange(n)) // CROWD
        sent += n
        return pa.RecordBatch.from_arrays(
            [pa.array(fp.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(anchor), pa.array(chunk.astype(np.int32)), pa.array(home)],
            names=["a", "b", "anchor", "chunk", "home"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
        if held:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        anchor, fp, home = now
        if sent:  # the first group goes on being sent out
            n = int(np.searchsorted(anchor != anchor[0], True)) if (anchor != anchor[0]).any() else len(anchor)
            if anchor[0] == last:
                yield over(anchor[:n], fp[:n], home[:n])
                anchor, fp, home = anchor[n:], fp[n:], home[n:]
                if not len(anchor):
                    held = []
                    continue
            sent = 0
        tail = int(np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])[-1])
        if tail:
            yield from _link_rows(_meet(anchor[:tail], fp[:tail], home[:tail]))
        if len(anchor) - tail > CROWD:
            last = anchor[-1]
            yield over(anchor[tail:], fp[tail:], home[tail:])
            held = []
        else:
            held = [anchor[tail:], fp[tail:], home[tail:]]
    if held and len(held[0]):
        yield from _link_rows(_meet(*held))


def _compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like ``_compare`` for pairs of chunks, which are never crowded: key, fp, home."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
        if held:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        tail = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
        if tail:
            yield from _link_rows(_meet(*[x[:tail] for x in now]))
        held = [x[tail:] for x in now]
    if held and len(held[0]):
        yield from _link_rows(_meet(*held))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), as stars with the same components as all links; ``_reads`` is the table behind them."""
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = distinct.select("fp").mapInArrow(_send, "anchor bigint, fp bigint, home boolean")
    met = settle(sent.repartition(n, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare, _LINKS), "links")
    found = met.filter("b is not null").select("a", "b")
    crowd = met.filter("b is null")
    found._reads = met
    if crowd.isEmpty():
        return found
    chunks = crowd.groupBy("anchor").agg((F.max("chunk") + 1).alias("chunks"))
    dealt = crowd.join(chunks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64("anchor", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("pair"), F.col("a").alias("fp"), "home")
    more = dealt.repartition(n, "pair").sortWithinPartitions("pair", "fp").mapInArrow(_compare_pairs, _LINKS)
    found = found.unionByName(more.select("a", "b"))
    found._reads = met
    return found


def _named(rows: DataFrame) -> DataFrame:
    """(fp, least): the smallest key reachable from each fingerprint of ``rows`` (key, fp); ``_reads`` are the tables behind them."""
    distinct = settle(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    found = links(distinct)
    edges = components(found)
    discard(found._reads)
    member = edges.withColumnRenamed("node", "fp")
    linked = distinct.join(member, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    renamed = member.join(least, "root").select("fp", "least")
    out = distinct.join(renamed, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    out._reads = (distinct, edges._reads)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest key reachable over links. Null and empty texts and texts of white space
    have fingerprint zero; null keys take part but are no component's name unless all are null. Repeated rows are each
    returned; texts of any length are read whole; an empty table gives no rows; other columns are not looked at.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    rows = settle(source.mapInArrow(_fingerprints, f"key {docs.schema[key].dataType.simpleString()}, fp bigint"), "fingerprints")
    return rows.join(_named(rows), "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key, then the smallest hash of its text.

    Rows are told apart by key and text, so rows that share a key but not a group all stay; rows equal in both count once. Rows without
    a key come last. Null and empty texts form one group. All columns stay, whatever their names; an empty table stays empty.
    """
    columns, row = docs.columns, "_row"
    while row in columns:
        row += "_"
    at = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = "struct<none:boolean,key:bigint,text:bigint>"
    source = docs.select(at.cast(kind).alias("key"), F.col(text).cast("binary").alias("text"))
    rows = settle(source.mapInArrow(_fingerprints, f"key {kind}, fp bigint"), "fingerprints")
    named = _named(rows)
    kept = rows.join(named, "fp").filter("key = least").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias(row), "n")
    kept = settle(kept, "kept")
    discard(rows, *named._reads)
    release_shuffles(docs.sparkSession)
    found = docs.withColumn(row, at.cast(kind)).select(F.col(row), F.struct(*[F.col(c) for c in columns]).alias("all")).join(kept, row)
    once = found.filter("n = 1").select("all.*")
    again = found.filter("n > 1").groupBy(row).agg(F.min("all").alias("all")).select("all.*")
    return once.unionByName(again)
