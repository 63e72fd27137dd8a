"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of PASSAGE words, overlapping by half. Passages and benchmark items are
TF-IDF vectors over the benchmark's vocabulary: no other word can add to a product
with an item. A randomised SVD of the passages of all documents, stacked on the items (which weigh as
much), gives the latent space: one pass over the corpus sums A'(A W) for a random W, partition by
partition, and a Nystrom step on the driver turns the sums into singular vectors. Sizes there
depend on the benchmark alone.

Passages whose cosine with an item reaches COSINE are candidates. A candidate stands if the longest
common subsequence of words covers NEAR of the item, or PARAPHRASE of it with the item's answer
(the rare words of its last part) present. Before that, words that are in neither decide what cannot reach these shares.
Items of fewer than LEAST words are too short for shares and are found where their words follow each other in a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import release_memory, settle, ship

ship()

HOP = 16
PASSAGE = 2 * HOP
#: Longer items are matched in parts of this many words.
ITEM = 64
#: Items of fewer words must be in a text word by word.
LEAST = 5
RANK, EXTRA = 160, 32
COSINE = 0.4
NEAR = 0.8
PARAPHRASE = 0.55
ANSWER = 0.8
SEED = 11
#: Words of documents that are laid side by side in one step of the fit and of the search, and cells of their table of words.
FIT_STEP, STEP, CELLS = 1 << 11, 1 << 14, 1 << 22
#: ASCII characters other than letters and digits become spaces.
_SPACES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACES).split()


@dataclass
class Benchmark:
    """Items as ids of their own vocabulary (0: any other word)."""

    vocabulary: dict[bytes, int]
    parts: list[tuple[int, np.ndarray]]  # (item_id, ids)
    short: list[tuple[int, np.ndarray]]  # items of fewer than LEAST words


def load_benchmark(items: DataFrame, key: str = "item_id", text: str = "text") -> Benchmark:
    """All items, on the driver: a benchmark is a stated, small set. Items without words or without a key take no part."""
    vocabulary: dict[bytes, int] = {}
    parts, short = [], []
    for row in items.select(key, text).orderBy(key, text).collect():
        found = words(row[text])
        if not found or row[key] is None:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64)
        if len(ids) < LEAST:
            short.append((row[key], ids))
        else:
            parts += [(row[key], p) for p in np.array_split(ids, -(-len(ids) // ITEM))]
    return Benchmark(vocabulary, parts, short)


def encode(docs: DataFrame, bench: Benchmark, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the words of every whole text as 32-bit ids of the benchmark's vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(bench.vocabulary)
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            out = [np.fromiter(map(get, w, repeat(0)), "<u4", len(w)).tobytes() for w in (words(t.as_py()) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["key", "ids"])
        release_memory()

    return source.mapInArrow(run, "key bigint, ids binary")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray = np.zeros(1, np.int64)
    for b in batches:
        for data in b.column("ids").to_pylist():
            found = np.unique(np.frombuffer(data, "<u4"))
            if len(found) and found[-1] >= len(total):
                total = np.r_[total, np.zeros(int(found[-1]) + 1 - len(total), np.int64)]
            total[found] += 1
    at = np.flatnonzero(total)
    at = at[at > 0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def hops(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each hop of HOP words; other words have an empty row."""
    return table[ids].reshape(-1, HOP, table.shape[1]).sum(axis=1)


def laid(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents one after another, each from a new hop on and with an empty hop behind it; and where each begins (one more)."""
    begin = np.r_[0, np.cumsum([(-(-len(d) // HOP) + 1) * HOP for d in docs])].astype(np.int64)
    out = np.zeros(int(begin[-1]), np.int64)
    for at, d in zip(begin.tolist(), docs):
        out[at : at + len(d)] = d
    return out, begin


def passages(sums: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Passage k is hops k and k + 1; what starts at the empty hop behind a document is none."""
    out = sums.copy()
    out[:-1] += sums[1:]
    out[begin[1:] // HOP - 1] = 0
    return out


def chunks(docs: list[np.ndarray], cells: int, step: int = STEP) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first, documents) of about ``step`` words; at least one document, at most ``cells`` of them."""
    some: list[np.ndarray] = []
    size = 0
    for k, d in enumerate(docs):
        some.append(d)
        size += len(d)
        if size >= step or len(some) >= cells or k + 1 == len(docs):
            yield k + 1 - len(some), some
            some, size = [], 0


@dataclass
class Model:
    """What the search needs; its size depends on the benchmark alone."""

    vocabulary: dict[bytes, int]
    table: np.ndarray  # weights of words in the latent space, row 0 empty
    items: np.ndarray  # unit latent vectors of the parts
    parts: list[tuple[int, np.ndarray]]
    answers: list[np.ndarray]
    short: list[tuple[int, np.ndarray]]

    def __post_init__(self) -> None:
        # words of parts and answers, filled up with 0, which no text is said to have
        self.size = np.array([len(p) for _, p in self.parts], np.int64)
        self.rows = _filled([p for _, p in self.parts])
        self.tails = _filled(self.answers)
        self.need = ANSWER * np.array([len(a) for a in self.answers])
        # short items by length: the hash of their words, and which item
        self.runs = {}
        for n in sorted({len(p) for _, p in self.short}):
            same = [(int(_run_hash(p, n)[0]), item) for item, p in self.short if len(p) == n]
            self.runs[n] = np.array(sorted(h for h, _ in same), np.uint64), same


def _filled(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _run_hash(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n neighbours."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)].astype(np.uint64)
    return out


def fit(encoded: DataFrame, bench: Benchmark, rank: int = RANK, extra: int = EXTRA, seed: int = SEED) -> Model:
    """The latent space of all passages of ``encoded`` and the items."""
    spark = encoded.sparkSession
    size = len(bench.vocabulary) + 1
    total = encoded.count()
    df = np.zeros(size, np.int64)
    for r in encoded.mapInArrow(_document_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r["id"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 0.05
    idf[0] = 0
    width = min(rank + extra, max(1, size))
    rng = np.random.default_rng(seed)
    draw = rng.standard_normal((size, width)).astype(np.float32)
    draw[0] = 0
    weighed = spark.sparkContext.broadcast((idf[:, None] * draw).astype(np.float32))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weighed.value
        z = np.zeros(table.shape, np.float64)
        for b in batches:
            for _, some in chunks([np.frombuffer(data.as_buffer(), "<u4") for data in b.column("ids")], b.num_rows, FIT_STEP):
                ids, begin = laid(some)
                at = np.flatnonzero(ids)
                if not len(at):
                    continue
                y = passages(hops(ids, table), begin)
                both = y.copy()
                both[1:] += y[:-1]  # the passages that a hop is in
                found, word = np.unique(ids[at], return_inverse=True)
                counts = np.bincount(at // HOP * len(found) + word, minlength=len(both) * len(found)).reshape(len(both), -1)
                z[found] += counts.T.astype(np.float32) @ both
        yield from _blocks(z)
        release_memory()

    partial = encoded.mapInArrow(sketch, "block int, data binary")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = partial.repartition(shuffles, "block").mapInArrow(_add_blocks, "block int, data binary")
    z = np.zeros((size, width))
    for r in summed.collect():
        rows = np.frombuffer(r["data"], np.float32).reshape(-1, width)
        z[r["block"] * _ROWS : r["block"] * _ROWS + len(rows)] += rows
    z *= idf[:, None]
    # the items' own A'A draw and latent vectors, item by item, as a table of items by words would not be small
    own = np.zeros((size, width))
    for _, ids in bench.parts:
        np.add.at(own, ids, idf[ids][:, None] * (idf[ids] @ draw[ids]))
    norm = np.abs(own).sum()
    z = z / max(np.abs(z).sum(), 1e-12) * max(norm, 1e-12) + own  # the corpus weighs as much as the items
    basis = _nystrom(z, draw.astype(np.float64), rank)
    latent = np.zeros((len(bench.parts), basis.shape[1]))
    for k, (_, ids) in enumerate(bench.parts):
        latent[k] = idf[ids] @ basis[ids]
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
    answers = []
    for _, ids in bench.parts:
        tail = ids[-max(LEAST, len(ids) // 4) :]
        rare = sorted(set(tail.tolist()), key=lambda i: (-idf[i], i))
        answers.append(np.array(rare[: max(1, len(rare) // 2)], np.int64))
    return Model(bench.vocabulary, (idf[:, None] * basis).astype(np.float32), latent.astype(np.float32), bench.parts, answers, bench.short)


_ROWS = 256


def _blocks(z: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = -(-len(z) // _ROWS)
    for k in range(n):
        part = z[k * _ROWS : (k + 1) * _ROWS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "data"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of each block as they come, so memory is one copy of the blocks of this task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(data, np.float32).astype(np.float64)
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sorted(sums.items()):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["block", "data"])


def _nystrom(z: np.ndarray, draw: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from z = A'A draw: A'A is near z (draw'z)^-1 z'."""
    core = draw.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(z), 1))
    root = z @ (vectors[:, good] / np.sqrt(values[good]))
    # its left singular vectors, by the small Gram matrix
    square, turn = np.linalg.eigh(root.T @ root)
    keep = np.flatnonzero(square > square.max() * 1e-10)[::-1][:rank]
    return root @ (turn[:, keep] / np.sqrt(square[keep]))


def common(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    places: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in other.tolist():
        if m := places.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def matches(docs: list[np.ndarray], model: Model) -> list[dict[int, tuple[float, float, bool]]]:
    """Items found in each document: cosine, share of the item in the common subsequence, answer present."""
    out: list[dict[int, tuple[float, float, bool]]] = [{} for _ in docs]
    words_ = len(model.table)
    for before, some in chunks(docs, max(1, CELLS // words_)):
        ids, begin = laid(some)
        if not ids.any():
            continue
        for n, (hashes, items) in model.runs.items():
            at = np.flatnonzero(np.isin(_run_hash(ids, n), hashes))
            for i, h in zip(at.tolist(), _run_hash(ids, n)[at].tolist()):
                for item in (item for code, item in items if code == h):
                    out[before + int(np.searchsorted(begin, i, side="right")) - 1][item] = (1.0, 1.0, True)
        if not len(model.parts):
            continue
        v = passages(hops(ids, model.table), begin)
        near = v @ model.items.T / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
        w, k = np.nonzero(near >= COSINE)
        doc = np.searchsorted(begin, w * HOP, side="right") - 1
        # words of neither: the common subsequence is no longer than the words of the item that the document has
        has = np.zeros((len(some), words_), bool)
        has[np.searchsorted(begin, np.arange(len(ids)), side="right") - 1, ids] = True
        has[:, 0] = False
        most = has[doc[:, None], model.rows[k]].sum(axis=1)
        there = has[doc[:, None], model.tails[k]].sum(axis=1) >= model.need[k]
        good = np.flatnonzero((most >= NEAR * model.size[k]) | (there & (most >= PARAPHRASE * model.size[k])))
        w, k, doc = w[good], k[good], doc[good]
        # one passage of those that would look at nearly the same place
        place = np.stack([doc, k, (w * HOP - begin[doc]) // np.maximum(HOP, model.size[k] // 2)])
        _, one = np.unique(place, axis=1, return_index=True)
        mark = np.zeros(words_, bool)
        for x in one.tolist():
            item, part = model.parts[k[x]]
            m, at, d = len(part), int(w[x]) * HOP, int(doc[x])
            region = ids[max(int(begin[d]), at - m) : min(int(begin[d + 1]), at + PASSAGE + m)]
            mark[region] = True
            mark[0] = False
            bound, here = np.count_nonzero(mark[part]), np.count_nonzero(mark[model.answers[k[x]]]) >= model.need[k[x]]
            mark[region] = False
            if bound < (PARAPHRASE if here else NEAR) * m:
                continue
            share = common(part, region) / m
            if share >= NEAR or (share >= PARAPHRASE and here):
                found = (float(near[w[x], k[x]]), share, bool(here))
                old = out[before + d].get(item, found)
                out[before + d][item] = max(old, found, key=lambda y: (y[1], y[2], y[0]))
    return out


def _shared(spark, model: Model):
    """A broadcast of the model's plain parts: executors need not have this module."""
    return spark.sparkContext.broadcast((model.vocabulary, model.table, model.items, model.parts, model.answers, model.short))


def search(encoded: DataFrame, model: Model) -> DataFrame:
    """One row per document and item in it: key, item_id, cosine, common, answer."""
    shared = _shared(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            found = matches([np.frombuffer(data.as_buffer(), "<u4") for data in b.column("ids")], m)
            rows = [(key, item, *f) for key, items in zip(b.column("key").to_pylist(), found) for item, f in items.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))],
                names=["key", "item_id", "cosine", "common", "answer"],
            )
        release_memory()

    return encoded.select("key", "ids").mapInArrow(run, "key bigint, item_id bigint, cosine double, common double, answer boolean")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, cosine, common, answer) for each item in each row of ``docs``.

    An item of more than ITEM words is there when one of its equal parts is. Null and empty texts match nothing; repeated rows
    are each reported; a null key is reported as null; texts of any length are read whole; other columns are not looked at;
    of an item's places in a text the best one counts, ties alike; an empty benchmark matches nothing, an empty table gives no rows.
    """
    bench = load_benchmark(items)
    encoded = settle(encode(docs, bench, key, text), "benchmark-words")
    return search(encoded, fit(encoded, bench)).withColumnRenamed("key", key)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found; rows are judged where they are, with no shuffle of texts.

    All columns stay, whatever their names. Null and empty texts stay; repeated rows are judged alike; an empty benchmark removes
    nothing, an empty table stays empty.
    """
    bench = load_benchmark(items)
    encoded = settle(encode(docs.select(F.lit(None).cast("bigint").alias("key"), F.col(text).alias("text")), bench, "key", "text"), "benchmark-words")
    model = fit(encoded, bench)
    shared = _shared(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        get = m.vocabulary.get
        for b in batches:
            ids = [np.fromiter(map(get, w, repeat(0)), "<u4", len(w)) for w in (words(t.as_py()) for t in b.column(at))]
            yield b.filter(pa.array([not found for found in matches(ids, m)], pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
