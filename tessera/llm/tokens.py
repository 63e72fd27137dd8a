"""Token-id output: texts to ids to range-coded blocks in files, and back.

Rows are dealt to contiguous ranges of their key and sorted there; each task tokenises its
rows and writes blocks of about a million ids (whole documents, so a document longer than
that makes a longer block). Spark's Parquet writer is only the container: it commits tasks
atomically on any shared store, so a lost executor's half-written file is never read. A
row of a file is one block: part and block number, ids before it in the part, ids and
documents in it, and its bytes.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import rangecoder
from tessera.workspace import process_cache, release_memory, ship

ship()

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Distinct parts of words whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 1 << 19
#: Characters of text that are cut into pieces in one step.
STEP = 1 << 22
#: Rows that Spark hands to a worker at once; its buffers double as they grow, so many long texts at once take much memory beside the heap.
ROWS = 512
AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A blank between two characters outside this class always starts a token: white space by any version of Unicode.
WHITE = " \t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff"
#: Put between the parts of a piece; a text that has it is not cut this way.
MARK = "\x01"
ASCII_OTHERS = "\x00\x02-\x40\x5b-\x60\x7b-\x7f"
#: Characters that are letters in every version of Unicode; where one comes before an ASCII character that is none, a token ends.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u0513\u05d0-\u05ea\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
BLOCKS = "part int, block int, before bigint, n_tokens bigint, n_docs int, payload binary"


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts, equal to what the tokenizers library gives for a byte-level BPE file.

    The byte-level pattern starts a token at a single blank between two characters that are not white space, so texts are
    cut there and each distinct piece of a step is encoded once; pieces are cut again where letters end. A text in which a special token of the file is spelled out goes to the library whole.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blank = regex.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
        self.edge = regex.compile(f"[{WHITE}].*|.*[{WHITE}]|", regex.DOTALL)
        self.ends = regex.compile(f"(?<=[{LETTER}])(?=[^{LETTER}\\u0080-\\U0010ffff])")
        self.word = regex.compile(f"[{LETTER}]+")
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        """By the library: little-endian 32-bit ids."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if (ids := self.older.get(part)) is None:
            word = part[1:] if part[0] == " " else part
            if (word.isascii() and word.isalpha()) or self.word.fullmatch(word):  # one token of the pattern, so only the merges are left to do
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.merge(self.letters[32] + word if part[0] == " " else word)]).tobytes()
            else:
                ids = self.whole(part)
        if len(self.known) >= REMEMBERED // 2:  # parts met since the last change of generations stay
            self.older, self.known = self.known, {}
        self.known[part] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a piece that white space neither precedes nor ends, but for one blank at its start."""
        parts = self.ends.split(piece)
        return b"".join(self.known.get(p) or self._part(p) for p in parts if p)

    def ids(self, text: str) -> bytes:
        """Ids of one text, by pieces."""
        if any(t in text for t in self.special):
            return self.whole(text)
        first, *rest = self.blank.split(text)
        head = self.whole(first) if self.edge.fullmatch(first) else self.piece(first)
        return head + b"".join(self.whole(" " + p) if self.edge.fullmatch(p) else self.piece(" " + p) for p in rest)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        codes, at, table = _split(texts, " ")
        odd = pc.match_substring_regex(table, f"^[{WHITE}]|[{WHITE}]$|^$|{MARK}").to_numpy(zero_copy_only=False)
        slow = np.add.reduceat(odd[codes], at[:-1]) > 0
        for t in self.special:
            slow |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        blank = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), table, pa.scalar(" ", pa.large_string()))
        inner, begin, parts = _split(pc.replace_substring_regex(blank, f"([{LETTER}])([{ASCII_OTHERS}])", f"\\1{MARK}\\2"), MARK)
        names = parts.to_numpy(zero_copy_only=False).tolist()
        entries = [e or self._part(p) for p, e in zip(names, list(map(self.known.get, names)))]
        # the first piece of a text has no blank before it; a slow text is one entry
        firsts = table.take(pa.array(codes[at[:-1]])).to_pylist()
        entries += [self.ids(texts[k].as_py()) if s else self.piece(firsts[k]) for k, s in enumerate(slow.tolist())]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        # what a piece stands for: a stretch of ``inner``; behind that, one entry for the start of each text
        inner = np.r_[inner, len(parts) + np.arange(n)]
        begin, width = np.r_[begin[:-1], begin[-1] + np.arange(n)], np.r_[np.diff(begin), np.ones(n, np.int64)]
        width_of = width[codes]
        width_of[np.repeat(slow, np.diff(at))] = 0
        codes[at[:-1]], width_of[at[:-1]] = len(table) + np.arange(n), 1
        flat = inner[_spans(begin[codes], width_of)]
        each = size[flat]
        pool = np.frombuffer(b"".join(entries), "<u4")
        out = pool[_spans((np.cumsum(size) - size)[flat], each)]
        ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(width_of)][at]]
        return out, np.diff(ends)


def _split(texts: pa.Array, by: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the pieces of all texts, where each text's begin (one more than texts), and the distinct pieces."""
    pieces = pc.split_pattern(texts, by)
    at = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), at - at[0], coded.dictionary


def _spans(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all spans, one after another."""
    ends = np.cumsum(width)
    return np.repeat(start - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def steps(texts: pa.Array, step: int = STEP) -> Iterator[pa.Array]:
    """Slices of about ``step`` characters, one text at least."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // step
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(a, b - a)


def encoder(file: str) -> Encoder:
    """One encoder per process and file."""
    store = process_cache()
    if ("encoder", file) not in store:
        store["encoder", file] = Encoder(file)
    return store["encoder", file]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, where: str, file: str | None = None, key: str = "doc_id", text: str = "text", end: int = END, block: int = rangecoder.BLOCK, step: int = STEP) -> None:
    """Write all texts (null: empty), each followed by ``end``, in ascending order of key (null first) and then text.

    ``step``: characters that a worker cuts into pieces at once; what is written does not depend on it, only memory (about 25 bytes each) and time do.

    Repeated rows are written each. A text of any length is written whole, in one block. An empty table makes files without blocks;
    other columns are not looked at.
    """
    file = file or tokenizer_path()
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # a reused worker may hold what another operator has freed
        tool = encoder(file)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        counts: list[int] = []
        data: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal number, before
            ids = np.concatenate(data)
            payload = rangecoder.pack(keys, counts, ids, max(tool.vocabulary, end + 1))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([payload], pa.binary())],
                names=["part", "block", "before", "n_tokens", "n_docs", "payload"],
            )
            number, before = number + 1, before + len(ids)
            keys.clear(), counts.clear(), data.clear()
            return row

        size = 0
        for b in gathered(batches, 4 * step):
            row = 0
            for some in steps(b.column(1), step):
                ids, n = tool.batch(some)
                ids = np.insert(ids, np.cumsum(n), end)
                n += 1
                ends = np.cumsum(n)
                done = 0
                while done < len(n):  # documents up to the one that fills a block
                    take = min(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block - size)) + 1, len(n))
                    lo, hi = int(ends[done - 1]) if done else 0, int(ends[take - 1])
                    keys += b.column(0).slice(row + done, take - done).to_pylist()
                    counts += n[done:take].tolist()
                    data.append(ids[lo:hi])
                    size += hi - lo
                    done = take
                    if size >= block:
                        yield closed()
                        size = 0
                row += len(n)
        if keys:
            yield closed()
        release_memory()

    rows_at_once = spark.conf.get(AT_ONCE)
    spark.conf.set(AT_ONCE, ROWS)
    try:
        ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(where)
    finally:
        spark.conf.set(AT_ONCE, rows_at_once)


def _starts(spark: SparkSession, where: str) -> dict[int, int]:
    """Ids before each part: one total per part goes to the driver."""
    totals = spark.read.schema(BLOCKS).parquet(where).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    out, at = {}, 0
    for t in totals:
        out[t["part"]] = at
        at += t["n"]
    return out


def read_tokens(spark: SparkSession, where: str, digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, and ``ids`` or, with ``digest``, ``ids_crc32``.

    Blocks are decoded independently of each other; each is checked against its checksum.
    """
    starts = _starts(spark, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, before, payload = (b.column(i)[row].as_py() for i in range(3))
                keys, counts, ids = rangecoder.unpack(payload)
                ends = np.cumsum(counts)
                begin = ends - counts
                ids = ids.astype("<u4")
                if digest:
                    view = memoryview(ids).cast("B")
                    last = pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(begin.tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts[part] + before + begin), pa.array(counts), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )
        release_memory()

    found = spark.read.schema(BLOCKS).parquet(where).select("part", "before", "payload")
    return found.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))
