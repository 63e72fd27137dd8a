"""Block codec for token ids: a context-mixing range coder that runs many lanes at once.

A block holds its own model, which starts empty, so blocks are decoded in any order. Its ids are
cut into equal lanes; each step codes the next id of every lane from the model of the
steps before and then learns from all of them. Three predictions are mixed:

* order 0: adaptive counts of all ids;
* order 1 and order 2: the id that last followed the previous one or two ids, with a confidence.

Weights are learned for each pair of confidences from how often each order was right. The mix
gives P(id) = W2 [id = p2] + W1 [id = p1] + W0 P0(id), whose cumulative sums need no table beyond
order 0's, so one arithmetic coding step codes an id. The coder is carry-free with 64-bit
state and 16-bit output; all operations are on integers, so decoding repeats encoding exactly.

Layout of a block, little-endian: header (``HEAD``), zstandard-compressed table of documents
(ids, presence, token counts), 32-bit words per lane, the lanes' 16-bit words. The header holds a crc32 of all that follows it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"TCM2"
#: magic, vocabulary, ids, documents, lanes, bytes of the document table, crc32 of the rest
HEAD = "<4sIQIIII"
HEAD_SIZE = struct.calcsize(HEAD)
#: Ids after which a block is closed, and lanes at most; a lane has LANE ids or more.
BLOCK = 1 << 21
LANES = 4096
LANE = 128
_U = np.uint64
_SHIFT = 28
_TOTAL = 1 << _SHIFT
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)
_ROOM = 1 << 24  # of _TOTAL that order 0 always keeps; its scaled counts sum to as much
_SCALE = 24
_MOST = (1 << 23) - (1 << 18)  # counts are halved beyond
_FIND = 8  # order 0 is searched from a table of every 2^_FIND-th point on, _NEAR places at most by steps
_NEAR = 2
_INC = 8
_CONF = 8
_STEP = np.array([-(n - (n >> 1)) for n in range(_CONF)] + [int(n < _CONF - 1) for n in range(_CONF)], np.int64)  # of a confidence after a miss and after a hit
_HASH = 18
_OFTEN, _EVERY = 16, 32  # steps after each of which counts and weights are brought up to date; later every so many


class _Model:
    """The state that encoder and decoder share; ``update`` is the only thing that changes it.

    Predictions are kept as ``id * _CONF + confidence``.
    """

    def __init__(self, vocabulary: int):
        self.counts = np.ones(vocabulary, np.int64)
        self.first = np.zeros(vocabulary, np.int64)
        self.second = np.zeros(1 << _HASH, np.int64)
        self.seen = np.tile(np.array([4, 1, 1], np.int64), (2 * _CONF * _CONF, 1))
        self.steps, self.kinds, self.ids = 0, [], []
        self._refresh()

    def _refresh(self) -> None:
        """Bring the weights and order 0 up to date."""
        if self.ids:
            self.seen += np.bincount(np.concatenate(self.kinds), minlength=self.seen.size).reshape(self.seen.shape) * 4
            self.counts += np.bincount(np.concatenate(self.ids), minlength=len(self.counts)) * _INC
            self.kinds.clear(), self.ids.clear()
        if self.seen.max() > _TOTAL >> 2:
            self.seen = (self.seen + 1) >> 1
        all_ = self.seen.sum(axis=1)
        self.w1 = self.seen[:, 1] * (_TOTAL - _ROOM) // all_
        self.w2 = self.seen[:, 2] * (_TOTAL - _ROOM) // all_
        self.w0 = _TOTAL - self.w1 - self.w2
        sums = np.cumsum(self.counts)
        if sums[-1] > _MOST:
            self.counts = (self.counts + 1) >> 1
            sums = np.cumsum(self.counts)
        # scaled to 2^24: no id has less than 1, as the counts sum to less than half of it
        self.cum = np.zeros(len(sums) + 1, np.int64)
        self.cum[1:] = (sums << _SCALE) // int(sums[-1])
        self.upto = self.cum[1:]
        self.table = None

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the points."""
        if self.table is None:
            begun = np.bincount((self.upto[:-1] + (1 << _FIND) - 1) >> _FIND, minlength=1 << (_SCALE - _FIND))
            self.table = np.cumsum(begun[: 1 << (_SCALE - _FIND)])
        got = self.table.take(points >> _FIND)
        late = np.flatnonzero(self.upto.take(got) <= points)
        for _ in range(_NEAR):
            got[late] += 1
            late = late[self.upto[got[late]] <= points[late]]
        got[late] = np.searchsorted(self.upto, points[late], side="right")
        return got

    def look(self, prev: np.ndarray, prev2: np.ndarray) -> None:
        """Predictions of the next ids after the contexts."""
        self.prev = prev
        self.slot = ((prev * 0x9E3779B1 + prev2 * 0x85EBCA6B) >> 7) & ((1 << _HASH) - 1)
        self.sa, self.sb = self.first.take(prev), self.second.take(self.slot)
        self.na, self.nb = self.sa & (_CONF - 1), self.sb & (_CONF - 1)
        self.a, self.b = self.sa >> 3, self.sb >> 3
        self.ctx = (self.na * _CONF + self.nb) * 2 + (self.a == self.b)
        self.wa, self.wb, self.wz = self.w1.take(self.ctx), self.w2.take(self.ctx), self.w0.take(self.ctx)

    def interval(self, ids: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids' intervals in the mix, for the lanes ``at``."""
        a, b, wa, wb, wz = self.a[at], self.b[at], self.wa[at], self.wb[at], self.wz[at]
        low = self.cum.take(ids) * wz >> _SCALE
        high = self.upto.take(ids) * wz >> _SCALE
        return low + wb * (b < ids) + wa * (a < ids), high - low + wb * (b == ids) + wa * (a == ids)

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the points, and these intervals."""
        a, b, wa, wb, wz = self.a, self.b, self.wa, self.wb, self.wz
        a0 = (self.cum.take(a) * wz >> _SCALE) + wb * (b < a)
        a1 = (self.upto.take(a) * wz >> _SCALE) + wb * (b <= a) + wa
        b0 = (self.cum.take(b) * wz >> _SCALE) + wa * (a < b)
        b1 = (self.upto.take(b) * wz >> _SCALE) + wa * (a <= b) + wb
        in_b = (at >= b0) & (at < b1)
        ids, start, end = np.where(in_b, b, a), np.where(in_b, b0, a0), np.where(in_b, b1, a1)
        rest = np.flatnonzero((at < start) | (at >= end))
        if len(rest):
            x = at[rest]
            x = x - wb[rest] * (x >= b1[rest]) - wa[rest] * (x >= a1[rest])
            got = self.symbols((((x + 1) << _SCALE) - 1) // wz[rest])
            ids[rest] = got
            start[rest], width = self.interval(got, rest)
            end[rest] = start[rest] + width
        return ids, start, end - start

    def update(self, ids: np.ndarray) -> None:
        hit_a, hit_b = ids == self.a, ids == self.b
        self.kinds.append(self.ctx * 3 + np.where(hit_b, 2, hit_a))
        self.ids.append(ids)
        new = (ids << 3) | 1
        for table, at, state, n, hit in ((self.first, self.prev, self.sa, self.na, hit_a), (self.second, self.slot, self.sb, self.nb, hit_b)):
            # a hit adds to the confidence; a miss halves it, and replaces what had none left; among lanes in one context the last counts
            table[at] = np.where(hit | (n > 1), state + _STEP.take(hit * _CONF + n), new)
        self.steps += 1
        if self.steps <= _OFTEN or self.steps % _EVERY == 0:
            self._refresh()


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block, and ids in each but the last."""
    if not n:
        return 0, 0
    each = max(-(-n // LANES), min(n, LANE))
    return -(-n // each), each


def _shifts(low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shift lanes by 16 bits until all are wide enough, in place; gives each round's lanes and what they were."""
    who = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
    while len(who):
        lo, wi = low[who], width[who]
        yield who, lo
        # where the top bits differ still, the interval is cut at the next multiple of 2^32
        wi = np.where((lo ^ (lo + wi)) < _TOP, wi, (_U(0) - lo) & _U((1 << 32) - 1))
        lo, wi = lo << _U(16), wi << _U(16)
        low[who], width[who] = lo, wi
        who = who[((lo ^ (lo + wi)) < _TOP) | (wi < _BOTTOM)]


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, list[bytes]]:
    """Words of each lane, and their bytes."""
    n = len(ids)
    lanes, each = _lanes(n)
    if not n:
        return np.zeros(0, np.uint32), []
    steps = np.zeros(lanes * each, np.int64)
    steps[:n] = ids
    steps = np.ascontiguousarray(steps.reshape(lanes, each).T)
    full = n - (lanes - 1) * each  # steps in which the last lane takes part
    model = _Model(vocabulary)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out, at = np.zeros((lanes, 3 * each + 8), np.uint16), np.zeros(lanes, np.int64)
    prev = prev2 = np.zeros(lanes, np.int64)
    for t in range(each):
        k = lanes if t < full else lanes - 1
        if k < len(prev):
            prev, prev2 = prev[:k], prev2[:k]
        if not k:
            break
        x = steps[t, :k]
        model.look(prev, prev2)
        start, freq = model.interval(x)
        r = width[:k] >> _U(_SHIFT)
        low[:k] += r * start.astype(_U)
        width[:k] = r * freq.astype(_U)
        for who, lo in _shifts(low[:k], width[:k]):
            out[who, at[who]] = lo >> _U(48)
            at[who] += 1
        model.update(x)
        prev2, prev = prev, x
    for i in range(4):
        out[np.arange(lanes), at] = (low >> _U(48)).astype(np.uint16)
        at += 1
        low <<= _U(16)
    return at.astype(np.uint32), [out[i, : at[i]].tobytes() for i in range(lanes)]


def decode_ids(n: int, lengths: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    lanes, each = _lanes(n)
    if not n:
        return np.zeros(0, np.int64)
    full = n - (lanes - 1) * each
    model = _Model(vocabulary)
    low, width, code = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    at = np.cumsum(lengths.astype(np.int64)) - lengths
    words = np.r_[words, np.zeros(4, np.uint16)].astype(_U)
    for _ in range(4):
        code = (code << _U(16)) | words[at]
        at += 1
    steps = np.zeros((each, lanes), np.int64)
    prev = prev2 = np.zeros(lanes, np.int64)
    for t in range(each):
        k = lanes if t < full else lanes - 1
        if k < len(prev):
            prev, prev2 = prev[:k], prev2[:k]
        if not k:
            break
        model.look(prev, prev2)
        r = width[:k] >> _U(_SHIFT)
        x, start, freq = model.find(np.minimum((code[:k] - low[:k]) // r, _U(_TOTAL - 1)).astype(np.int64))
        low[:k] += r * start.astype(_U)
        width[:k] = r * freq.astype(_U)
        for who, _ in _shifts(low[:k], width[:k]):
            code[who] = (code[who] << _U(16)) | words[at[who]]
            at[who] += 1
        model.update(x)
        steps[t, :k] = x
        prev2, prev = prev, x
    return np.ascontiguousarray(steps.T).ravel()[:n]


def pack(keys: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of whole documents."""
    lengths, lanes = encode_ids(ids, vocabulary)
    present = np.array([k is not None for k in keys], np.uint8)
    table = zstandard.compress(np.array([k or 0 for k in keys], "<i8").tobytes() + present.tobytes() + np.array(counts, "<u8").tobytes(), 3)
    rest = table + lengths.astype("<u4").tobytes() + b"".join(lanes)
    return struct.pack(HEAD, MAGIC, vocabulary, len(ids), len(keys), len(lanes), len(table), zlib.crc32(rest)) + rest


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, token counts and ids of a block; a block that does not match its checksum is an error."""
    magic, vocabulary, n, docs, lanes, size, crc = struct.unpack_from(HEAD, block)
    rest = memoryview(block)[HEAD_SIZE:]
    if magic != MAGIC or zlib.crc32(rest) != crc:
        raise ValueError("damaged block of token ids")
    table = zstandard.decompress(rest[:size])
    keys = np.frombuffer(table, "<i8", docs)
    present = np.frombuffer(table, np.uint8, docs, 8 * docs)
    counts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
    lengths = np.frombuffer(rest, "<u4", lanes, size)
    words = np.frombuffer(rest, "<u2", offset=size + 4 * lanes)
    return [int(k) if p else None for k, p in zip(keys, present)], counts, decode_ids(n, lengths, words, vocabulary)
