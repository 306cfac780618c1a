"""Token-id files: an adaptive context-mixing range coder over blocks of ids, written and read by Spark tasks.

A file is a Parquet table whose rows are segments; ``payload`` holds a segment: a header, the documents' ids and lengths
under a checksum, a table of blocks (ids, words, checksum of ids and words) and the blocks' code words. Every block starts from an
empty model and can be decoded alone. All blocks of a segment are coded in step, one numpy lane each, so that the work per
id is a few vector operations.

The probability of an id is a mixture of three predictions: order 2 (the id that last followed these two ids), order 1
(the id that last followed this one) and order 0 (adaptive frequencies of the id's high and low part). The mixing weights
are adaptive too: how often each of them was right so far. Frequencies and weights are renewed at fixed places of a block.
One coding step takes an id: its interval is the weight of the prediction that names it or, within the weight of order 0,
the interval of its high part and in that the interval of its low part.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medtab.llm.common import give_back, scratch_path

#: Format: magic and header (version, vocabulary size, ids a block, documents, blocks).
MAGIC, HEADER = b"MTOK", struct.Struct("<4sIIIQI")
#: Most ids in a block, ids in a segment, slots of a prediction table.
BLOCK_IDS, SEGMENT_IDS, SLOTS = 2048, 6_000_000, 512
#: Ids of a block after which frequencies and weights are renewed first, most ids between two renewals, rows coded at once.
RENEW_FIRST, RENEW_MOST, ROWS = 32, 512, 32
#: Blocks of a segment below which blocks get shorter, down to so many ids.
LANES, LEAST_BLOCK = 1000, 256
#: Bits of each of an interval's three factors (weight, high part, low part), contexts of the low part, what a seen id counts.
PART, LOW_CONTEXTS, SEEN = 10, 4, 16
#: Numbers that tables are renewed by at once, so that they stay in a core's cache.
IN_CACHE = 1 << 14
#: Pieces that a worker keeps with their ids, and bytes of text tokenized at once.
MEMO, SLICE = 400_000, 4_000_000
_ONE = 1 << PART
_ALL = 3 * PART
_TOP = np.uint64(1 << 48)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
#: A space beside other white space, or at an end of the text.
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = f"{_SPACES} | {_SPACES}|^ | $"


class Tokens:
    """A tokenizer file of the ``tokenizers`` library, applied to whole texts.

    Where the file's pre-tokenizer is the plain byte-level one, a single space between two non-spaces always starts a new
    piece, so a text's ids are those of its space-separated pieces; each distinct piece is encoded once and remembered, and
    texts are put together from pieces by array operations. Other texts, and texts with other spacing, are encoded in one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.pieces = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """Piece 0 is the empty one."""
        self.body: dict[str, int] = {}
        self.head: dict[str, int] = {"": 0}
        self.n_pieces, self.n_pool = 1, 0
        self.at, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)  # piece k: pool[at[k]:at[k + 1]]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Keep pieces whose ids stand one after the other, each up to its end; gives the first one's number."""
        first, n = self.n_pieces, len(ends)
        if first + n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), n + 1), np.int64)])
        if self.n_pool + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.n_pool : self.n_pool + len(ids)] = ids
        self.at[first + 1 : first + n + 1] = self.n_pool + ends
        self.n_pieces, self.n_pool = first + n, self.n_pool + len(ids)
        return first

    def _gather(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each ends."""
        begin = self.at[pieces]
        size = self.at[pieces + 1] - begin
        ends = np.cumsum(size)
        begin -= ends - size
        at = np.repeat(begin, size)
        at += np.arange(len(at))
        return self.pool.take(at), ends

    def _learn(self, new: list[str]) -> None:
        """Encode pieces, some in one text, each behind its space; a piece's first id is the one with the space."""
        parts = [new[k : k + 200] for k in range(0, len(new), 200)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(part):
                first = self._store(ids, np.append(at[1:], len(ids)))
                self.body.update(zip(part, range(first, first + len(part)), strict=True))
            else:
                for piece in part:
                    ids = self._ids(" " + piece)
                    self.body[piece] = self._store(ids, np.array([len(ids)]))

    def _whole(self, text: str) -> int:
        ids = self._ids(text)
        return self._store(ids, np.array([len(ids)]))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after the other, and how many each has."""
        if self.n_pieces > MEMO or self.n_pool > 8 * MEMO:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.pieces:
            odd = pc.match_substring_regex(texts, ODD)
            split = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
            flat, starts, odd = split.flatten(), split.offsets.to_numpy().astype(np.int64), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        else:
            flat, starts, odd = texts, np.arange(len(texts) + 1), np.arange(len(texts))
        starts -= starts[0]
        coded = flat.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        body = np.ones(len(code), bool)
        body[starts[:-1]] = False
        used = np.flatnonzero(np.bincount(code[body], minlength=len(words)))
        names = words.take(pa.array(used)).to_numpy(zero_copy_only=False)
        own = np.fromiter(map(self.body.get, names, repeat(-1)), np.int64, len(names))
        lacks = np.flatnonzero(own < 0)
        if len(lacks):
            self._learn(names[lacks].tolist())
            own[lacks] = np.fromiter(map(self.body.__getitem__, names[lacks]), np.int64, len(lacks))
        of = np.zeros(len(words), np.int64)
        of[used] = own
        piece = of[code]
        heads = flat.take(pa.array(starts[:-1])).to_pylist() if self.pieces else [""] * len(texts)
        for text in set(heads).difference(self.head):
            self.head[text] = self._whole(text)
        piece[starts[:-1]] = np.fromiter(map(self.head.__getitem__, heads), np.int64, len(heads))
        for k in odd.tolist():
            piece[starts[k]] = self._whole(texts[k].as_py())
        ids, ends = self._gather(piece)
        edges = np.append(0, ends)[starts]
        return ids, np.diff(edges)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, n = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(n)[:-1])


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def renewals(length: int) -> Iterator[tuple[int, int, bool]]:
    """Rows coded at once as (begin, end, renew): frequencies and weights are renewed after as many rows as all before had."""
    at, step = 0, RENEW_FIRST
    due = step
    while at < length:
        end = min(length, at + ROWS, due)
        yield at, end, end == due
        if end == due:
            step = min(RENEW_MOST, due)
            due += step
        at = end


class Model:
    """The adaptive state of all lanes: prediction tables, how often they were right, and the order-0 frequencies."""

    def __init__(self, lanes: int, vocab: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.kind = np.uint32 if vocab >= 65535 else np.uint16
        none = np.iinfo(self.kind).max
        self.one, self.two = np.full(lanes * SLOTS, none, self.kind), np.full(lanes * SLOTS, none, self.kind)
        self.slots = self.lane * SLOTS
        self.highs = (vocab - 1 >> 8) + 1
        if self.highs > _ONE // 2:
            raise ValueError(f"a vocabulary of {vocab} ids is too large for this coder")
        self.step = max(1, -(-self.highs // LOW_CONTEXTS))
        self.n_high, self.n_low = np.ones((lanes, self.highs), np.int32), np.ones((lanes * LOW_CONTEXTS, 256), np.int32)
        self.right = np.tile(np.array([[4], [2], [10]], np.int64), lanes)  # order 2, order 1 alone, neither
        self.renew()

    def renew(self) -> None:
        self.high, self.low = self._table(self.n_high), self._table(self.n_low)
        share = self.right[:2] * (_ONE - 3) // self.right.sum(axis=0) + 1  # at least 1 of _ONE for each
        self.w2 = share[0].astype(np.uint64)
        self.w12 = self.w2 + share[1].astype(np.uint64)
        self.hit2, self.hit1 = self.w2 << _TWO, self.w12 - self.w2 << _TWO

    @staticmethod
    def _table(counts: np.ndarray) -> np.ndarray:
        """Each symbol's start and size out of _ONE, at least 1, in one number (start in the upper half).

        Single precision is enough and the same on every machine: sums stay under 2**24 and only the order must hold.
        """
        rows, k = counts.shape
        out, one_each = np.empty((rows, k), np.uint32), np.arange(1, k + 1, dtype=np.uint32)
        for a in range(0, rows, IN_CACHE // k):
            part = np.s_[a : a + IN_CACHE // k]
            sums = np.cumsum(counts[part], axis=1, dtype=np.int32).astype(np.float32)
            sums *= np.float32(_ONE - k) / sums[:, -1:]
            ends = sums.astype(np.uint32)
            np.minimum(ends, np.uint32(_ONE - k), out=ends)
            ends[:, -1] = _ONE - k
            ends += one_each
            own = out[part]
            own[:, 0] = ends[:, 0]
            np.subtract(ends[:, 1:], ends[:, :-1], out=own[:, 1:])
            ends <<= np.uint32(16)
            own[:, 1:] |= ends[:, :-1]
        return out.ravel()

    @staticmethod
    def places(table: np.ndarray, symbols: int) -> np.ndarray:
        """The symbol at each of a row's _ONE places."""
        rows, step = len(table) // symbols, IN_CACHE // symbols
        names = np.tile(np.arange(symbols, dtype=np.uint8 if symbols <= 256 else np.uint16), step)
        out = np.empty(rows * _ONE, names.dtype)
        for a in range(0, rows, step):
            sizes = (table[a * symbols : (a + step) * symbols] & np.uint32(65535)).astype(np.int64)
            out[a * _ONE : (a + step) * _ONE] = np.repeat(names[: len(sizes)], sizes)
        return out

    def learn(self, hit2: np.ndarray, hit1: np.ndarray, miss: np.ndarray, lane: np.ndarray) -> None:
        """Count hits, [time, lane], and the ids that order 0 coded with their lanes."""
        two, one = hit2.sum(axis=0), hit1.sum(axis=0)
        self.right += np.array([two, one, len(hit2) - two - one])
        high = miss >> 8
        np.add.at(self.n_high.ravel(), lane * self.highs + high, np.int32(SEEN))
        np.add.at(self.n_low.ravel(), (lane * LOW_CONTEXTS + high // self.step) * 256 + (miss & 255), np.int32(SEEN))


_TWO, _LOW = np.uint64(2 * PART), np.uint64(65535)


def _stretch(m: Model, ids: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (start, size) of some rows of ids, [time, lane], which the model then counts; ``p1``, ``p2``: ids before."""
    before = np.concatenate([p2[None], p1[None], ids])
    h1 = before[1:-1] * 40503
    i2 = m.slots + (h1 + before[:-2] * 30011 >> 4 & SLOTS - 1)
    i1 = m.slots + (h1 >> 4 & SLOTS - 1)
    c1, c2 = np.empty(ids.shape, m.kind), np.empty(ids.shape, m.kind)
    named = ids.astype(m.kind)
    for t in range(len(ids)):
        a, b, now = i2[t], i1[t], named[t]
        m.two.take(a, out=c2[t], mode="clip")
        m.one.take(b, out=c1[t], mode="clip")
        m.two[a] = now
        m.one[b] = now
    hit2 = c2 == named
    hit1 = (c1 == named) & ~hit2
    start = np.where(hit2, np.uint64(0), m.hit2)
    size = np.where(hit2, m.hit2, m.hit1)
    at = np.flatnonzero(~(hit1 | hit2))
    lane, x = at % m.lanes, ids.ravel()[at]
    last, high = m.w12[lane], x >> 8
    a = m.high[lane * m.highs + high].astype(np.uint64)
    b = m.low[(lane * LOW_CONTEXTS + high // m.step) * 256 + (x & 255)].astype(np.uint64)
    rest, s = np.uint64(_ONE) - last, a & _LOW
    start.ravel()[at] = (last << _TWO) + rest * (((a >> _16) << np.uint64(PART)) + s * (b >> _16))
    size.ravel()[at] = rest * s * (b & _LOW)
    m.learn(hit2, hit1, x, lane)
    return start, size


def encode_blocks(blocks: np.ndarray, vocab: int) -> list[bytes]:
    """``blocks[t, lane]``: the lanes' ids, padded to one length; gives each lane's code words.

    Bounds of the interval are 64-bit; 16 bits leave whenever the size falls under 2**48. A carry into words that have left
    is added to the last of them and passed on at the end.
    """
    length, lanes = blocks.shape
    m = Model(lanes, vocab)
    low, size_, at = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), m.lane.copy()
    words = np.zeros((length * _ALL // 16 + 8) * lanes, np.uint32)
    p1 = p2 = np.zeros(lanes, np.int64)
    unit, more = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    for begin, end, renew in renewals(length):
        ids = blocks[begin:end].astype(np.int64)
        starts, sizes = _stretch(m, ids, p1, p2)
        p1, p2 = ids[-1], ids[-2] if len(ids) > 1 else p1
        if renew:
            m.renew()
        for start, size in zip(starts, sizes, strict=True):
            np.right_shift(size_, np.uint64(_ALL), out=unit)
            np.multiply(unit, start, out=more)
            low += more
            np.multiply(unit, size, out=size_)
            over = (low < more).nonzero()[0]
            if len(over):
                words[at[over] - lanes] += 1
            out = (size_ < _TOP).nonzero()[0]
            while len(out):
                bound, place = low[out], at[out]
                words[place] = bound >> _48
                low[out] = bound << _16
                left = size_[out] << _16
                size_[out] = left
                at[out] = place + lanes
                out = out[left < _TOP]
    for _ in range(4):
        words[at] = low >> _48
        low <<= _16
        at += lanes
    while len(over := np.flatnonzero(words > 65535)):
        words[over] &= 65535
        words[over - lanes] += 1
    ends = (at // lanes).tolist()
    by_lane = np.ascontiguousarray(words[: max(ends, default=0) * lanes].astype("<u2").reshape(-1, lanes).T)
    return [by_lane[k, :n].tobytes() for k, n in enumerate(ends)]


def decode_blocks(coded: list[bytes], length: int, vocab: int) -> np.ndarray:
    """The inverse of ``encode_blocks``."""
    lanes = len(coded)
    m = Model(lanes, vocab)
    base = np.cumsum([0, *(len(b) // 2 + 4 for b in coded[:-1])])
    words = np.frombuffer(b"".join(b + bytes(8) for b in coded) + bytes(2), "<u2")
    next2 = words[:-1].astype(np.uint32) << np.uint32(16) | words[1:]  # with the word after it
    code = next2[base].astype(np.uint64) << _32 | next2[base + 2]
    at, last_word = base + 4, len(next2) - 1
    size_ = np.full(lanes, 2**64 - 1, np.uint64)
    ids_out = np.zeros((length, lanes), np.uint32)
    before = np.zeros(lanes, np.int64)
    h2 = np.zeros(lanes, np.int64)
    full = np.uint64((1 << _ALL) - 1)
    row_high, row_low, in_high, in_low = m.lane * m.highs, m.lane * LOW_CONTEXTS, m.lane * _ONE, m.lane * LOW_CONTEXTS * _ONE
    unit, spot = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    c1, c2 = np.empty(lanes, m.kind), np.empty(lanes, m.kind)
    renew = True
    for begin, end, due in renewals(length):
        if renew:
            of_high, of_low = m.places(m.high, m.highs), m.places(m.low, 256)
        hits2, misses = np.empty((end - begin, lanes), bool), np.empty((end - begin, lanes), bool)
        for t in range(end - begin):
            h1 = before * 40503
            h2 += h1
            h2 >>= 4
            h2 &= SLOTS - 1
            h2 += m.slots
            h1 >>= 4
            h1 &= SLOTS - 1
            h1 += m.slots
            m.two.take(h2, out=c2, mode="clip")
            m.one.take(h1, out=c1, mode="clip")
            np.right_shift(size_, np.uint64(_ALL), out=unit)
            np.floor_divide(code, unit, out=spot)
            np.minimum(spot, full, out=spot)
            part = spot >> _TWO
            hit2 = np.less(part, m.w2, out=hits2[t])
            miss = np.greater_equal(part, m.w12, out=misses[t])
            ids = np.where(hit2, c2, c1)
            start, size = np.where(hit2, np.uint64(0), m.hit2), np.where(hit2, m.hit2, m.hit1)
            k = miss.nonzero()[0]
            if len(k):
                last = m.w12[k]
                rest = np.uint64(_ONE) - last
                last <<= _TWO
                q = spot[k]
                q -= last
                q //= rest
                high = of_high.take(in_high[k] + (q >> np.uint64(PART)).view(np.int64)).astype(np.int64)
                s = m.high.take(row_high[k] + high).astype(np.uint64)
                a = s >> _16
                a <<= np.uint64(PART)
                s &= _LOW
                q -= a
                q //= s
                context = high // m.step
                lo = of_low.take(in_low[k] + context * _ONE + q.view(np.int64))
                context += row_low[k]
                context <<= 8
                context += lo
                b = m.low.take(context).astype(np.uint64)
                a *= rest
                rest *= s
                a += rest * (b >> _16)
                a += last
                start[k] = a
                b &= _LOW
                rest *= b
                size[k] = rest
                high <<= 8
                high += lo
                ids[k] = high
            start *= unit
            code -= start
            np.multiply(unit, size, out=size_)
            out = (size_ < _TOP).nonzero()[0]
            if len(out):
                left, place = size_[out], at[out]
                more = np.less(left, np.uint64(1 << 32)).view(np.uint8)
                shift = more.astype(np.uint64)
                shift <<= np.uint64(4)
                shift += _16
                code[out] = code[out] << shift | next2.take(np.minimum(place, last_word)).astype(np.uint64) >> _32 - shift
                size_[out] = left << shift
                place += more
                place += 1
                at[out] = place
            ids_out[begin + t] = ids
            m.two[h2] = ids
            m.one[h1] = ids
            h2 = before * 30011
            before = ids.astype(np.int64)
        where = np.flatnonzero(misses)
        m.learn(hits2, ~(hits2 | misses), ids_out[begin:end].ravel()[where].astype(np.int64), where % lanes)
        if renew := due and end < length:
            m.renew()
    return ids_out


def pack_flat(flat: np.ndarray, lengths: np.ndarray, names: list[int | None], vocab: int) -> bytes:
    """A segment of whole documents as bytes: their ids one after the other, how many each has, and their doc_ids."""
    # a small segment has shorter blocks: the coder's steps are as many as a block has ids, whatever the lanes
    block = min(BLOCK_IDS, max(LEAST_BLOCK, -(-len(flat) // LANES)))
    blocks = -(-len(flat) // block)
    length = min(block, len(flat))
    held = np.array([x is not None for x in names], np.uint8)
    table = zlib.compress(lengths.astype("<u8").tobytes() + np.array([x or 0 for x in names], "<i8").tobytes() + held.tobytes(), 1)
    coded, sums, sizes = [], [], []
    if blocks:
        padded = np.zeros(blocks * length, np.uint32)
        padded[: len(flat)] = flat
        coded = encode_blocks(np.ascontiguousarray(padded.reshape(blocks, -1).T), vocab)
        for k in range(blocks):
            own = flat[k * block : (k + 1) * block]
            sizes.append(len(own))
            sums.append(zlib.crc32(coded[k], zlib.crc32(own.astype("<u4").tobytes())))
    index = np.array([sizes, [len(c) // 2 for c in coded], sums], "<u4").tobytes()
    front = HEADER.pack(MAGIC, 2, vocab, block, len(names), blocks) + struct.pack("<I", len(table)) + table + index
    return front + struct.pack("<I", zlib.crc32(front)) + b"".join(coded)


def unpack_flat(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """The inverse of ``pack_flat``; raises where the bytes are not a whole segment or a checksum differs."""
    if len(payload) < HEADER.size + 8:
        raise ValueError("token segment is cut short")
    magic, version, vocab, _, n_docs, blocks = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 2:
        raise ValueError("not a token segment")
    at = HEADER.size + 4
    (n,) = struct.unpack_from("<I", payload, at - 4)
    end = at + n + 12 * blocks
    if len(payload) < end + 4 or zlib.crc32(payload[:end]) != struct.unpack_from("<I", payload, end)[0]:
        raise ValueError("token segment's header fails its checksum")
    table = zlib.decompress(payload[at : at + n])
    lengths, names = (np.frombuffer(table, k, n_docs, x * n_docs).astype(np.int64) for k, x in (("<u8", 0), ("<i8", 8)))
    held = np.frombuffer(table, np.uint8, n_docs, 16 * n_docs)
    sizes, words, sums = np.frombuffer(payload, "<u4", 3 * blocks, at + n).reshape(3, blocks) if blocks else np.zeros((3, 0), np.uint32)
    ends = end + 4 + 2 * np.cumsum(words.astype(np.int64))
    if blocks and len(payload) != ends[-1]:
        raise ValueError("token segment is cut short")
    flat = np.empty(0, np.uint32)
    if blocks:
        coded = [payload[b - 2 * int(n) : b] for b, n in zip(ends.tolist(), words, strict=True)]
        try:
            out = np.ascontiguousarray(decode_blocks(coded, int(sizes[0]), vocab).T)
        except IndexError as e:  # damaged code words lead out of the tables
            raise ValueError("token block can't be decoded") from e
        for k, want in enumerate(sums):
            if zlib.crc32(coded[k], zlib.crc32(out[k, : sizes[k]].astype("<u4").tobytes())) != want:
                raise ValueError("token block fails its checksum")
        flat = out.ravel()[: sizes.sum(dtype=np.int64)]
    if lengths.sum() != len(flat):
        raise ValueError("token segment's lengths differ")
    return flat, lengths, [x if y else None for x, y in zip(names.tolist(), held.tolist(), strict=True)]


def pack_segment(docs: list[np.ndarray], vocab: int) -> bytes:
    """A segment of whole documents (their ids), numbered from 0, as bytes."""
    return pack_flat(np.concatenate(docs) if docs else np.empty(0, np.uint32), np.array([len(d) for d in docs], np.int64), list(range(len(docs))), vocab)


def unpack_segment(payload: bytes) -> list[np.ndarray]:
    """The documents' ids (see ``unpack_flat``)."""
    flat, lengths, _ = unpack_flat(payload)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of a column that hold about ``most`` bytes each, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // most
    edges = np.flatnonzero(np.diff(size, prepend=-1, append=np.inf if not len(size) else size[-1] + 1)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b - a


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens_of(path)
        shard, seg, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        docs: list[int | None] = []

        def out() -> pa.RecordBatch:
            values = [[shard], [seg], [held], [pack_flat(np.concatenate(ids), np.concatenate(lengths), docs, t.size)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "seg", "n_ids", "payload"])

        for b in batches:
            for at, count in slices(b.column(1)):
                part = b.slice(at, count)
                flat, n = t.encode_column(part.column(1))
                ids.append(np.insert(flat, np.cumsum(n), np.uint32(end_id)))
                lengths.append(n + 1)
                docs += part.column(0).to_pylist()
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield out()
                    seg, ids, lengths, docs, held = seg + 1, [], [], [], 0
        if docs:
            yield out()
        del ids[:], lengths[:]
        give_back()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            shard, seg, held = (b.column(k)[row].as_py() for k in range(3))
            flat, n, docs = unpack_flat(b.column(3)[row].as_py())
            if len(flat) != held:
                raise ValueError("token segment's count of ids differs")
            ends = np.cumsum(n)
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - x) : 4 * e]) for e, x in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard)), pa.array(np.full(len(n), seg)), pa.array(docs, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                ["shard", "seg", "doc_id", "inner", "n_tokens", "ids_crc32"])
            del flat, raw
    give_back()


#: A row of a file.
SEGMENT = "shard long, seg long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Tokenize ``docs(doc_id, text)`` and write the ids at ``path`` in ascending doc_id order.

    ``end_id`` closes every document; a null or empty text is that id alone. Null ids come first; rows that repeat an id
    are all written, next to each other, in no stated order. Further columns are ignored.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_segments(tokenizer, end_id), SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files' bytes, all checksums verified."""
    files = spark.read.schema(SEGMENT).parquet(path)
    rows = files.select("shard", "seg", "n_ids", "payload").mapInArrow(_read, "shard long, seg long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # a row for each shard: as many as the write had partitions
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = files.select("shard", "seg", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seg")) - F.col("n_ids")).alias("behind"))
    offsets = inside.join(shards, "shard").select("shard", "seg", (F.col("before") + F.col("behind")).alias("base"))
    return rows.join(offsets, ["shard", "seg"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and describe every document as the files hold it."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
