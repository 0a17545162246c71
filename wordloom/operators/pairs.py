"""Counts of the word pairs of sentences, moved as packed blocks instead of rows.

Words are dealt into buckets by a hash. A task over sentences numbers its words, sorts and counts some
millions of pairs at a time and sends, for each two buckets, its words of these and their pairs as
differences of sorted numbers, one to two bytes a pair. The task of two buckets has all pairs of their
words and, as every source sends all its words, their frequencies: neither a table of all words nor a
row a pair is shuffled. Of the pairs of two buckets one part at a time is held in memory."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.scores import of_arrays, rounded_array

#: Parts of a bucket.
PARTS = 8
#: Bits of a word's number within its part, of a part, and of a count that stands beside a pair; 6 are left for each bucket.
_RANK, _PART, _COUNT = 20, 3, 6
_CELL = _RANK + _PART
_MOST_BUCKETS = 64
#: Pairs that are sorted at once, counted pairs that a task over sentences holds, and those that a task of two buckets adds up at once.
RAW, HELD, ADDED = 1 << 21, 6 << 20, 3 << 20
#: Words of sources whose numbers are looked up at once; rows of a result batch.
_LOOKED_UP, _ROWS = 1 << 20, 1 << 16
_PACKED = "block int, part int, source long, data binary"
_COLUMNS = {"w1": "string", "w2": "string", "cooc": "long", "df1": "long", "df2": "long", "n_sentences": "long", "pmi": "double", "npmi": "double"}


def counted(sentences: DataFrame, columns: Sequence[str] = ("w1", "w2", "cooc"), digits: int | None = None) -> DataFrame:
    """The pairs w1 < w2, by bytes, of sentences(ws), arrays of words in any order and number.

    ``columns``: also of df1, df2, n_sentences, which counts rows without words too, pmi and npmi, rounded to
    ``digits`` if given. Scores are computed on whole arrays; a row's rounding alone costs Spark more than all else about it."""
    tasks = max(3 * sentences.sparkSession.sparkContext.defaultParallelism, sentences.rdd.getNumPartitions() // 4)
    buckets = min(_MOST_BUCKETS, math.ceil(math.sqrt(2 * tasks)))
    packed = sentences.select("ws").mapInArrow(_packed(buckets), _PACKED)
    dealt = packed.repartitionById(buckets * (buckets + 1) // 2, "block").sortWithinPartitions("block", "part", "source")
    return dealt.mapInArrow(_added(columns, digits), ", ".join(f"{c} {_COLUMNS[c]}" for c in columns))


def _zip(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unzip(data: memoryview) -> memoryview:
    return memoryview(pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], codec="zstd"))


def _firsts(ordered: np.ndarray, shift: int = 0) -> np.ndarray:
    """Where a new value begins, but for the low ``shift`` bits."""
    new = np.empty(len(ordered), bool)
    new[:1] = True
    for k in range(1, len(ordered), 1 << 16):  # what is held in between stays small
        end = min(k + (1 << 16), len(ordered))
        np.not_equal((ordered[k:end] ^ ordered[k - 1 : end - 1]) >> np.uint64(shift), 0, out=new[k:end])
    return np.flatnonzero(new)


class _Source:
    """Words and counted pairs of some sentences. A pair is a number: bucket of the first word, of the second,
    part and number of the first, of the second, with room for a count."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.n = buckets, 0
        self.words = pa.array([], pa.string())
        self.codes, self.df = np.empty(0, np.uint64), np.empty(0, np.int64)  # by word
        self.sizes = np.zeros(buckets * PARTS, np.int64)
        self.waiting: list[pa.Array] = []
        self.raw: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []

    def full(self) -> bool:
        return sum(map(len, self.runs)) > HELD or self.sizes.max() > (1 << _RANK) - (1 << 19)

    def add(self, lists: pa.Array) -> None:
        self.n += len(lists)
        self.waiting.append(lists)
        if sum(len(x.values) for x in self.waiting) > _LOOKED_UP // 4:
            self.look_up()

    def look_up(self) -> None:
        """Numbers the words of the sentences that wait and makes their pairs; words keep the numbers that they have."""
        lists, self.waiting = pa.concat_arrays(self.waiting), []
        known = len(self.words)
        found = pa.concat_arrays([self.words, lists.flatten()]).dictionary_encode()
        if len(found) == known:
            return
        self.words = found.dictionary
        cells = np.fromiter(map(crc32, self.words[known:].cast(pa.binary()).to_pylist()), np.int64, len(self.words) - known) % len(self.sizes)
        order, new = np.argsort(cells, kind="stable"), np.bincount(cells, minlength=len(self.sizes))
        ranks = np.empty(len(cells), np.int64)
        ranks[order] = np.arange(len(cells)) - np.repeat(np.cumsum(new) - new, new)
        codes = cells // PARTS << _CELL | cells % PARTS << _RANK | ranks + self.sizes[cells]
        self.codes, self.sizes = np.concatenate([self.codes, codes.astype(np.uint64)]), self.sizes + new
        rows = np.repeat(np.arange(len(lists), dtype=np.uint64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = rows << np.uint64(32) | found.indices.to_numpy(zero_copy_only=False)[known:].astype(np.uint64)
        at.sort()
        at = at[_firsts(at)]
        ids = (at & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(ids, minlength=len(self.words))
        df[:known] += self.df
        self.df = df
        at = at >> np.uint64(32) << np.uint64(32) | self.codes[ids]
        at.sort()
        self._pair(at)

    def _pair(self, at: np.ndarray) -> None:
        rows, codes = at >> np.uint64(32), at & np.uint64(0xFFFFFFFF)
        starts = _firsts(rows)
        sizes = np.diff(np.append(starts, len(at)))
        later = np.repeat(starts + sizes, sizes) - np.arange(len(at)) - 1  # words of the sentence that come after a word
        bucket, within = codes >> np.uint64(_CELL), codes & np.uint64((1 << _CELL) - 1)
        first = bucket << np.uint64(58) | within << np.uint64(_CELL + _COUNT)
        second = bucket << np.uint64(52) | within << np.uint64(_COUNT)
        ends = np.cumsum(later)
        lo = 0
        while lo < len(at):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + RAW, "right")))
            n = later[lo:hi]
            to = np.arange(ends[hi - 1] - done) + np.repeat(np.arange(lo, hi) + 1 - (ends[lo:hi] - n - done), n)
            self.raw.append(np.repeat(first[lo:hi], n) | second[to])
            if sum(map(len, self.raw)) >= RAW:
                self._count()
            lo = hi

    def _count(self) -> None:
        """Sorts and counts the raw pairs; a pair whose count has no room beside it stands there several times."""
        if not self.raw:
            return
        pairs = np.concatenate(self.raw)
        self.raw = []
        pairs.sort()
        at = _firsts(pairs)
        counts = np.diff(np.append(at, len(pairs)))
        self.runs.append(self._noted(pairs[at], counts))

    @staticmethod
    def _noted(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        most = (1 << _COUNT) - 1
        large = np.flatnonzero(counts > most)
        times = (counts[large] - 1) // most
        more = np.repeat(pairs[large] | np.uint64(most), times)
        counts[large] -= (times * most).astype(counts.dtype)
        pairs |= counts.astype(np.uint64)
        return np.concatenate([pairs, more]) if len(more) else pairs

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        runs = np.concatenate(self.runs) if self.runs else np.empty(0, np.uint64)
        self.runs = []
        runs.sort()
        at = _firsts(runs, _COUNT)
        small = runs.astype(np.uint8)
        small &= (1 << _COUNT) - 1
        counts = np.add.reduceat(small, at, dtype=np.uint32) if len(at) else np.empty(0, np.uint32)
        pairs = runs[at]
        pairs &= ~np.uint64((1 << _COUNT) - 1)
        return pairs, counts

    def blocks(self, source: int) -> pa.RecordBatch:
        """For each two buckets a row of words, part -1, and rows of pairs."""
        if self.waiting:
            self.look_up()
        self._count()
        pairs, counts = self._sum()
        sizes = self.sizes.reshape(self.buckets, PARTS)
        before, rank = np.cumsum(sizes, 1) - sizes, np.uint64((1 << _RANK) - 1)
        order = np.argsort(self.codes)
        words, df, ends = self.words.take(pa.array(order)), self.df[order], np.cumsum(sizes.sum(1))
        dealt = [_words(words.slice(end - n, n), df[end - n : end], own) for end, n, own in zip(ends, sizes.sum(1), sizes)]
        rows: list[tuple[int, int, bytes]] = []
        for i in range(self.buckets):
            for j in range(i, self.buckets):
                block = j * (j + 1) // 2 + i
                two = [dealt[i]] if i == j else [dealt[i], dealt[j]]
                rows.append((block, -1, struct.pack("<qq", self.n, len(dealt[i])) + b"".join(two)))
                parts = np.uint64(i << 58 | j << 52) + (np.arange(PARTS, dtype=np.uint64) << np.uint64(49))
                end = np.searchsorted(pairs, np.uint64(i << 58 | j << 52 | (1 << 52) - 1), "right")
                cuts = np.append(np.searchsorted(pairs, parts), end)
                for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        own = pairs[lo:hi]
                        numbers = (own >> np.uint64(_CELL + _COUNT) & rank) * np.uint64(sizes[j].sum())
                        numbers += (own >> np.uint64(_COUNT) & rank) + before[j].astype(np.uint64)[own >> np.uint64(_COUNT + _RANK) & np.uint64(PARTS - 1)]
                        rows.append((block, p, _pairs(numbers, counts[lo:hi])))
        block, part, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array([source] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["block", "part", "source", "data"])


def _words(words: pa.Array, df: np.ndarray, sizes: np.ndarray) -> bytes:
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    text = memoryview(data)[at[0] : at[-1]] if at[-1] > at[0] else b""
    return _zip(sizes.astype(np.uint32).tobytes() + np.diff(at).astype(np.uint32).tobytes() + df.astype(np.uint32).tobytes() + bytes(text))


def _read_words(data: memoryview) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw = _unzip(data)
    sizes = np.frombuffer(raw, np.uint32, PARTS).astype(np.int64)
    n = int(sizes.sum())
    lengths, df = np.frombuffer(raw, np.uint32, 2 * n, 4 * PARTS).reshape(2, n)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 * PARTS + 8 * n :]))
    return words, df.astype(np.int64), sizes


def _pairs(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences by bytes, low ones first, then counts up to 254; larger ones at the end."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    large = counts[counts >= 255]
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<qq", len(numbers), width) + _zip(planes + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes())


def _read_pairs(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<qq", data)
    raw = _unzip(data[16:])
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    counts = np.frombuffer(raw, np.uint8, n, n * width).astype(np.uint32)
    counts[counts == 255] = np.frombuffer(raw[n * (width + 1) :], np.uint32)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), counts


def _packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, task, source = _Source(buckets), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            held.add(batch.column(0))
            if held.full():
                held.runs = [held._noted(*held._sum())]
                if held.full() or len(held.runs[0]) > 0.7 * HELD:
                    yield held.blocks(task | source)
                    held, source = _Source(buckets), source + 1
        if held.n:
            yield held.blocks(task | source)

    return run


class _Block:
    """The words of two buckets from all sources, then the pairs of one part after the other."""

    def __init__(self) -> None:
        self.n, self.words, self.df = 0, pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.waiting: list[tuple[int, list[tuple[pa.Array, np.ndarray, np.ndarray]]]] = []
        self.maps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.rank: np.ndarray | None = None
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add_words(self, source: int, data: memoryview) -> None:
        n, cut = struct.unpack_from("<qq", data)
        self.n += n
        self.waiting.append((source, [_read_words(x) for x in (data[16 : 16 + cut], data[16 + cut :]) if len(x)]))
        if sum(len(w) for _, both in self.waiting for w, _, _ in both) > max(_LOOKED_UP, len(self.words)):
            self._look_up()

    def _look_up(self) -> None:
        """Words keep the numbers that they have; new ones get the next."""
        found = pa.chunked_array([self.words, *(w for _, both in self.waiting for w, _, _ in both)]).combine_chunks().dictionary_encode()
        ids = found.indices.to_numpy(zero_copy_only=False)
        at, self.words = len(self.words), found.dictionary
        df = np.zeros(len(self.words), np.int64)
        df[: len(self.df)] = self.df
        for source, both in self.waiting:
            own = []
            for words, n, _ in both:
                own.append(ids[at : at + len(words)].astype(np.int32))
                df[own[-1]] += n  # a source has a word once
                at += len(words)
            self.maps[source] = own[0], own[-1], np.concatenate([[0], np.cumsum(both[0][2])])
        self.df, self.waiting = df, []

    def add_pairs(self, source: int, part: int, data: memoryview) -> None:
        if self.rank is None:
            if self.waiting:
                self._look_up()
            order = pc.sort_indices(self.words).to_numpy()
            self.rank = np.empty(len(order), np.int64)
            self.rank[order] = np.arange(len(order))
            self.words, self.df = self.words.take(pa.array(order)), self.df[order]
        one, two, starts = self.maps[source]
        numbers, counts = _read_pairs(data)
        a = numbers // np.uint64(len(two))
        b = (numbers - a * np.uint64(len(two))).astype(np.int64)
        a, b = self.rank[one[a.astype(np.int64) + starts[part]]], self.rank[two[b]]
        self.pairs.append((np.minimum(a, b) * len(self.words) + np.maximum(a, b)).astype(np.uint64))
        self.counts.append(counts)
        if len(self.pairs) > 1 and sum(map(len, self.pairs)) > max(ADDED, 2 * len(self.pairs[0])):
            self._add_up()

    def _add_up(self) -> None:
        pairs, counts = np.concatenate(self.pairs), np.concatenate(self.counts)
        self.pairs = self.counts = []
        bits = int(counts.max()).bit_length()
        if (len(self.words) ** 2).bit_length() + bits <= 64:
            pairs <<= np.uint64(bits)
            pairs |= counts.astype(np.uint64)
            pairs.sort()
            counts = pairs & np.uint64((1 << bits) - 1)
            pairs >>= np.uint64(bits)
        else:
            order = np.argsort(pairs)
            pairs, counts = pairs[order], counts[order]
        at = _firsts(pairs)
        self.pairs, self.counts = [pairs[at]], [np.add.reduceat(counts, at, dtype=np.int64)]

    def taken(self, columns: Sequence[str], digits: int | None) -> Iterator[pa.RecordBatch]:
        """The rows of the part that was added last."""
        if not self.pairs:
            return
        self._add_up()
        (pairs,), (counts,) = self.pairs, self.counts
        self.pairs, self.counts = [], []
        for k in range(0, len(pairs), _ROWS):
            one = (pairs[k : k + _ROWS] // np.uint64(len(self.words))).astype(np.int64)
            two = (pairs[k : k + _ROWS] - one.astype(np.uint64) * np.uint64(len(self.words))).astype(np.int64)
            made = {"cooc": counts[k : k + _ROWS]}
            if len(columns) > 3:
                made |= {"df1": self.df[one], "df2": self.df[two], "n_sentences": np.full(len(one), self.n)}
                scores = of_arrays(made["cooc"], made["df1"], made["df2"], self.n)
                made |= {c: x if digits is None else rounded_array(x, digits) for c, x in scores.items() if c in columns}
            made = {c: pa.array(x) for c, x in made.items() if c in columns}
            made |= {c: self.words.take(pa.array(x)).cast(pa.string()) for c, x in (("w1", one), ("w2", two))}
            yield pa.RecordBatch.from_pydict({c: made[c] for c in columns})


def _added(columns: Sequence[str], digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (-1, -1), _Block()
        for batch in batches:
            data = batch.column(3)
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != at:
                    yield from held.taken(columns, digits)
                    if key[0] != at[0]:
                        held = _Block()
                    at = key
                source, row = batch.column(2)[k].as_py(), memoryview(data[k].as_buffer())
                if key[1] < 0:
                    held.add_words(source, row)
                else:
                    held.add_pairs(source, key[1], row)
        yield from held.taken(columns, digits)

    return run
