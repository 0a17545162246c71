"""Packing by cutting-stock column generation over a histogram of piece lengths."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

CAPACITY = 4096
#: Lengths are rounded up to this many tokens for the linear program; at most CAPACITY / GRAIN classes.
GRAIN = 16
END_ID = 2
#: Distinct words, and pieces of words, whose ids a worker remembers at once.
MEMORY = 400_000


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits, by dynamic programming over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = sizes <= c
        value = np.where(fit, best[np.maximum(c - sizes, 0)] + prices, -1.0)
        k = int(value.argmax())
        best[c], last[c] = (value[k], k) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), column


def patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = 5e-3, most: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) that hold the demand exactly, in nearly the fewest bins.

    Simplex on the master program, columns priced by ``_knapsack``, until the bound that the best
    price gives is within ``gap`` (or after ``most`` columns: then the bins are valid but more).
    Times are rounded down and the few pieces left are packed first-fit by falling size.
    """
    if not len(sizes):
        return []
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ demand
    for _ in range(most):
        prices = inverse.sum(axis=0)
        value, column = _knapsack(sizes, prices, capacity)
        if value <= 1 + gap:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[:, out] = column
    plan, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        column = columns[:, k].astype(np.int64)
        used = column > 0
        times = min(int(x[k] + 1e-6), int((left[used] // column[used]).min()))
        if times > 0:
            plan.append((times, column))
            left = left - times * column
    while left.any():
        column, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.argsort(-sizes, kind="stable"):
            column[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(column[k] * sizes[k])
        used = column > 0
        times = int((left[used] // column[used]).min())
        plan.append((times, column))
        left = left - times * column
    return plan


# How the vocabulary's file prepares a text, as read from its tokenizer.
_PREPARED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Letters beyond ASCII that NFC leaves alone and that have one lower-case letter.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_PLAIN_TEXT = re.compile(f"[!-~ \\n\\t\\r{_LETTERS}]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{_LETTERS}]+|[0-9]|[^A-Za-z0-9 \\n\\t\\r{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(256 + n) for n, b in enumerate(rest)}


class _Known(dict):
    """Ids of the words met so far; of another word they are found, and kept, when asked for."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find = find

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = self[word] = self.find(word)
        return ids


class Tokens:
    """Ids of the words of a text; words recur, so each is encoded once while it is remembered.

    The vocabulary drops white space and never merges across it, so a text's ids are its words' ids.
    A text, or else a word, of ASCII and common Latin letters is split and lower-cased here, and its pieces go
    straight to the tokenizer's model and are remembered too; all other words go through the whole tokenizer,
    as do all words of a tokenizer that prepares texts otherwise.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.model, self.known, self.pieces = whole.encode, whole.model, _Known(self._ids), _Known(self._piece)
        prepared = tuple(json.loads(part.__getstate__()) if part else None for part in (whole.normalizer, whole.pre_tokenizer))
        self.split = prepared == _PREPARED and not self.model.dropout and all("<|" in t.content for t in whole.get_added_tokens_decoder().values())
        self.letters = _byte_letters()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(found)}I", *found)

    def _ids(self, word: str) -> bytes:
        if self.split and "<|" not in word and _PLAIN.fullmatch(word):
            pieces = _PIECE.findall(word.lower())
            return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))
        return np.array(self.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes() if word else b""

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.split and "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """What a worker remembers goes from task to task."""
    return Tokens(path)


def _cut(path: str, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, nth = _tokens(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, rows = batch.slice(at, 512), []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = tokens(text or "") + END_ID.to_bytes(4, "little")
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        size = -(-length // grain)
                        k = nth[size] = nth.get(size, -1) + 1
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, size, part, k))
                if rows:
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def _seated(plan: list[tuple[int, np.ndarray]], sizes: np.ndarray):
    """Places ranked pieces of each size: rank -> pattern, then sequence and slot within it."""
    table: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    done, sequence = np.zeros(len(sizes), np.int64), 0
    for times, column in plan:
        slot = 0
        for k in np.flatnonzero(column):
            table[int(sizes[k])].append((int(done[k]), sequence, int(column[k]), slot))
            slot += int(column[k])
        done += times * column
        sequence += times
    arrays = {s: np.array(rows, dtype=np.int64).T for s, rows in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, at, each, low = arrays[int(s)]
                mine = size == s
                p = np.searchsorted(first, rank[mine], side="right") - 1
                k = rank[mine] - first[p]
                seq[mine], slot[mine] = at[p] + k // each[p], low[p] + k % each[p]
            keep = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(slot)], names=[*keep.schema.names, "sequence_id", "slot"])

    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents longer than a sequence are cut into full sequences and a rest; all others stay whole.
    The driver sees only how many pieces each of at most capacity / grain lengths has. A piece's rank
    among those of its length is its place within its partition plus what earlier partitions hold, so
    no length, however common, meets in one task. A null text is empty and still has its end id; null
    and repeated ids pass through; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth")
    pieces = written(own.mapInArrow(_cut(tokenizer, capacity, grain), ", ".join(f"{c} long" for c in columns)), "pieces")
    counts = written(pieces.groupBy("size", "part").count(), "counts")
    totals = sorted((r["size"], r["total"]) for r in counts.groupBy("size").agg(F.sum("count").alias("total")).collect())
    sizes, demand = np.array([s for s, _ in totals], np.int64), np.array([n for _, n in totals], np.int64)
    plan = patterns(demand, sizes, capacity // grain)
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("size", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = ", ".join(f"{c} long" for c in (*columns[:5], "sequence_id", "slot"))
    seated = ranked.mapInArrow(_seated(plan, sizes), out)
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seated.withColumn("offset", F.sum("length").over(so_far) - F.col("length")).drop("slot")
