"""Embedding near-duplicates by spherical caps: random product codes, list decoding, verification."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stage import drop, written

#: Vectors of fewer dimensions are padded with zeros to as many; inner products stay.
LEAST_DIM = 16


@dataclass(frozen=True)
class Caps:
    """Filter directions are, in each of ``codes`` random rotations, all pairs of codewords of the two halves.

    A vector joins every direction whose inner product with it is at least a height, and no other.
    Height and number of codewords follow from the dimensions, the vectors of the largest label and
    the links looked for, by exact probabilities on the sphere (``shape``): a pair at ``cosine``
    shares ``shared`` filters on average, and a vector meets about ``mates`` unrelated ones in all
    its filters, as far as no more than ``most`` codewords a half are needed; beyond that filters
    grow, nothing is dropped. Members of a filter are compared ``block`` against ``block``.
    """

    cosine: float = 0.93
    codes: int = 12
    shared: float = 24.0
    mates: float = 8.0
    most: int = 2048
    block: int = 512
    seed: int = 11


def both_exceed(height: float, dim: int, angle: float) -> float:
    """Chance that two unit vectors at ``angle`` both exceed a random direction by ``height``."""
    turn = (np.arange(4000) + 0.5) * (2 * np.pi / 4000)
    low = np.minimum(np.cos(turn), np.cos(turn - angle))
    hit = low > height
    # the squared length of a direction's part in the plane of both is Beta(1, dim / 2 - 1)
    return float(((1 - (height / low[hit]) ** 2) ** (dim / 2 - 1)).sum() / len(turn))


def shape(dim: int, vectors: int, how: Caps) -> tuple[float, int]:
    """Height of the caps and codewords of a half, for at most ``vectors`` of one label."""
    angle, best = math.acos(how.cosine), (0.0, 1)
    for step in range(20, 120):
        height = step / 20 / math.sqrt(dim)
        pair = both_exceed(height, dim, angle) if height < 1 else 0.0
        words = math.ceil(math.sqrt(how.shared / how.codes / pair)) if pair else how.most + 1
        if words > how.most:
            break
        best = height, words
        if how.codes * (words * both_exceed(height, dim, 0.0)) ** 2 * vectors <= how.mates:
            break
    return best


class Code:
    """Directions of one dimension, and the list decoding of vectors to those they exceed."""

    def __init__(self, dim: int, vectors: int, how: Caps) -> None:
        self.pad = max(0, LEAST_DIM - dim) or dim % 2
        width = dim + self.pad
        self.height, self.words = shape(width, vectors, how)
        self.halves = []
        for k in range(how.codes):
            rng = np.random.default_rng([how.seed, width, k])
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
            words = rng.standard_normal((2, self.words, width // 2))
            words /= np.linalg.norm(words, axis=2, keepdims=True)
            self.halves.append(tuple(np.ascontiguousarray(x, dtype=np.float32) for x in (turn, words[0].T, words[1].T)))

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every direction that each row exceeds, in single precision, by row, then direction.

        A codeword can only take part if it and the best one of the other half reach the height
        together; all pairs of those that can are tried."""
        unit = np.pad(unit, ((0, 0), (0, self.pad))).astype(np.float32)
        need, mid = np.float32(self.height * math.sqrt(2)), unit.shape[1] // 2
        rows, found = [], []
        for k, (turn, one, two) in enumerate(self.halves):
            spun = unit @ turn
            first, second = spun[:, :mid] @ one, spun[:, mid:] @ two
            row, i = np.divmod(np.flatnonzero(first >= need - second.max(axis=1, keepdims=True)), self.words)
            other, j = np.divmod(np.flatnonzero(second >= need - first.max(axis=1, keepdims=True)), self.words)
            per = np.bincount(other, minlength=len(unit))
            begin, times = (np.cumsum(per) - per)[row], per[row]
            left = np.repeat(np.arange(len(row)), times)
            right = np.arange(len(left)) + np.repeat(begin - np.cumsum(times) + times, times)
            ok = first[row, i][left] + second[other, j][right] >= need
            left, right = left[ok], right[ok]
            rows.append(row[left])
            found.append((k * self.words + i[left]) * self.words + j[right])
        row, direction = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((direction, row))
        return row[order], direction[order].astype(np.int32)


@lru_cache(maxsize=8)
def _code(dim: int, vectors: int, how: Caps) -> Code:
    return Code(dim, vectors, how)


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest of label and vector; none for what links with nothing."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            marks, labelled = part.column(1).fill_null(0).to_pylist(), part.column(1).is_valid().to_numpy(zero_copy_only=False)
            sizes = part.column(2).value_lengths().fill_null(0).to_numpy()
            begins, flat = np.cumsum(sizes) - sizes, part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            digests: list[bytes | None] = [None] * part.num_rows
            data, dims = list(digests), np.zeros(part.num_rows, np.int32)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero((sizes == dim) & labelled)
                v = flat[begins[rows][:, None] + np.arange(dim)]
                ok = np.isfinite(v).all(axis=1) & v.any(axis=1)  # a null component is NaN here
                rows, v = rows[ok], v[ok]
                with np.errstate(over="ignore"):
                    single = v.astype("<f4")
                dims[rows] = dim
                # single precision where that loses nothing
                for k, x, y, short in zip(rows.tolist(), v, single, (single == v).all(axis=1).tolist(), strict=True):
                    data[k] = (y if short else x).tobytes()
                    digests[k] = hashlib.blake2b(struct.pack("<qq", marks[k], dim) + x.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), pa.array(digests, pa.binary()), pa.array(dims), pa.array(data, pa.binary())],
                names=["id", "label", "digest", "dim", "vector"],
            )


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Binary vectors of one length, in single or double precision, at unit length in double precision."""
    raw = vectors.to_pylist()
    if all(len(x) == 4 * dim for x in raw):
        v = np.frombuffer(b"".join(raw), "<f4").reshape(-1, dim).astype(float)
    else:
        v = np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8").astype(float) for x in raw])
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow below
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _filtered(how: Caps, vectors: int):
    """Adds the directions that each vector exceeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dims = part.column("dim").to_numpy()
                own: list[np.ndarray] = [np.zeros(0, np.int32)] * part.num_rows
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    row, direction = _code(dim, vectors, how).filters(_unit(part.column("vector").take(pa.array(rows)), dim))
                    ends = np.cumsum(np.bincount(row, minlength=len(rows)))[:-1]
                    for r, found in zip(rows, np.split(direction, ends), strict=True):
                        own[r] = found
                columns = [*part.columns, pa.array(own, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "filters"])

    return run


def _earlier(lists: list[np.ndarray], before: int) -> np.ndarray | None:
    """Which members share a filter that comes before this one; None where all do, by one filter."""
    held = [x[: np.searchsorted(x, before)] for x in lists]
    flat = np.concatenate(held)
    names, place = np.unique(flat, return_inverse=True)
    times = np.bincount(place, minlength=len(names))
    if len(names) and times.max() == len(held):
        return None
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    more = times[place] > 1
    slot = np.cumsum(times > 1) - 1
    has = np.zeros((len(held), int((times > 1).sum())), np.float32)
    has[row[more], slot[place[more]]] = 1
    return has @ has.T > 0


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join what the pairs (a, b) of n members join, fewer than n."""
    label, out = list(range(n)), []

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        p_, q_ = find(p), find(q)
        if p_ != q_:
            label[max(p_, q_)] = min(p_, q_)
            out.append((p, q))
    return out


def _linked(how: Caps):
    """Rows (a, n, b) of cells: n vectors, copies counted, are linked with a; b is linked with a.

    Each linked pair counts in the first filter that both exceed, so in no other cell; a cell gives a row
    for a member and for a link of a spanning forest, never one for every pair."""
    keys = ("key", "i", "j", "label", "dim", "filter")

    def report(rows: pa.RecordBatch, near: np.ndarray, out: list[tuple[int, int, int | None]]) -> None:
        """What a cell with pairs that are near, in the upper triangle, gives."""
        lists = rows.column("filters")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]
        before = _earlier(np.split(flat, ends), rows.column("filter")[0].as_py())
        if before is None:
            return
        a, b = np.nonzero(near & ~before)
        ids, size = rows.column("id").to_numpy(), rows.column("size").to_numpy()
        n = np.bincount(a, weights=size[b], minlength=len(ids)) + np.bincount(b, weights=size[a], minlength=len(ids))
        out += [(int(ids[k]), int(n[k]), None) for k in np.flatnonzero(n)]
        out += [(int(ids[p]), 0, int(ids[q])) for p, q in _forest(a, b, len(ids))]

    def cells(table: pa.RecordBatch, edges: np.ndarray, out: list[tuple[int, int, int | None]]) -> None:
        """Compares the members of each cell, rows edges[k] to edges[k + 1]; cells of one size side by side."""
        begin, size = edges[:-1], np.diff(edges)
        dims, block = table.column("dim").to_numpy(), table.column("block").to_numpy()
        cross = table.column("i").to_numpy()[begin] != table.column("j").to_numpy()[begin]
        for dim in np.unique(dims[begin[size > 1]]).tolist():
            rows = np.flatnonzero(dims == dim)
            unit = _unit(table.column("vector").take(pa.array(rows)), dim)
            place = np.cumsum(dims == dim) - 1
            for m in np.unique(size[(size > 1) & (dims[begin] == dim)]).tolist():
                some = np.flatnonzero((size == m) & (dims[begin] == dim))
                step = max(1, (1 << 20) // (m * max(m, dim)))
                upper = np.triu(np.ones((m, m), dtype=bool), 1)
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    member = begin[part][:, None] + np.arange(m)
                    v, own = unit[place[member]], block[member]
                    near = (v @ v.transpose(0, 2, 1) >= how.cosine) & upper
                    near &= ~cross[part][:, None, None] | (own[:, :, None] != own[:, None, :])
                    for k in np.flatnonzero(near.any(axis=(1, 2))):
                        report(table.slice(begin[part[k]], m), near[k], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the cell that may go on in the next batch
        out: list[tuple[int, int, int | None]] = []

        def done() -> pa.RecordBatch:
            table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "n", "b"])
            out.clear()
            return table

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                table = batch.slice(at, 4096)
                table = table if held is None else pa.concat_batches([held, table])
                new = np.zeros(table.num_rows, dtype=bool)
                for c in keys:
                    marks = table.column(c).dictionary_encode().indices.to_numpy() if c == "label" else table.column(c).to_numpy()
                    new[1:] |= marks[1:] != marks[:-1]
                edges = np.concatenate([[0], np.flatnonzero(new)])
                held = table.slice(edges[-1])
                cells(table, edges, out)
                if len(out) > 20_000:
                    yield done()
        if held is not None:
            cells(held, np.array([0, held.num_rows]), out)
        if out:
            yield done()

    return run


def cap_duplicates(vectors: DataFrame, how: Caps = Caps(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class and meet as one; a filter's members are dealt into blocks,
    so no filter meets in one task. Links are counted where they are found and only spanning
    forests of them travel, so rows grow with the members of filters, not with their pairs.

    Rows without a label or with a null, empty, zero or non-finite vector link with nothing; so do
    rows without an id, which are kept with a null component. Vectors of other lengths are not
    compared. Repeated rows count as vectors of their own. An empty table gives no rows; other
    columns are ignored, whatever their names. A vector of any length is one row.
    """
    own = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("mark"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label")
    ).select("id", F.when(F.col("label").isNotNull(), F.col("mark")).alias("mark"), "vector", "label")
    rows = written(own.mapInArrow(_classed, "id long, label string, digest binary, dim int, vector binary"), "vectors")
    whole = rows.where("digest is not null and id is not null")
    classes = whole.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    mine = classes.withColumnRenamed("digest", "its")
    reps = whole.join(mine, (whole.id == mine.rep) & (whole.digest == mine.its)).dropDuplicates(["id", "digest"]).select("id", "label", "dim", "vector", "size")
    most = whole.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    most = 1 << (most - 1).bit_length()  # a little more input leaves directions as they are
    schema = "id long, label string, dim int, vector binary, size long, filters array<int>"
    reps = written(reps.mapInArrow(_filtered(how, most), schema), "filters")
    cell = reps.select("id", F.xxhash64("label", "dim").alias("of"), F.explode("filters").alias("filter"))
    member = cell.select(F.xxhash64("of", "filter").alias("key"), "filter", "id")  # what shares a key by chance is told apart below
    shared = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("key", F.ceil(F.col("n") / how.block).cast("int").alias("blocks"))
    cells = (
        member.join(shared, "key")
        .withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
        .join(reps, "id")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "label", "dim", "filter")
    )
    found = written(cells.mapInArrow(_linked(how), "a long, n long, b long"), "links")
    drop(reps)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("beyond"))
    labels = components(found.where("b is not null").select("a", "b")).select(F.col("id").alias("rep"), F.col("label").alias("component"))
    known = classes.join(counts, "rep", "left").join(labels, "rep", "left").select(
        F.col("digest").alias("its"), (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(known, F.col("digest") == F.col("its"), "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
