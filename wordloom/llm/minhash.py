"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketch import band_shape, bands, sketch
from .stage import drop, joined, written
from .wordsets import digest, sets


@dataclass(frozen=True)
class NearDuplicates:
    """What counts as near, and how it is searched.

    ``percent``: least similarity in whole percent, compared in integers. ``rows`` coordinates make
    a band; there are so many bands that a pair at the threshold shares none with probability
    ``miss``. Mates in unsettled buckets are verified where second sketches, of ``fine`` times as many
    coordinates, agree within ``slack`` standard errors of the threshold; with a ``slack`` of None
    all of them are verified. ``block``: bucket members compared with as many others at a time.
    ``parts``: stretches that the rows of one class are dealt into.
    """

    shingle_words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    slack: float | None = 4.5
    fine: int = 4
    block: int = 256
    parts: int = 256

    @property
    def size(self) -> int:
        """Coordinates of a sketch."""
        return self.rows * band_shape(self.percent / 100, self.rows, self.miss)

    def least_agreement(self, size: int) -> float:
        """Share of equal coordinate bytes, of ``size``, below which a pair isn't verified."""
        if self.slack is None:
            return 0.0
        p = self.percent / 100
        low = p - self.slack * (p * (1 - p) / size) ** 0.5
        return low + (1 - low) / 256


def _sketcher(how: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}  # copies follow one another often
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ns, digests, keys = [], [], []
                for values in sets(part.column(1), how.shingle_words):
                    ns.append(len(values))
                    d = digest(values) if len(values) else None
                    digests.append(d)
                    if d is None:
                        keys.append([])
                        continue
                    if d not in seen:
                        if len(seen) > 5_000:
                            seen.clear()
                        seen[d] = bands(sketch(values, how.size), how.rows)
                    keys.append(seen[d])
                flat = np.concatenate([np.asarray(k, dtype=np.int64) for k in keys]) if keys else np.zeros(0, np.int64)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(ns, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["id", "n", "digest", "keys"],
                )

    return run


def _hashed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [v.astype("<u8").tobytes() for v in sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["id", "set"])

    return run


def _second(size: int):
    """Low bytes of an independent sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [(sketch(np.frombuffer(v.as_buffer(), "<u8"), size, seed=2) & np.uint64(255)).astype(np.uint8).tobytes() for v in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(low, pa.binary())], names=["id", "bytes"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(one[k].as_buffer(), "<u8"), np.frombuffer(two[k].as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, shingle_sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    one = shingle_sets.select(F.col("id").alias("a"), F.col("set").alias("one"))
    two = shingle_sets.select(F.col("id").alias("b"), F.col("set").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_similar(percent), "a long, b long").distinct()


def _mates(how: NearDuplicates):
    """Pairs of a cell's two blocks that have different labels and agree in enough sketch bytes.

    A pair may be mates in several buckets; only that of its first shared band reports it."""
    size, coarse = how.size * how.fine, how.size
    least, least_coarse = how.least_agreement(size), how.least_agreement(coarse)

    def cell(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        block, i, j, key = rows.column("block").to_numpy(), *(rows.column(c)[0].as_py() for c in ("i", "j", "key"))
        found: list[np.ndarray] = []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(left) and len(right) and labels.min() < labels.max():
            bytes_ = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, size)
            keys = np.array(rows.column("keys").to_pylist(), np.int64)
            other = np.ascontiguousarray(bytes_[right, :coarse])
            for k in left:
                near = right[(other == bytes_[k, :coarse]).mean(axis=1) >= least_coarse]
                near = near[(labels[near] != labels[k]) & ((i != j) | (ids[near] > ids[k]))]
                near = near[(bytes_[near] == bytes_[k]).mean(axis=1) >= least] if len(near) else near
                if len(near):
                    shared = keys[near] == keys[k]
                    near = near[shared.any(axis=1) & (keys[k][shared.argmax(axis=1)] == key)]
                    found.append(np.stack([np.minimum(ids[near], ids[k]), np.maximum(ids[near], ids[k])]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the cell that may go on in the next batch

        def out(table: pa.Table) -> pa.RecordBatch:
            a, b = cell(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(s, e - s)
                if held and any(held[-1].column(c)[-1].as_py() != part.column(c)[0].as_py() for c in ("key", "i", "j")):
                    yield out(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, found by a digest and represented by the least
    id; only classes are sketched against each other, so copies never meet as pairs. Every bucket's
    members are verified against its least member first; after components, only bucket mates that
    are still in different ones are compared, in blocks, by finer sketches and then on full sets. A bucket
    of any size is thus spread over many tasks, and nothing is capped.

    The rows of a class meet its component in ``parts`` stretches, so copies of one text, however
    many, are not one task either. A text of any length is one row, worked on as a whole.

    A null or wordless text has no shingles, links with nothing and keeps its own id. A null id
    comes back with a null component and is kept. Rows that repeat an id and text are one document;
    an id with two texts is compared by both. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = written(
        own.mapInArrow(_sketcher(how), "id long, n long, digest binary, keys array<long>"), "sketches"
    )
    whole = sketched.where("n > 0 and id is not null")
    classes = whole.groupBy("digest").agg(F.min("id").alias("rep"))
    of_class = classes.withColumnRenamed("digest", "its")
    reps = whole.join(of_class, (whole.id == of_class.rep) & (whole.digest == of_class.its))
    in_bucket = reps.select("id", F.explode("keys").alias("key"))
    heads = in_bucket.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    heads = written(heads, "heads")
    members = written(joined(in_bucket, heads, "key", "inner").select("key", "head", "id").distinct(), "members")

    stars = written(members.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = written(members.select("id").distinct(), "wanted")
    texts = joined(own, wanted, "id").select("id", "text")
    shingle_sets = written(texts.mapInArrow(_hashed(how.shingle_words), "id long, set binary"), "sets")
    links = written(verified(stars, shingle_sets, how.percent), "links")
    labels = components(links)

    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_ = named.join(split.select("key", F.ceil(F.col("n") / how.block).cast("int").alias("blocks")), "key")
    unsettled = shingle_sets.join(open_.select("id").distinct(), "id", "left_semi")
    second = unsettled.mapInArrow(_second(how.size * how.fine), "id long, bytes binary").join(reps.select("id", "keys"), "id")
    seconds = written(second, "second")
    cells = (
        open_.join(seconds, "id")
        .withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "bytes", "keys")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    mates = cells.mapInArrow(_mates(how), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    found = written(mates, "mates")
    late = written(verified(found, shingle_sets, how.percent), "links")
    if not late.isEmpty():
        labels = components(links.unionByName(late))

    drop(heads, wanted, members, stars, shingle_sets, links, seconds, found, late)
    part = F.pmod(F.xxhash64("id"), F.lit(how.parts)).alias("part")
    found = classes.join(labels, classes.rep == labels.id, "left").select("digest", F.coalesce("label", "rep").alias("component"))
    slots = whole.select("digest", part).distinct().join(found, "digest")
    slots = slots.select(F.col("digest").alias("its"), F.col("part").alias("its_part"), "component")
    linked = whole.select("id", "n", "digest", part)
    linked = linked.join(slots, (F.col("digest") == F.col("its")) & (F.col("part") == F.col("its_part")), "left").select("id", "n", "component")
    alone = sketched.where("n = 0 or id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
