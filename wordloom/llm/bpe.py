"""Byte-level BPE as a monoid: texts are encoded by halves and joined at re-encoded boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, and ids of a leaf when decoding.
LEAF = 1024
#: Characters first searched on either side of a boundary; doubled until a stable point is found.
WINDOW = 64
#: Between a character that is no white space and one that is, every match of the pattern ends: none
#: of its alternatives has white space after another character. Tokens on the far side of such a
#: point are the same in the half and in the whole, whatever follows or precedes. Python's \s must
#: not see more white space than the pattern's, so only characters that both take count here.
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


class Codec:
    """Encodes and decodes whole texts; ``join`` is associative, with the empty text as its unit."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF) -> None:
        self.encoding, self.lengths = _encoding(path, pattern)
        self.leaf = leaf

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.uint32)

    def _tail(self, ids: np.ndarray, n: int, reverse: bool) -> int:
        """How many ids at one end make n bytes."""
        width = 64
        while True:
            part = ids[-width:][::-1] if reverse else ids[:width]
            ends = np.cumsum(self.lengths[part])
            if not n or ends[-1] >= n:
                return int(np.searchsorted(ends, n)) + 1 if n else 0
            width *= 4

    def join(self, text: str, low: int, mid: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[low:high] from those of text[low:mid] and text[mid:high]."""
        if low == mid or mid == high:
            return right if low == mid else left
        width = WINDOW
        while True:
            a, b = max(low, mid - width), min(high, mid + width)
            begins = [m.start() for m in _STABLE.finditer(text, a, mid) if m.start() > low]
            ends = _STABLE.search(text, mid + 1, b)
            ends = ends if ends is None or mid < ends.start() < b else None
            if (begins or a == low) and (ends or b == high):
                break
            width *= 2
        a = begins[-1] if begins else low
        b = ends.start() if ends else high
        cut = len(left) - self._tail(left, len(text[a:mid].encode()), True)
        skip = self._tail(right, len(text[mid:b].encode()), False)
        return np.concatenate([left[:cut], self._ids(text[a:b]), right[skip:]])

    def encode(self, text: str, low: int = 0, high: int | None = None) -> np.ndarray:
        high = len(text) if high is None else min(high, len(text))
        if high - low <= self.leaf:
            return self._ids(text[low:high] if high - low < len(text) else text)
        mid = (low + high) // 2
        return self.join(text, low, mid, high, self.encode(text, low, mid), self.encode(text, mid, high))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    Ids equal those of the library over the whole text. A null text is empty; ids of documents pass
    through, null or repeated; an empty table gives no rows; other columns are ignored. The rank file
    is opened where the work is done, by the path given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                raw = [x.astype("<u4").tobytes() for x in ids]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
