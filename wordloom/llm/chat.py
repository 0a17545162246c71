"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all preceding turns are its context, its
reply alone is trained on. A conversation is rendered once, segment by segment, and an example row
refers to its context as the prefix of that rendering that ends where its reply begins, so n turns
take n rows and not n squared; ``expanded`` writes examples out in full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = r"\\|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>"
#: What must not be taken for markup: this template's own marks, those of others, the escape itself.
_CONTROL = re.compile(_MARKS)
_ESCAPED = re.compile(rf"\\({_MARKS})")
#: A role ends at the first mark that isn't escaped; every backslash begins an escape.
_TURN = re.compile(rf"<\|turn ((?:\\(?:{_MARKS})|(?!\|>)[^\\])*+)\|>\n(.*)<\|end\|>\n", re.S)
TRAINED = "assistant"
RENDERED = "conv_id long, position long, segment string, start long, targets array<struct<example:long,loss_start:long,loss_end:long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's segment and where its escaped text begins and ends in it."""
    head, body = f"<|turn {escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    role, body = _TURN.fullmatch(segment).groups()
    return unescape(role), unescape(body)


def _streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, first: Any, step: Any, last: Any) -> Iterator[pa.RecordBatch]:
    """Runs step over the rows of each conversation in turn, holding one state and no group."""
    state, key, rows, chars = None, None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    rows += last(state, key)
                state, key = first(), row["conv_id"]
            made = step(state, row)
            rows += made
            chars += sum(len(r.get("segment", "")) for r in made)
            if len(rows) >= 1024 or chars > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, chars = [], 0
    if state is not None:
        rows += last(state, key)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


_TARGET = pa.struct([("example", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("start", pa.int64()), ("targets", pa.list_(_TARGET))])
_READ = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")])


def _render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def step(state: dict, row: dict) -> list[dict]:
        role = row["role"] or ""
        segment, a, b = render(role, row["text"] or "")
        made = {"conv_id": row["conv_id"], "position": state["n"], "segment": segment, "start": state["chars"], "targets": []}
        if role == TRAINED:
            made["targets"] = [{"example": state["examples"], "loss_start": state["chars"] + a, "loss_end": state["chars"] + b}]
            state["examples"] += 1
        state["n"] += 1
        state["chars"] += len(segment)
        return [made]

    yield from _streamed(batches, _SEGMENTS, lambda: {"n": 0, "chars": 0, "examples": 0}, step, lambda s, k: [])


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def first() -> dict:
        return {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "examples": 0, "segment": "", "start": 0}

    def step(state: dict, row: dict) -> list[dict]:
        if row["example"] is None:
            state["segment"], state["start"] = row["segment"], state["chars"]
            role, text = parse(row["segment"])
            state["turns"].update(f"{role}\n{text}\n".encode())
            state["n"] += 1
            state["chars"] += len(row["segment"])
            return []
        # an example comes after the segment that holds its reply; what is before the reply is its context
        low, high = row["loss_start"] - state["start"], row["loss_end"] - state["start"]
        if (row["context_turns"], row["context_end"]) != (state["n"] - 1, state["start"]) or not 0 <= low <= high <= len(state["segment"]):
            raise ValueError(f"example {row['example']} of conversation {row['conv_id']} does not fit its rendering")
        reply = unescape(state["segment"][low:high])
        state["loss"].update(reply.encode())
        state["loss_chars"] += len(reply)
        state["examples"] += 1
        return []

    def last(state: dict, key: int | None) -> list[dict]:
        return [{
            "conv_id": key, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_chars"],
            "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"], "n_examples": state["examples"],
        }]

    yield from _streamed(batches, _READ, first, step, last)


def formatted(turns: DataFrame) -> DataFrame:
    """Rows of a rendering: conv_id, position, segment, start, and the targets of a trained turn.

    Turns go by ``turn``, ties by role and text, nulls first; repeated rows are turns of their own. A
    null role or text is empty; rows of a null conv_id are one conversation; an empty table gives no
    rows; other columns are ignored, whatever their names. Rows stream through in order, so a
    conversation may be of any length; its own order makes it the work of one task.
    """
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_render_all, RENDERED)


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, context_turns, context_end, loss_start, loss_end.

    The context is the first ``context_turns`` segments, ``context_end`` characters of the rendering;
    of the whole example, which ends with its reply's segment, only loss_start to loss_end is trained on."""
    rows = rendered.select("conv_id", "position", "start", F.explode("targets").alias("target"))
    return rows.select("conv_id", "target.example", F.col("position").alias("context_turns"), F.col("start").alias("context_end"), "target.loss_start", "target.loss_end")


def read_back(rendered: DataFrame, of: DataFrame) -> DataFrame:
    """One row per conversation: its turns from the rendering, its loss from the example rows ``of`` it."""
    nothing = [F.lit(None).cast("long").alias(c) for c in ("example", "context_end", "loss_start", "loss_end")]
    segments = rendered.select("conv_id", F.col("position").alias("context_turns"), F.col("segment"), *nothing)
    both = segments.unionByName(of.select("*", F.lit(None).cast("string").alias("segment")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "context_turns", F.col("example").asc_nulls_first()).mapInArrow(_read_all, READ)


def expanded(rendered: DataFrame, of: DataFrame) -> DataFrame:
    """Examples ``of`` the rendering in full: conv_id, example, text, loss_start, loss_end. Grows with the square of a conversation."""
    target = of.select(F.col("conv_id").alias("whose"), "example", F.col("context_turns").alias("upto"), "loss_start", "loss_end")
    both = target.join(rendered, F.col("whose").eqNullSafe(F.col("conv_id")) & (F.col("position") <= F.col("upto")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    return both.groupBy(F.col("whose").alias("conv_id"), "example", "loss_start", "loss_end").agg(text.alias("text"))
