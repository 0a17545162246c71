"""Leaf text blocks of an HTML page with their tag paths, and a recurrent labeller for them.

The labeller is a bidirectional LSTM in numpy. A block enters as the sum of learned vectors of its
hashed path tokens (block-level tags and the words of their class, id and role), the mean of
those of its hashed words, and a few measures; both directions run over all blocks of the page,
so each label depends on the whole document. Weights come from ``training``.
"""

from __future__ import annotations

import html
import io
import pkgutil
import re
import zlib
from functools import lru_cache

import numpy as np

PATH_SLOTS, WORD_SLOTS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 512, 24, 12, 7, 24
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp"
    " small source span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text.
RAW = frozenset("script style noscript template textarea title svg iframe object select button math canvas audio video".split())
#: A start tag of the key ends an open element of these, within the nearest of the last.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_KEEPS_P = INLINE | RAW | {"body", "html"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Slots of a start tag's path tokens."""
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(zlib.crc32(x.encode()) % PATH_SLOTS for x in (f"<{tag}", *words))


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_SLOTS


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[int, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: white space is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    held: list[str] = []
    state = {"linked": 0, "anchor": False}

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(tuple(m for _, marks in stack for m in marks), text, state["linked"]))
            held.clear()
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if state["anchor"]:
                state["linked"] += len(text)

    at = 0
    find = _TAG.search
    while (m := find(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                held.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                state["anchor"] = not m[1]
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        state["anchor"] = False
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag not in _KEEPS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in _IMPLIED:
            ends, within = _IMPLIED[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        stack.append((tag, _marks(tag, m[3])))
    add(page[at:])
    flush()
    return out


def encoded(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path slots and their counts, word slots and their counts, measures."""
    paths, path_n, words, word_n, measures = [], [], [], [], []
    for k, b in enumerate(page):
        paths.extend(b.path)
        path_n.append(len(b.path))
        found = b.text.lower().split()
        words.extend([_slot(w) for w in found])
        word_n.append(len(found))
        n = len(b.text)
        measures.append((
            min(1.2, np.log1p(n) / 5), min(1.2, np.log1p(len(found)) / 4), min(1.0, b.linked / n), min(0.5, sum(map(b.text.count, ".!?,;:")) / n * 10),
            k / len(page), 1.0 / (1 + k), float(b.text[-1] in ".!?"),
        ))
    return np.array(paths, np.int64), np.array(path_n, np.int64), np.array(words, np.int64), np.array(word_n, np.int64), np.array(measures, np.float32).reshape(-1, MEASURES)


def _pooled(table: np.ndarray, slots: np.ndarray, counts: np.ndarray, mean: bool) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        out[some] = np.add.reduceat(table[slots], begins, axis=0)
        if mean:
            out[some] /= counts[some, None]
    return out


def inputs(weights: dict[str, np.ndarray], page: list[Block]) -> np.ndarray:
    paths, path_n, words, word_n, measures = encoded(page)
    return np.concatenate([_pooled(weights["path"], paths, path_n, False), _pooled(weights["word"], words, word_n, True), measures], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run_lstm(w: np.ndarray, u: np.ndarray, b: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states over time, x being (time, batch, dim); ``keep`` collects what training needs."""
    time, batch, _ = x.shape
    size = u.shape[0]
    h = np.zeros((batch, size), np.float32)
    c = np.zeros((batch, size), np.float32)
    out = np.zeros((time, batch, size), np.float32)
    given = x.reshape(-1, x.shape[2]) @ w + b
    given = given.reshape(time, batch, -1)
    for t in range(time):
        z = given[t] + h @ u
        i, f, o, g = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        before = (h, c)
        c = f * c + i * g
        s = np.tanh(c)
        h = o * s
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, g, s, before))
    return out


def scores(weights: dict[str, np.ndarray], pages: list[list[Block]], cells: int = 60_000) -> list[np.ndarray]:
    """A logit for every block of every page; pages of like length run side by side."""
    result: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        take = max(1, cells // longest)
        group, order = order[-take:], order[:-take]
        lengths = [len(pages[k]) for k in group]
        x = np.zeros((longest, len(group), PATH_DIM + WORD_DIM + MEASURES), np.float32)
        back = np.zeros_like(x)
        for j, k in enumerate(group):
            v = inputs(weights, pages[k])
            x[: lengths[j], j], back[: lengths[j], j] = v, v[::-1]
        ahead = run_lstm(weights["wf"], weights["uf"], weights["bf"], x)
        behind = run_lstm(weights["wb"], weights["ub"], weights["bb"], back)
        for j, k in enumerate(group):
            n = lengths[j]
            both = np.concatenate([ahead[:n, j], behind[:n, j][::-1]], axis=1)
            result[k] = both @ weights["wo"] + weights["bo"]
    return result


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    packed = np.load(io.BytesIO(pkgutil.get_data(__package__, "labeller.npz")))
    return {k: packed[k].astype(np.float32) for k in packed.files}


def main_texts(pages: list[str]) -> list[str]:
    """Main text of each page: blocks labelled so, in page order, joined by two line feeds."""
    parsed = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, s in zip(page, marks, strict=True) if s > 0) for page, marks in zip(parsed, scores(trained(), parsed), strict=True)]
