"""Trains the block labeller on invented pages whose main text is known. Run as a module to write the weights.

The pages vary skeleton, tag and class names, order, languages and noise; nothing is read from any
table. ``PAGES``, ``EPOCHS`` and ``SEED`` are all that the result depends on.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from . import blocks as B

PAGES, EPOCHS, SEED, BATCH, RATE = 6000, 5, 5, 32, 4e-3
#: Share of pages whose main text has no element of its own.
BARE = 0.2
#: Share of pages that are nothing but their main text.
PLAIN = 0.08
SYLLABLES = (
    "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ment tion eau eux oi ai ou".split(),
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden ung heit keit".split(),
    "el la de que y en un ser se no haber por con su para como estar tener le lo ción dad mente ñ ó ía os as".split(),
)
CHROME = {
    "nav": ["<nav>", '<nav class="main-nav">', '<div class="nav">', '<div id="navigation">', '<ul class="menu">', '<div class="breadcrumbs">', '<nav role="navigation">', '<div class="navbar">', '<div class="toc">', '<div class="pagination">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">', '<div id="header">', '<div class="topbar">', '<div role="banner">', '<div class="logo">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<div class="bottom">'],
    "aside": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<div class="widget">', '<div class="related-posts">', '<div role="complementary">', '<section class="recommended">', '<div class="tags">', '<div class="share">', '<div class="social">', '<div class="author-bio">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="ad-top">', '<div class="sponsored">', '<ins class="adsbygoogle">', '<div class="banner-ad">', '<div class="promo">', '<aside class="ad">', '<section class="ad">', '<p class="ad">'],
    "notice": ['<div class="cookie">', '<div id="cookie-banner">', '<div class="cookie-notice">', '<div class="notice">', '<div role="alert">', '<div role="dialog">', '<div class="consent">', '<div class="gdpr">', '<div class="popup">', '<div class="modal">', '<section class="notice">', '<div class="alert">'],
    "form": ["<form>", '<form class="newsletter">', '<form id="search">', '<div class="newsletter">', '<div class="subscribe">', '<div class="search">', '<div class="login">', '<form action="/s">'],
    "comments": ['<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus_thread">', '<section class="comments">', '<div class="comment-list">', '<div class="replies">', '<div class="reader-comments">', '<ul class="comments">'],
}
MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="article-body">', '<div id="main">', '<article class="post">', '<div role="main">', '<div class="story">', '<div class="article">', '<div class="text">', '<div itemprop="articleBody">', "<div>"]
WRAP = ["", "", "", "<div>", '<div class="wrapper">', '<div id="page">', '<div class="container">', '<div class="row">']
SHORT = ["Home", "About", "Contact", "Log in", "Sign up", "Privacy", "Terms", "Share", "Reply", "Next", "Search", "© 2024", "Subscribe", "Read more", "Accept", "All rights reserved.", "We use cookies.", "Advertisement"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def body(self) -> str:
        """Text of a main block: of any length, sometimes repetitive, sometimes a phrase that chrome has too."""
        r, kind = self.r, self.r.random()
        if kind < 0.06:
            return r.choice(SHORT)
        if kind < 0.12:
            return " ".join([self.words(r.randint(1, 6))] * r.randint(2, 40))
        return self.words(r.choice((1, 2, 5, 12, 30, 60, 90, 250)))

    def words(self, n: int) -> str:
        r, syllables = self.r, SYLLABLES[self.language]
        made = ["".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3)))) + (r.choice(self.noise) if self.noise else "") for _ in range(n)]
        text = " ".join(w + ("," if r.random() < 0.05 else "") for w in made).capitalize()
        return text + r.choice((".", ".", ".", "", "!", "?"))

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(10**6)}">{text}</a>'

    def label(self) -> str:
        return self.r.choice(SHORT) if self.r.random() < 0.5 else self.words(self.r.randint(1, 4))

    def close(self, opened: str) -> str:
        return f"</{opened[1:-1].split()[0]}>" if opened else ""

    def chrome(self, kind: str) -> list[tuple[str, bool | None]]:
        r, opened = self.r, self.r.choice(CHROME[kind])
        out: list[tuple[str, bool | None]] = [(opened, None)]
        tag = opened[1:-1].split()[0]
        if opened.startswith("<p"):
            return [(f"{opened}{self.words(r.randint(2, 20))}</p>", False)]
        if kind in ("nav", "header", "footer", "aside") and r.random() < 0.65:
            if tag not in ("ul", "ol"):
                out.append(("<ul>", None))
            for _ in range(r.randint(2, 8)):
                out.append((f"<li>{self.link(self.label())}</li>", False))
            if tag not in ("ul", "ol"):
                out.append(("</ul>", None))
        elif kind == "comments":
            item = "<li>" if tag in ("ul", "ol") else r.choice(('<div class="comment">', "<div>", "<p>", '<article class="comment">'))
            for _ in range(r.randint(1, 6)):
                text = self.words(r.randint(3, 40)) if r.random() < 0.8 else self.body()
                out.append((f"{item}{text}{self.close(item)}" if r.random() < 0.5 or item == "<p>" else f"{item}<p>{text}</p>{self.close(item)}", False))
        elif kind == "form":
            out.append((f"<label>{self.label()}</label><input name=q>" + (f"<p>{self.words(r.randint(2, 12))}</p>" if r.random() < 0.5 else ""), False))
        else:
            for _ in range(r.choice((1, 1, 1, 2, 3))):
                text = self.words(r.randint(2, 45))
                out.append((text if r.random() < 0.5 else r.choice(("<p>{}</p>", "<span>{}</span>", "<h3>{}</h3>", "<div>{}</div>")).format(text), False))
        return [*out, (self.close(opened), None)]

    def main(self) -> list[tuple[str, bool | None]]:
        r = self.r
        opened = [o for o in (r.choice(WRAP), r.choice(MAIN)) if o]
        if r.random() < 0.25:
            opened.append(r.choice(MAIN))
        if r.random() < BARE:
            opened = []  # the text lies in the body, as its menus do
        out: list[tuple[str, bool | None]] = [(o, None) for o in opened]
        title = self.words(r.randint(2, 12))
        if r.random() < 0.85:
            out.append((f"<h1>{title}</h1>", True))
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 21))):
            kind, text = r.random(), self.body()
            if r.random() < 0.15:
                text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
            if r.random() < 0.1:
                text += " " + self.link(self.words(3))
            if kind < 0.72:
                out.append((f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""), True))
            elif kind < 0.78:
                out.append((f"<h2>{self.words(r.randint(1, 6))}</h2>", True))
            elif kind < 0.84:
                out += [("<ul>", None), *((f"<li>{self.words(r.randint(1, 15))}</li>", True) for _ in range(r.randint(1, 5))), ("</ul>", None)]
            elif kind < 0.88:
                out.append((f"<blockquote>{text}</blockquote>", True))
            elif kind < 0.91:
                out.append((f"<pre>{text}</pre>", True))
            elif kind < 0.94:
                out += [("<table><tr>", None), *((f"<td>{self.words(r.randint(1, 4))}</td>", True) for _ in range(r.randint(1, 4))), ("</tr></table>", None)]
            elif kind < 0.97:
                out.append((f"<div>{text}</div>", True))
            else:
                out += self.chrome(r.choice(("ad", "aside", "form", "notice")))
        return [*out, *((self.close(o), None) for o in reversed(opened))]

    def page(self) -> list[tuple[str, bool | None]]:
        r = self.r
        self.language = r.randrange(4)
        self.noise = ["***", "###", "%%%", "$$$", "&amp;&amp;"] if r.random() < 0.08 else []
        before = [k for k in ("header", "nav", "ad", "notice", "form", "aside") if r.random() < (0.75 if k == "nav" else 0.4)]
        after = [k for k in ("comments", "aside", "ad", "form", "notice", "nav", "footer") if r.random() < (0.8 if k == "footer" else 0.3)]
        if r.random() < PLAIN:
            before, after = [], []
        r.shuffle(before)
        if r.random() < 0.4:
            r.shuffle(after)
        wrap = r.choice(WRAP)
        out: list[tuple[str, bool | None]] = [(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>{wrap}', None)]
        for k in before:
            out += self.chrome(k)
        if r.random() < 0.97:
            out += self.main()
        for k in after:
            out += self.chrome(k)
        return [*out, (f"{self.close(wrap)}</body></html>", None)]


def example(maker: Maker) -> tuple[list[B.Block], np.ndarray]:
    """Blocks of an invented page and whether each is main text; told apart by a mark put into the text."""
    parts = maker.page()
    marked = "".join(p if kind is None else p.replace(">", ">\x02" if kind else ">\x03") if "<" in p else ("\x02" if kind else "\x03") + p for p, kind in parts)
    found = B.blocks(marked)
    labels = np.array(["\x02" in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace("\x02", "").replace("\x03", "").strip() or "-"
    return found, labels


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    dim, h = B.PATH_DIM + B.WORD_DIM + B.MEASURES, B.HIDDEN
    w = {"path": rng.normal(0, 0.1, (B.PATH_SLOTS, B.PATH_DIM)), "word": rng.normal(0, 0.1, (B.WORD_SLOTS, B.WORD_DIM)), "wo": rng.normal(0, 0.1, 2 * h), "bo": np.zeros(1)}
    for d in "fb":
        w |= {f"w{d}": rng.normal(0, dim**-0.5, (dim, 4 * h)), f"u{d}": rng.normal(0, h**-0.5, (h, 4 * h)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _back(u: np.ndarray, w: np.ndarray, x: np.ndarray, kept: list, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = u.shape[0]
    dz = np.zeros((*x.shape[:2], 4 * size), np.float32)
    dh, dc, du = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0]), np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, s, (h0, c0) = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - s * s)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += h0.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0), (flat @ w.T).reshape(x.shape)


def step(w: dict[str, np.ndarray], batch: list[tuple[list[B.Block], np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over blocks and its gradients."""
    n = [len(p) for p, _ in batch]
    top, dim = max(n), B.PATH_DIM + B.WORD_DIM + B.MEASURES
    x, y, mask = np.zeros((top, len(batch), dim), np.float32), np.zeros((top, len(batch)), np.float32), np.zeros((top, len(batch)), np.float32)
    turn = np.zeros((top, len(batch)), np.int64)
    for j, (p, labels) in enumerate(batch):
        x[: n[j], j], y[: n[j], j], mask[: n[j], j] = B.inputs(w, p), labels, 1
        turn[:, j] = [*range(n[j] - 1, -1, -1), *range(n[j], top)]
    flip = lambda v: np.take_along_axis(v, turn[:, :, None], axis=0)
    kf: list = []
    kb: list = []
    hf = B.run_lstm(w["wf"], w["uf"], w["bf"], x, kf)
    hb = B.run_lstm(w["wb"], w["ub"], w["bb"], flip(x), kb)
    h = np.concatenate([hf, flip(hb)], axis=2)
    z = h @ w["wo"] + w["bo"]
    p = B._sigmoid(z)
    loss = float((mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum())
    dz = (mask * (p - y) / mask.sum()).astype(np.float32)
    grads = {"wo": np.einsum("tb,tbh->h", dz, h), "bo": dz.sum(keepdims=True).reshape(1)}
    dh = dz[:, :, None] * w["wo"]
    grads["wf"], grads["uf"], grads["bf"], dx = _back(w["uf"], w["wf"], x, kf, dh[:, :, : B.HIDDEN])
    grads["wb"], grads["ub"], grads["bb"], dback = _back(w["ub"], w["wb"], flip(x), kb, flip(dh[:, :, B.HIDDEN :]))
    dx = dx + flip(dback)
    grads["path"], grads["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
    for j, (page, _) in enumerate(batch):
        paths, path_n, words, word_n, _ = B.encoded(page)
        np.add.at(grads["path"], paths, np.repeat(dx[: n[j], j, : B.PATH_DIM], path_n, axis=0))
        share = dx[: n[j], j, B.PATH_DIM : B.PATH_DIM + B.WORD_DIM] / np.maximum(word_n, 1)[:, None]
        np.add.at(grads["word"], words, np.repeat(share, word_n, axis=0))
    return loss, grads


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    maker, w = Maker(seed), fresh(seed)
    data = [e for e in (example(maker) for _ in range(pages)) if e[0]]
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order, t = random.Random(seed), 0
    for epoch in range(epochs):
        order.shuffle(data)
        groups = [sorted(data[k : k + 8 * BATCH], key=lambda e: len(e[0])) for k in range(0, len(data), 8 * BATCH)]
        batches = [g[k : k + BATCH] for g in groups for k in range(0, len(g), BATCH)]
        order.shuffle(batches)
        total = 0.0
        for batch in batches:
            t += 1
            loss, grads = step(w, batch)
            total += loss
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * (1 - t / (epochs * len(batches) + 1))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / len(batches):.4f}", flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], pages: int = 500, seed: int = SEED + 1) -> float:
    """Share of right labels on pages that training never saw."""
    maker = Maker(seed)
    data = [e for e in (example(maker) for _ in range(pages)) if e[0]]
    found = B.scores(w, [p for p, _ in data])
    return float(np.concatenate([(s > 0) == (y > 0.5) for s, (_, y) in zip(found, data, strict=True)]).mean())


if __name__ == "__main__":
    weights = train()
    print(f"held-out accuracy {accuracy(weights):.4f}")
    np.savez_compressed(Path(__file__).parent / "labeller.npz", **{k: x.astype(np.float16) for k, x in weights.items()})
