"""Personal data: regular expressions propose spans, checksums confirm, context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds, in the order that breaks ties, then those that need more than their pattern.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: A span of an added kind is kept from this score on; base kinds start above it.
LEAST_SCORE = 0.5
#: Score by pattern and checksum alone, and characters on either side that are searched for context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.6, "ssn": 0.2}
NEAR = 48
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "social-security"),
}
AGAINST = ("example", "order no", "invoice", "version", "isbn")


def _whole(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, not inside longer ones, in any case."""
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, words))})(?![^\W_])", re.I)


_CONTEXT, _AGAINST = {kind: _whole(words) for kind, words in CONTEXT.items()}, _whole(AGAINST)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country.
_IBAN_CHARS = {
    k: int(n)
    for n, countries in (
        entry.split(":")
        for entry in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
            "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
            "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for k in countries.split(",")
}
_NOT_DIGITS = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: linear, and the same matches as scanning from the left."""
    end, at = 0, text.find("@")
    while at != -1:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches cut to their country's length where that is an IBAN, else whole; what is left of one, or follows the start of a wrong one, is searched again."""
    m = _IBAN.search(text)
    while m:
        at, end, left = m.start(), m.start(), _IBAN_CHARS.get(m[0][:2], 0)
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        whole = not left and end > at and (end == m.end() or not text[end].isalnum()) and mod97(text[at:end].replace(" ", ""))
        if not whole:
            end = m.end() if mod97(m[0].replace(" ", "")) else 0
        if end:
            yield at, end
        m = _IBAN.search(text, end or at + 1)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their pattern and checksum confirm."""
    if "@" in text:
        yield from (("email", s, e) for s, e in _emails(text))
    if "." in text:
        yield from (("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part_ok, m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15)
    yield from (("iban", *found) for found in _ibans(text))
    if "-" in text:
        yield from (("ssn", *m.span()) for m in _SSN.finditer(text))


def find_spans(text: str) -> list[Span]:
    """All confirmed spans of a whole text by start, then kind; offsets in code points, end exclusive."""
    spans = []
    for kind, s, e in _proposed(text):
        around = f"{text[max(0, s - NEAR) : s]}\n{text[e : e + NEAR]}"
        score = PRIOR[kind] + 0.4 * bool(_CONTEXT[kind].search(around)) - 0.2 * bool(_AGAINST.search(around))
        if kind in BASE or score >= LEAST_SCORE:
            spans.append(Span(s, KINDS.index(kind), e, round(min(1.0, max(0.0, score)), 2)))
    return sorted(spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        first, end = spans[k], spans[k].end
        while k < len(spans) and (spans[k].start < end or spans[k] is first):
            end = max(end, spans[k].end)
            k += 1
        out += [text[at : first.start], f"[{first.kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [find_spans(t or "") for t in part.column(1).to_pylist()]
            base = [[s for s in spans if s.kind in BASE] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([sum(s.kind == kind for s in b) for b in base], pa.int64()) for kind in BASE),
                    pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_listed(spans) for spans in found], pa.string()),
                    pa.array([max((s.score for s in spans), default=0.0) for spans in found], pa.float64()),
                    pa.array([",".join(f"{s.score:.2f}" for s in spans) for spans in found], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "top_score", "scores"],
            )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by base kind, the digest of base spans, all spans, the highest score, all scores.

    A null text is an empty one and has no spans; ids are passed through, null or repeated; an empty
    table gives no rows; other columns are ignored. Work is per row and linear in the text.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _rows,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double, scores string",
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; null texts stay null, all columns stay."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [t if t is None else mask(t, find_spans(t)) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)
