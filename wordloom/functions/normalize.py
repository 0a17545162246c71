"""From text to sentences to tokens, as column expressions without look-around, so that SQL engines agree."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

#: After these a full stop ends no sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "vs", "etc", "e.g", "i.e", "Jr", "Sr", "Inc", "Ltd", "Fig", "No")
ABBREVIATION = r"(^|[^\p{L}\p{N}])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.(\s)"
LINKS = (r"https?://[^\s\p{Z}]+|ftp://[^\s\p{Z}]+", r"www\.[^\s\p{Z}]+")
#: (pattern, replacement) pairs that set separable punctuation apart; \1 stands for a group.
SPLITS = (
    (r"\.\.\.", " ... "),
    (r"([;@#$%&?!\"()\[\]{}<>]|--)", r" \1 "),
    (r"([,:])([^0-9]|$)", r" \1 \2"),
    (r"('s|'m|'d|'ll|'re|'ve|n't)([^\p{L}\p{N}]|$)", r" \1\2"),
    (r"([^.])\.\s*$", r"\1 ."),
)
TOKEN = r"^[\p{L}\p{N}]+$"
#: What splitting at white space and then asking for TOKEN finds, in one pass: ``$`` also matches before one line end that is no white space to Java.
_FOUND = r"(?<!\S)[\p{L}\p{N}]++[\u0085\u2028\u2029]?+(?!\S)"
#: A text that holds none of these has no match of the pattern; to look for them is far cheaper.
_NEEDED = {LINKS[0]: ("://",), LINKS[1]: ("www.",), SPLITS[0][0]: ("...",), SPLITS[2][0]: (",", ":"), SPLITS[3][0]: ("'",), SPLITS[4][0]: (".",)}


def _java(replacement: str) -> str:
    return replacement.replace("\\1", "$1").replace("\\2", "$2")


def sentence_texts(text: Column) -> Column:
    """Sentences of a text, verbatim: split after . ! ? and white space, but not after an abbreviation."""
    held = F.regexp_replace(F.coalesce(text, F.lit("")), ABBREVIATION, "$1$2.\u0002$3")
    cut = F.split(F.regexp_replace(held, r"([.!?]+)\s+", "$1\u0001"), "\u0001")
    return F.transform(cut, lambda s: F.replace(s, F.lit("\u0002"), F.lit("")))


def _replaced(text: Column, pattern: str, replacement: str) -> Column:
    needed = _NEEDED.get(pattern)
    if not needed:
        return F.regexp_replace(text, pattern, replacement)
    # the array has the text made once, not once for each use
    made = F.transform(F.array(text), lambda t: F.when(reduce(or_, (F.contains(t, F.lit(x)) for x in needed)), F.regexp_replace(t, pattern, replacement)).otherwise(t))
    return F.get(made, F.lit(0))


def without_links(text: Column) -> Column:
    for pattern in LINKS:
        text = _replaced(text, pattern, "")
    return text


def tokens(sentence: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of a sentence that are letters and digits throughout and no stop words, in order."""
    text = without_links(F.lower(sentence))
    for pattern, replacement in SPLITS:
        text = _replaced(text, pattern, _java(replacement))
    drop = STOP_WORDS if stop_words is None else stop_words
    found = F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*drop)) if drop else found
