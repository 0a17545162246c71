"""Word classes of words on their own: a closed-class lexicon, then suffixes, else a noun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of nouns, verbs and adjectives.
USEFUL = ("NN", "NNS", "NNP", "NNPS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "JJ", "JJR", "JJS")
#: Words of closed classes by tag.
CLOSED = {
    "CC": "and but or nor yet plus minus",
    "CD": "one two three four five six seven eight nine ten hundred thousand million",
    "DT": "a an the this that these those each every some any no another both all either neither",
    "IN": "of in on at by for with about against between into through during before after above below from over under if because as until while since than upon within without toward towards per via though although whether unless",
    "MD": "can could may might must shall should will would ought",
    "PRP": "i me we us you he him she her it they them myself yourself himself herself itself ourselves themselves one",
    "PRP$": "my our your his its their mine yours ours theirs hers",
    "RB": "not never always often very too also just only even still again now then here there soon already perhaps maybe quite rather almost ever well",
    "TO": "to",
    "UH": "oh ah hey hello yes yeah wow please",
    "WDT": "which whatever whichever",
    "WP": "who whom what whoever",
    "WRB": "how when where why whenever wherever",
}
#: (ending, tag), the first that fits; shorter words than the ending plus two letters are not matched.
ENDINGS = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBN"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("est", "JJS"), ("ss", "NN"), ("s", "NNS"))


def tag(word: Column) -> Column:
    out = None
    for name, words in CLOSED.items():
        test = F.lower(word).isin(*words.split())
        out = F.when(test, name) if out is None else out.when(test, name)
    out = out.when(word.rlike("^[0-9]+$"), "CD")
    for ending, name in ENDINGS:
        out = out.when(F.lower(word).endswith(ending) & (F.length(word) >= len(ending) + 2), name)
    return out.otherwise("NN")


def useful(word: Column) -> Column:
    """Nouns, verbs and adjectives."""
    return tag(word).isin(*USEFUL)


def useful_words(words: Column) -> Column:
    """Those of an array of words, in order, each taken on its own."""
    return F.filter(words, useful)
