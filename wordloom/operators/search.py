"""Keyword narrowing and context."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import distinct_postings, lowered


@dataclass(frozen=True)
class SearchState:
    """Words so far; nothing is shared between states and nothing is evaluated yet."""

    words: tuple[str, ...] = field(default=())

    def narrowed(self, word: str) -> SearchState:
        """A repeated word changes nothing."""
        return self if word in self.words else SearchState((*self.words, word))


def having(found: DataFrame, words: list[str] | tuple[str, ...]) -> DataFrame:
    """Sentences that have all words as tokens, letter for letter; all sentences for no words."""
    tests = [F.array_contains("tokens", w) for w in words]
    return found.where(reduce(lambda a, b: a & b, tests)) if tests else found


def containing(found: DataFrame, words: list[str] | tuple[str, ...]) -> DataFrame:
    """The same in any case, words stripped: a scan with a filter, no shuffle."""
    tests = [F.array_contains(lowered(), w.lower().strip()) for w in words]
    return found.where(reduce(lambda a, b: a & b, tests)) if tests else found


def matches(found: DataFrame, state: SearchState) -> DataFrame:
    """(sid) of the sentences of a state; none before the first word."""
    return having(found, state.words).select("sid") if state.words else found.where("false").select("sid")


def related(found: DataFrame, state: SearchState) -> DataFrame:
    """(word, df) within the state's sentences, searched words included."""
    inside = having(found, state.words) if state.words else found.where("false")
    return distinct_postings(inside).groupBy("word").agg(F.count("*").alias("df"))


def context_words(found: DataFrame, seed: str) -> DataFrame:
    """Distinct words that share a sentence with the seed."""
    inside = distinct_postings(containing(found, [seed]), lower=True)
    return inside.where(F.col("word") != seed.lower().strip()).select("word").distinct()
