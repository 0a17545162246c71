"""What the edges show: pages of sentences and highlighted offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import texts_of


def page(ids: DataFrame, offset: int, limit: int) -> DataFrame:
    """(sid) in order, a slice of it."""
    return ids.select("sid").orderBy("sid").offset(offset).limit(limit)


def shown(found: DataFrame, ids: DataFrame, words: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """(sid, original_text, highlights, total): a page of the sentences ``ids``, its hits, and how many ids there are."""
    total = ids.select("sid").distinct().agg(F.count("*")).scalar()
    rows = highlights(texts_of(found, page(ids.select("sid").distinct(), offset, limit)), words)
    return rows.withColumn("total", total).orderBy("sid")


def offsets(text: Column, word: str) -> Column:
    """All 0-based offsets, overlapping ones too, of a word in the lower-cased text; substrings count."""
    low = F.lower(text)
    places = F.sequence(F.lit(0), F.greatest(F.length(low) - len(word), F.lit(0)))
    return F.filter(places, lambda i: F.substring(low, i + 1, F.lit(len(word))) == word.lower())


def highlights(rows: DataFrame, words: list[str]) -> DataFrame:
    """``rows`` with highlights: map of word -> offsets; words without a hit are left out."""
    entries = F.array(*(F.struct(F.lit(w.lower()).alias("k"), offsets(F.col("original_text"), w.lower()).alias("v")) for w in dict.fromkeys(words)))
    return rows.withColumn("highlights", F.map_filter(F.map_from_entries(entries), lambda k, v: F.size(v) > 0))
