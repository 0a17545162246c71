"""TF-IDF, from the terms of each sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import idf
from .corpus import size, terms

MIN_DF = 2
MIN_LENGTH = 2


def fitted(found: DataFrame, min_df: int = MIN_DF, min_length: int = MIN_LENGTH, known: DataFrame | None = None) -> DataFrame:
    """(sid, terms) with terms an array of (word, tf, place, df, raw), raw = tf * idf, N and df taken from ``found``.

    ``known``: the terms of ``found``, if they are kept. Without a term left a sentence is left out."""
    rows = (terms(found) if known is None else known).withColumn("n", size(found).scalar())
    rows = rows.select("sid", "n", F.filter("terms", lambda t: (F.length(t["word"]) >= min_length) & (t["df"] >= min_df)).alias("terms"))
    raw = lambda t: t.withField("raw", t["tf"] * idf(t["df"], F.col("n")))
    return rows.where(F.size("terms") > 0).select("sid", F.transform("terms", raw).alias("terms"))


def normed(rows: DataFrame) -> DataFrame:
    """Adds norm, the length of a sentence's raw weights, to fitted rows."""
    squares = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["raw"] * t["raw"])
    return rows.withColumn("norm", F.sqrt(squares))


def weights(found: DataFrame, min_df: int = MIN_DF, known: DataFrame | None = None) -> DataFrame:
    """(sid, word, df, weight), each sentence's weights of unit length; no shuffle where terms are known."""
    rows = normed(fitted(found, min_df, known=known)).select("sid", "norm", F.explode("terms").alias("t"))
    return rows.select("sid", "t.word", "t.df", (F.col("t.raw") / F.col("norm")).alias("weight"))


def word_means(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(word, mean_tfidf) over the sentences that have the word."""
    return weights(found, known=known).groupBy("word").agg(F.avg("weight").alias("mean_tfidf"))


def means_of(found: DataFrame, words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``words`` with mean_tfidf, 0 for unknown ones."""
    return words.join(word_means(found, known), "word", "left").withColumn("mean_tfidf", F.coalesce("mean_tfidf", F.lit(0.0)))


def cell(found: DataFrame, sid: int, word: str, known: DataFrame | None = None) -> DataFrame:
    """One row: the weight of a word in a sentence, 0 if either is unknown."""
    hit = weights(found, known=known).where((F.col("sid") == sid) & (F.col("word") == word))
    return hit.agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))
