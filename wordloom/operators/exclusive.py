"""Exclusive clusters: every sentence goes to the one word that scores highest in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .tfidf import fitted, normed

Score = Callable[[Column], Column]


def _weighted(term: Column) -> Column:
    return term["raw"] * F.log1p(term["df"])


def _raw(term: Column) -> Column:
    return term["raw"]


def _best(rows: DataFrame, score: Score) -> DataFrame:
    """(sid, word) of the best rounded score, ties by word, found within the row.

    A sentence's length norm is the same for all its words and is left out."""
    ranked = F.transform("terms", lambda t: F.struct((-F.round(score(t), 9)).alias("s"), t["word"].alias("word")))
    return rows.select("sid", F.array_min(ranked)["word"].alias("word"))


def assigned(found: DataFrame, excluded: tuple[str, ...] = (), min_df: int = 2, weighted: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(sid, word) by TF-IDF times ln(df + 1), or TF-IDF alone; sentences without a candidate are left out."""
    rows = fitted(found, min_df, known=known)
    if excluded:
        drop = [w.lower() for w in excluded]
        rows = rows.withColumn("terms", F.filter("terms", lambda t: ~F.lower(t["word"]).isin(*drop))).where(F.size("terms") > 0)
    return _best(rows, _weighted if weighted else _raw)


def first_n(found: DataFrame, assignments: DataFrame, n: int) -> DataFrame:
    """Assignments of the n first sentences; the fit stays that of the whole corpus. n may exceed the corpus."""
    head = found.select("sid").orderBy("sid").limit(n)
    return assignments.join(head, "sid", "left_semi")


def legacy(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sid, word): the first token with the highest score; '' where a sentence has none."""
    ranked = F.transform("terms", lambda t: F.struct((-F.round(_weighted(t), 9)).alias("s"), t["place"].alias("place"), t["word"].alias("word")))
    top = fitted(found, known=known).select("sid", F.array_min(ranked)["word"].alias("word"))
    return found.select("sid").join(top, "sid", "left").select("sid", F.coalesce("word", F.lit("")).alias("word"))


def raw_scores(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(word, score): the distinct scores, TF-IDF times log2(df), of the sentences in each word's cluster.

    Here every term counts, however rare, and the weights are of unit length."""
    best = F.array_min(F.transform("terms", lambda t: F.struct((-F.round(t["raw"], 9)).alias("s"), t["word"].alias("word"), t["raw"].alias("raw"), t["df"].alias("df"))))
    own = normed(fitted(found, min_df=1, known=known)).select("norm", best.alias("b"))
    return own.select("b.word", F.round(F.col("b.raw") / F.col("norm") * F.log2("b.df"), 6).alias("score")).distinct()


def sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("word").agg(F.count("*").alias("size"))


def top_clusters(assignments: DataFrame, top_n: int = 20, min_size: int = 1) -> DataFrame:
    return sizes(assignments).where(F.col("size") >= min_size).orderBy(F.desc("size"), "word").limit(top_n)


def ranked(assignments: DataFrame, top_n: int | None = None, least: bool = False, size: int | None = None) -> DataFrame:
    """(word, size) of any clusters: largest first, or smallest, or those of one size; ties by word; all for no top_n."""
    rows = sizes(assignments)
    if size is not None:
        rows = rows.where(F.col("size") == size)
    rows = rows.orderBy(F.col("size").asc() if least else F.col("size").desc(), "word")
    return rows if top_n is None else rows.limit(top_n)


def drilled(found: DataFrame, word: str, known: DataFrame | None = None) -> DataFrame:
    """(sid, word): the raw cluster of a word, clustered anew without the word."""
    cluster = assigned(found, min_df=1, weighted=False, known=known).where(F.col("word") == word.lower().strip())
    inside = found.join(cluster.select("sid"), "sid", "left_semi")
    return assigned(inside, (word.strip(),), min_df=1, weighted=False)


def iterated(found: DataFrame, seeds: list[str], known: DataFrame | None = None) -> DataFrame:
    """(sid, word): for each seed the corpus shrinks to its cluster and is fitted anew; the last fit excludes all seeds.

    Empty scopes flow through. A level is read three times, so it is cut off by a checkpoint.
    """
    for seed in seeds:
        cluster = assigned(found, known=known).where(F.col("word") == seed.lower().strip()).select("sid")
        found, known = cut(found.join(cluster, "sid", "left_semi")), None
    return assigned(found, tuple(s.lower().strip() for s in seeds), known=known)
