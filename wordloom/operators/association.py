"""Association clusters: words by PMI or NPMI with a seed, weighted by frequency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pos import useful
from ..functions.scores import npmi, pmi
from . import pairs
from .corpus import distinct_postings, lowered, with_size
from .search import containing


@dataclass(frozen=True)
class Options:
    """``None`` is the only unset value; see ``cluster``."""

    top_n: int | None = 20
    min_pmi: float = 0.0
    filter_pos: bool = True
    use_npmi: bool = False
    min_freq: int = 1
    tfidf_range: tuple[float, float] | None = None
    use_freq_weighting: bool = True
    min_score_percent: float = 0.0
    excluded: tuple[str, ...] = ()


def _word_lists(found: DataFrame, min_df: int) -> DataFrame:
    """(ws): the words of each sentence in lower case, or those in at least min_df sentences; a row per sentence."""
    if min_df <= 1:
        return found.select(lowered().alias("ws"))
    words = distinct_postings(found, lower=True)
    words = words.join(words.groupBy("word").count().where(F.col("count") >= min_df).select("word"), "word", "left_semi")
    lists = words.groupBy("sid").agg(F.collect_list("word").alias("ws"))
    return found.select("sid").join(lists, "sid", "left").select("ws")


def pair_counts(found: DataFrame, min_df: int = 1) -> DataFrame:
    """(w1, w2, cooc) with w1 < w2, of every word or of those in at least min_df sentences.

    Pairs are made within sentences and added up in packed blocks; it is quadratic in a sentence's words,
    which is why seed queries use ``with_seed`` instead.
    """
    return pairs.counted(_word_lists(found, min_df))


def pair_count(found: DataFrame, one: str, two: str) -> DataFrame:
    """One row (w1, w2, cooc): symmetric, in lower case, 0 if absent or for a word with itself."""
    a, b = sorted((one.lower(), two.lower()))
    both = containing(found, [a, b]) if a != b else found.where("false")
    return both.agg(F.count("*").alias("cooc")).select(F.lit(a).alias("w1"), F.lit(b).alias("w2"), "cooc")


def scored_pairs(found: DataFrame, min_df: int = 1, scores: tuple[str, ...] = ("df1", "df2", "pmi", "npmi"), digits: int | None = None) -> DataFrame:
    """Pairs with df1, df2, pmi and npmi or some of these; the frequencies and N come with the pairs, in the same pass over ``found``."""
    return pairs.counted(_word_lists(found, min_df), ("w1", "w2", "cooc", *scores), digits)


def with_seed(found: DataFrame, seed: str, words: DataFrame | None = None) -> DataFrame:
    """(word, cooc, df, seed_df, n_sentences) of the words that share a sentence with the seed.

    ``words``: the lower-case vocabulary of ``found``, if it is kept; else only the context's words are counted."""
    inside = containing(found, [seed])
    together = distinct_postings(inside, lower=True).where(F.col("word") != seed).groupBy("word").agg(F.count("*").alias("cooc"))
    if words is None:
        words = distinct_postings(found, lower=True).join(together.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rows = together.join(words.select("word", "df"), "word").withColumn("seed_df", inside.agg(F.count("*")).scalar())
    return with_size(rows, found)


def cluster(found: DataFrame, seed: str, options: Options = Options(), word_scores: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(word, score, df, cooc), best first; no rows for an unknown seed.

    Filters go in this order: frequency, part of speech, TF-IDF range (both ends included, words
    without a score count as 0), a positive weighted score of at least ``min_pmi``, percent of the
    best score, excluded words, then the top. Scores compare after rounding to nine digits, ties by word.
    """
    rows = with_seed(found, seed.lower().strip(), words).where(F.col("df") >= options.min_freq)
    if options.filter_pos:
        rows = rows.where(useful(F.col("word")))
    if options.tfidf_range and word_scores is not None:
        known = word_scores.select("word", F.col("mean_tfidf").alias("_t"))
        rows = rows.join(known, "word", "left").where(F.coalesce("_t", F.lit(0.0)).between(*options.tfidf_range)).drop("_t")
    args = [F.col(c) for c in ("cooc", "seed_df", "df", "n_sentences")]
    score = (npmi if options.use_npmi else pmi)(*args)
    if options.use_freq_weighting:
        score = score * F.log1p("df")
    rows = rows.withColumn("score", F.round(score, 9)).where((F.col("score") > 0) & (F.col("score") >= options.min_pmi))
    if options.min_score_percent > 0:
        best = rows.agg(F.max("score")).scalar()
        rows = rows.where(F.col("score") >= F.round(best * options.min_score_percent / 100, 9))
    if options.excluded:
        rows = rows.where(~F.lower("word").isin(*(w.lower() for w in options.excluded)))
    rows = rows.select("word", "score", "df", "cooc").orderBy(F.desc("score"), "word")
    return rows if options.top_n is None else rows.limit(options.top_n)


def by_frequency(rows: DataFrame, frequency: str, top_n: int) -> DataFrame:
    """The best rows again, by a frequency column falling, then score, then word."""
    return rows.orderBy(F.desc(frequency), F.desc("score"), "word").limit(top_n)


def statistics(rows: DataFrame) -> DataFrame:
    """One row over the scores: count, max, mean, exact median, min; zeros for no rows."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.agg(
        F.count("*").alias("n_words"), zero(F.max("score"), "max_score"), zero(F.avg("score"), "mean_score"), zero(F.median("score"), "median_score"), zero(F.min("score"), "min_score")
    )


def with_sentences(rows: DataFrame, found: DataFrame, seed: str) -> DataFrame:
    """A cluster and its seed's sentences as one table: (kind, word, df, score, sid), kind being word or sentence."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ids = containing(found, [seed]).select(F.lit("sentence").alias("kind"), none("string", "word"), none("long", "df"), none("double", "score"), "sid")
    return rows.select(F.lit("word").alias("kind"), "word", "df", "score", none("long", "sid")).unionByName(ids)


def with_statistics(rows: DataFrame) -> DataFrame:
    """Each row of a short cluster beside the statistics of them all; no rows for no rows."""
    one = statistics(rows)
    both = F.struct(*one.columns)
    return rows.withColumn("s", one.select(both).scalar()).select("*", "s.*").drop("s")
