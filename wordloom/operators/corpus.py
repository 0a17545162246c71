"""The corpus as tables: sentences(sid, ..), postings(sid, word, tf, place), vocab(word, df), terms by sentence.

All are lazy; ``prepared`` keeps them written. A sentence is one row, so what concerns one sentence is
counted inside its row and not shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import sentence_texts, tokens

#: sid = doc_index * STRIDE + place in the document: unique and in corpus order without any shuffle.
STRIDE = 1 << 24
#: Documents whose sentence counts one window sums for dense ids.
BUCKET = 1 << 16


def sentences(documents: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """sid, source_document_index, sent_pos, original_text, processed_text, tokens; one row at least per document.

    A null text is one empty sentence. Sentences without tokens stay: they count in N.
    """
    cut = documents.select(F.col("doc_index").alias("source_document_index"), F.posexplode(sentence_texts(F.col("text"))).alias("sent_pos", "original_text"))
    made = cut.withColumn("tokens", tokens(F.col("original_text"), stop_words))
    return made.select(
        (F.col("source_document_index") * STRIDE + F.col("sent_pos")).alias("sid"),
        "source_document_index",
        "sent_pos",
        "original_text",
        F.array_join("tokens", " ").alias("processed_text"),
        "tokens",
    )


def dense_ids(found: DataFrame) -> DataFrame:
    """Adds sentence_index: 0-based and dense in corpus order, by two levels of running sums over documents."""
    counts = found.groupBy("source_document_index").agg(F.count("*").alias("n"))
    counts = counts.withColumn("bucket", F.floor(F.col("source_document_index") / BUCKET))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per BUCKET documents
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket").orderBy("source_document_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(buckets, "bucket")
    starts = starts.select("source_document_index", (F.col("base") + F.col("inner")).alias("start"))
    return found.join(starts, "source_document_index").withColumn("sentence_index", F.col("start") + F.col("sent_pos")).drop("start")


def from_processed(rows: DataFrame) -> DataFrame:
    """Sentences whose processed text is given: (sentence_index, processed_text) as it stands, split at spaces.

    An ``original_text`` in ``rows`` is kept, else the processed text stands for it."""
    original = "original_text" if "original_text" in rows.columns else "processed_text"
    words = F.array_remove(F.split(F.coalesce("processed_text", F.lit("")), " "), "")
    return rows.select(
        F.col("sentence_index").cast("long").alias("sid"), F.col("sentence_index").cast("long").alias("source_document_index"), F.lit(0).alias("sent_pos"),
        F.col(original).alias("original_text"), "processed_text", words.alias("tokens"),
    )


def lowered(tokens: Column | str = "tokens") -> Column:
    return F.transform(tokens, lambda w: F.lower(w))


def distinct_postings(found: DataFrame, lower: bool = False) -> DataFrame:
    """(sid, word), each once; no shuffle."""
    return found.select("sid", F.explode(F.array_distinct(lowered() if lower else F.col("tokens"))).alias("word"))


def postings(found: DataFrame) -> DataFrame:
    """(sid, word, tf, place): how often a word is in a sentence, and where first; no shuffle."""
    ordered = F.array_sort(F.transform("tokens", lambda w, k: F.struct(w.alias("word"), k.alias("place"))))
    rows = found.where(F.size("tokens") > 0).select("sid", F.explode(F.array(ordered)).alias("at"))
    runs = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda k: F.when(k > 0, F.get("at", k)["word"] != F.get("at", k - 1)["word"]).otherwise(True))
    rows = rows.select("sid", "at", F.explode(F.array(runs)).alias("runs"))
    tf = lambda k, n: F.coalesce(F.get("runs", n + 1), F.size("at")) - k
    made = F.transform("runs", lambda k, n: F.struct(F.get("at", k)["word"].alias("word"), tf(k, n).cast("long").alias("tf"), F.get("at", k)["place"].alias("place")))
    return rows.select("sid", F.explode(made).alias("e")).select("sid", "e.word", "e.tf", "e.place")


def terms(found: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(sid, terms): per sentence an array of (word, tf, place, df), df being the sentences of ``found`` that have the word.

    One shuffle by word, unless a kept vocabulary ``words`` is small enough for Spark to broadcast, and one
    by sentence; once kept, weights and clusters need neither. Sentences without tokens are left out."""
    rows = postings(found)
    words = rows.groupBy("word").agg(F.count("*").alias("df")) if words is None else words.select("word", "df")
    each = F.struct("word", "tf", "place", "df")
    return rows.join(words, "word").groupBy("sid").agg(F.collect_list(each).alias("terms"))  # as many as the sentence has words


#: Documents whose postings of a word make one list.
LIST_DOCUMENTS = 1 << 10


def posting_lists(found: DataFrame) -> DataFrame:
    """Inverted index: (word, block, sids), the sorted sentences of a word within a block of LIST_DOCUMENTS documents.

    Blocks bound the lists; a word's whole list is its blocks in order."""
    block = F.floor(F.col("sid") / (STRIDE * LIST_DOCUMENTS)).alias("block")
    rows = distinct_postings(found).select("word", block, "sid")
    return rows.groupBy("word", "block").agg(F.sort_array(F.collect_list("sid")).alias("sids"))


def posting_ranges(found: DataFrame) -> DataFrame:
    """Per word its number of sentences, its first and its last sentence."""
    return distinct_postings(found).groupBy("word").agg(F.count("*").alias("df"), F.min("sid").alias("first_sid"), F.max("sid").alias("last_sid"))


def vocab(found: DataFrame, lower: bool = False) -> DataFrame:
    """(word, df): in how many sentences a word is."""
    return distinct_postings(found, lower).groupBy("word").agg(F.count("*").alias("df"))


def lower_vocab(words: DataFrame, found: DataFrame) -> DataFrame:
    """The vocabulary in lower case, from ``words``, that of ``found``, where no word has another case, else counted."""
    mixed = words.where(F.col("word") != F.lower("word"))
    return words if mixed.isEmpty() else vocab(found, lower=True)


def total_frequencies(found: DataFrame) -> DataFrame:
    return found.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("total_freq"))


def word_frequency(found: DataFrame, word: str) -> DataFrame:
    """One row, or none for a word that isn't in the corpus."""
    return vocab(found.where(F.array_contains("tokens", word))).where(F.col("word") == word)


def most_frequent(words: DataFrame, n: int | None = None) -> DataFrame:
    """By df falling, ties by word; all if n is None."""
    ordered = words.orderBy(F.desc("df"), "word")
    return ordered if n is None else ordered.limit(n)


def least_frequent(words: DataFrame, n: int | None = None) -> DataFrame:
    ordered = words.orderBy("df", "word")
    return ordered if n is None else ordered.limit(n)


def with_frequency(words: DataFrame, df: int) -> DataFrame:
    return words.where(F.col("df") == df)


def texts_of(found: DataFrame, ids: DataFrame, column: str = "original_text") -> DataFrame:
    """(sid, text) of the sentences in ids(sid)."""
    return found.join(ids.select("sid").distinct(), "sid", "left_semi").select("sid", column)


def size(found: DataFrame) -> DataFrame:
    """One row: N."""
    return found.agg(F.count("*").alias("n_sentences"))


def with_size(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with N on each, from a scalar subquery."""
    return rows.withColumn("n_sentences", size(found).scalar())


def rounded(column: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits).alias(name)
