"""A corpus built once: sentences, terms, vocabulary and postings as tables, and how they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Files
from . import corpus

#: Words are dealt into so many folders; a word's postings are read from one of them.
BUCKETS = 64


@dataclass(frozen=True)
class Prepared:
    """``sentences``, their ``terms``, ``vocab`` (word, df) and ``postings`` (bucket, word, sid, tf, place), written."""

    sentences: DataFrame
    terms: DataFrame
    vocab: DataFrame
    postings: DataFrame
    folder: str

    def of_word(self, word: str) -> DataFrame:
        """The postings of a word: one folder is read, and of its row groups, sorted by word, few."""
        return self.postings.where((F.col("bucket") == _bucket(F.lit(word))) & (F.col("word") == word))

    def drop(self) -> None:
        Files(self.sentences.sparkSession).delete(self.folder)


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def prepare(sentences: DataFrame, folder: str) -> Prepared:
    """Writes all tables under ``folder``; each is made from those written before it.

    Postings are sorted by word within their folder; a word in a great part of all sentences spreads
    over many files, as partitions are balanced by size."""
    spark = sentences.sparkSession
    sentences.write.parquet(f"{folder}/sentences")
    found = spark.read.parquet(f"{folder}/sentences")
    corpus.vocab(found).write.parquet(f"{folder}/vocab")
    corpus.terms(found, spark.read.parquet(f"{folder}/vocab")).write.parquet(f"{folder}/terms")
    rows = corpus.postings(found).withColumn("bucket", _bucket("word")).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "word", "sid").write.partitionBy("bucket").parquet(f"{folder}/postings")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Prepared:
    """What ``prepare`` has written."""
    kinds = {"sentences": None, "terms": None, "vocab": None, "postings": "sid long, word string, tf long, place int, bucket int"}
    read = {k: (spark.read.schema(v) if v else spark.read).parquet(f"{folder}/{k}") for k, v in kinds.items()}
    return Prepared(folder=folder, **read)
