"""A corpus from raw documents to packed sequences: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import minhash, packing, pii, quality
from wordloom.llm.stage import joined, written

#: SQL can't express near-duplicates, masking and packing at once; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, rows as they are: repeated ones and null ids stay, a null text has no words and goes.

    A null source is a host of its own; other columns may have any names; an empty table stays empty."""
    return quality.judged(docs).where("kept").select("row.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word, 0.8 near-duplicates: the one with the least id; a repeated row stays once.

    Rows of null or repeated ids are documents of their own and come after all others, by their place in
    the input; only they need keys of their own, so without any the ids are the keys. Null and wordless
    texts link with nothing and stay; other columns may have any names; an empty table stays empty.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = written(ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty() and ids.where("doc_id is null").isEmpty():
        gone = written(minhash.near_duplicates(docs).where("not kept").select("doc_id"), "gone")
        return joined(docs, gone, "doc_id", "left_anti")
    last = ids.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("place"))
    rows = rows.join(again.select(F.col("doc_id").alias("id"), F.lit(True).alias("again")), "id", "left")
    key = F.when(F.col("id").isNull() | F.col("again"), last + 1 + F.col("place")).otherwise(F.col("id")).alias("key")
    keyed = written(rows.select("row", "text", key), "keyed")
    gone = written(minhash.near_duplicates(keyed, id_col="key").where("not kept").select(F.col("doc_id").alias("key")), "gone")
    return joined(keyed, gone, "key", "left_anti").select("row.*").dropDuplicates(["doc_id", "text"])


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars is that of the new text.

    A null text stays null and keeps its n_chars; repeated rows and null ids stay; other columns may
    have any names; an empty table stays empty."""
    length = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return pii.masked(docs).withColumn("n_chars", length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand in training sequences.

    A null text is empty and has its end id; repeated rows and null ids have pieces of their own; other
    columns are left out, whatever their names; an empty table gives no rows."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("personal_data", no_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
