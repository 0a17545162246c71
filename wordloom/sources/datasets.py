"""Named CSV datasets of short texts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Files

#: Environment variable that caps documents; 0 is no cap.
CAP_VARIABLE = "DATASET_MAX_DOCUMENTS"


@dataclass(frozen=True)
class DatasetSource:
    key: str
    filename: str
    text_column: str
    default_cap: int | None = None
    customers_only: bool = False
    #: Texts may hold line breaks; then a file is one task, so give many files. Without, files are split.
    multi_line: bool = True

    @property
    def variant(self) -> str:
        """Distinguishes caches of one file."""
        return f"{self.key}:{'customer' if self.customers_only else 'all'}"


SOURCES = {
    s.key: s
    for s in (
        DatasetSource("reddit", "reddit.csv", "body"),
        DatasetSource("twitter_support", "twcs.csv", "text", 100_000, True),
    )
}


def get_source(key: str) -> DatasetSource:
    if key not in SOURCES:
        raise ValueError(f"unknown dataset {key!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[key]


def resolve_cap(source: DatasetSource, explicit: int | None = None) -> int | None:
    """Explicit value, else the environment, else the source's; 0 is no cap, a negative one an error."""
    cap = explicit
    if cap is None and os.environ.get(CAP_VARIABLE):
        cap = int(os.environ[CAP_VARIABLE])
    if cap is None:
        cap = source.default_cap
    if cap is not None and cap < 0:
        raise ValueError("a cap can't be negative")
    return cap or None


def customers(rows: DataFrame, column: str = "inbound") -> DataFrame:
    """Rows whose flag reads true in any case."""
    return rows.where(F.lower(F.trim(F.col(column).cast("string"))) == "true")


def capped(documents: DataFrame, cap: int | None) -> DataFrame:
    """The first documents by doc_index: deterministic, whatever order files are read in."""
    return documents if cap is None else documents.orderBy("doc_index").limit(cap)


def with_text(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor blank; the text stays unstripped."""
    return rows.where(F.col(column).isNotNull() & F.col(column).rlike(r"[^\s\p{Z}]"))


def numbered(rows: DataFrame, name: str = "doc_index") -> DataFrame:
    """Adds dense numbers from 0 in the order of files and rows, without moving any row.

    ``rows`` has (file, block), where a row was read. Rows are counted by block of a file first; only
    these counts, one for each piece that a task reads, are summed up in one place."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    blocks = at.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return at.join(starts, ["file", "block"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_at", "_start", "file", "block")


def files_of(files: Files, folder: str, filename: str) -> str | None:
    """Path of the first file of that name in a folder or its subfolders, None if there is none."""
    return next((p for p in files.below(folder) if p.rsplit("/", 1)[-1] == filename), None)


def read_csv(spark: SparkSession, path: str, source: DatasetSource, cap: int | None = None) -> DataFrame:
    """documents(doc_index, text) of a quoted CSV with a header; only needed columns are parsed.

    doc_index counts the texts that are kept from 0, in file order; the cap takes the first."""
    with_header = spark.read.option("header", True).option("multiLine", source.multi_line).option("quote", '"').option("escape", '"')
    names = with_header.csv(path).columns
    rows = with_header.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if source.customers_only:
        rows = customers(rows)
    rows = numbered(with_text(rows, source.text_column).select(F.col(source.text_column).alias("text"), "file", "block"))
    return capped(rows.select("doc_index", "text"), resolve_cap(source, cap))


def from_texts(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """documents(doc_index, text) of a list; what isn't a string is an empty text."""
    rows = [(k, t if isinstance(t, str) else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_index long, text string")
