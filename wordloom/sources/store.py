"""Sentences kept as Parquet, one dataset per source file, behind catalog entries that are swapped last."""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Files

SCHEMA = "dataset_id long, sentence_index long, source_document_index long, original_text string, processed_text string"


@dataclass(frozen=True)
class Entry:
    id: int
    name: str
    source_path: str
    source_size: int
    source_mtime_ns: int
    preprocessing_version: str
    status: str
    sentence_count: int
    created_at: str
    updated_at: str
    folder: str


def _now() -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())


class SentenceStore:
    """A folder, on any store that Spark reaches, with a Parquet folder per dataset and a small entry file for each.

    Saving writes a new folder first, then replaces the dataset's own entry in one rename, then removes
    the folder replaced; readers see the old version or the new one. One version per source path is
    current. Writers of different datasets touch different files; numbers are claimed by creating a file."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def _entry_path(self, source_path: str) -> str:
        return f"{self.folder}/catalog/{hashlib.sha256(source_path.encode()).hexdigest()}.json"

    def _entry(self, source_path: str) -> Entry | None:
        text = self.files.read(self._entry_path(source_path))
        return Entry(**json.loads(text)) if text else None

    def _swap(self, entry: Entry, old: Entry | None) -> None:
        new = f"{self.folder}/catalog/.{uuid.uuid4().hex}"
        self.files.create(new, json.dumps(asdict(entry)))
        self.files.replace(new, self._entry_path(entry.source_path))
        if old is not None:
            self.files.delete(old.folder)

    def _number(self) -> int:
        taken = [int(n) for n in self.files.names(f"{self.folder}/numbers") if n.isdigit()]
        n = max(taken, default=0) + 1
        while not self.files.create(f"{self.folder}/numbers/{n}", ""):
            n += 1
        return n

    def fingerprint(self, source_path: str) -> tuple[str, int, int]:
        """Full path, size and modification time of a source."""
        return self.files.status(source_path)

    def datasets(self) -> list[Entry]:
        """All entries by id."""
        names = [n for n in self.files.names(f"{self.folder}/catalog") if n.endswith(".json") and not n.startswith(".")]
        found = [self.files.read(f"{self.folder}/catalog/{n}") for n in names]
        return sorted((Entry(**json.loads(t)) for t in found if t), key=lambda e: e.id)

    def _rows(self, entry: Entry) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(entry.folder)

    def cached(self, source_path: str, version: str, ordered: bool = True) -> DataFrame | None:
        """Sentences, in order if asked for, if ready and of this very file and version, and complete; else None."""
        path, size, mtime = self.fingerprint(source_path)
        e = self._entry(path)
        if e and (e.source_size, e.source_mtime_ns, e.preprocessing_version, e.status) == (size, mtime, version, "ready"):
            rows = self._rows(e)
            if rows.count() == e.sentence_count:
                return rows.orderBy("sentence_index") if ordered else rows
        return None

    def save(self, name: str, source_path: str, version: str, rows: DataFrame) -> int:
        """Replaces the dataset of a source with rows(sentence_index, source_document_index, original_text, processed_text)."""
        path, size, mtime = self.fingerprint(source_path)
        old = self._entry(path)
        number = old.id if old else self._number()
        folder = f"{self.folder}/dataset_id={number}-{uuid.uuid4().hex}"
        entry = Entry(number, name, path, size, mtime, version, "building", 0, old.created_at if old else _now(), _now(), folder)
        columns = ["sentence_index", "source_document_index", "original_text", "processed_text"]
        rows.select(F.lit(number).cast("long").alias("dataset_id"), *columns).write.parquet(folder)
        count = self._rows(entry).count()
        self._swap(replace(entry, status="ready", sentence_count=count), old)
        return count

    def migrate(self, database: str) -> int:
        """Takes over a legacy database, a file of this machine: metadata(key, value) and sentences without a dataset id.

        Rows go over in blocks, each a file of its own. Returns their number."""

        def blocks(con: sqlite3.Connection) -> Iterator[list[tuple]]:
            rows = con.execute("SELECT sentence_index, source_document_index, original_text, processed_text FROM sentences ORDER BY 1")
            while block := rows.fetchmany(50_000):
                yield block

        with sqlite3.connect(database) as con:
            meta = dict(con.execute("SELECT key, value FROM metadata"))
            path = meta.get("source_path", database)
            old, number = self._entry(path), self._number()
            folder, count = f"{self.folder}/dataset_id={number}-{uuid.uuid4().hex}", 0
            self.spark.createDataFrame([], SCHEMA).write.parquet(folder)
            for block in blocks(con):
                self.spark.createDataFrame([(number, *r) for r in block], SCHEMA).write.mode("append").parquet(folder)
                count += len(block)
        size, mtime = (int(meta.get(k, 0)) for k in ("source_size", "source_mtime_ns"))
        self._swap(Entry(number, os.path.basename(path), path, size, mtime, meta.get("preprocessing_version", ""), "ready", count, _now(), _now(), folder), old)
        return count


def export_scores(rows: DataFrame, path: str, word: str = "word", score: str = "score") -> str:
    """Text files of lines ``word: score`` with six digits; read in the order of their names, best first."""
    text = F.format_string("%s: %.6f", F.col(word), F.col(score).cast("double")).alias("value")
    best = [F.desc(score), F.col(word)]
    rows.repartitionByRange(*best).sortWithinPartitions(*best).select(text).write.mode("overwrite").text(path)
    return path


def export_processed(sentences: DataFrame, path: str) -> str:
    """One processed sentence a line, in parallel part files that keep corpus order."""
    sentences.select("sid", "processed_text").repartitionByRange("sid").sortWithinPartitions("sid").select("processed_text").write.mode("overwrite").text(path)
    return path
