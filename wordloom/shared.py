"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, as a URI or path; a folder of this machine only for local masters that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="wordloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Files:
    """A few file operations on whatever store a path names, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def status(self, path: str) -> tuple[str, int, int]:
        """Full path, size and modification time in ns; of a folder the sum and the latest of its files."""
        store, at = self._at(path)
        top = store.getFileStatus(at)
        full = top.getPath().toString()
        if not top.isDirectory():
            return full, top.getLen(), top.getModificationTime() * 1_000_000
        size, latest, files = 0, 0, store.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            size, latest = size + f.getLen(), max(latest, f.getModificationTime())
        return full, size, latest * 1_000_000

    def names(self, folder: str) -> list[str]:
        store, at = self._at(folder)
        return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []

    def below(self, folder: str) -> list[str]:
        """All files of a folder and its subfolders, by path."""
        store, at = self._at(folder)
        if not store.exists(at):
            return []
        found, files = [], store.listFiles(at, True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return sorted(found)

    def read(self, path: str) -> str | None:
        """A small text file, None if it isn't there."""
        store, at = self._at(path)
        if not store.exists(at):
            return None
        stream = store.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a small file; False if there is one already."""
        store, at = self._at(path)
        try:
            stream = store.create(at, False)
        except Exception:
            if store.exists(at):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, source: str, target: str) -> None:
        """Renames over what is there; stores without such a rename see a moment without the file."""
        store, at = self._at(source)
        to = self._jvm.org.apache.hadoop.fs.Path(target)
        if not store.rename(at, to):
            store.delete(to, False)
            store.rename(at, to)

    def delete(self, path: str) -> None:
        store, at = self._at(path)
        store.delete(at, True)
