"""Small files and folders on whatever file system Spark is given: HDFS, object stores, local paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder; one that is not there is none."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file: under another name first, then one rename to a name that must not exist yet."""
    fs, p = _at(spark, path)
    _, fresh = _at(spark, f"{path}._new")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(fresh, p):
        raise FileExistsError(path)


def publish(spark: SparkSession, folder: str, text: str) -> int:
    """Puts ``text`` into force as the next version of ``folder``; readers see the old version or the new one.

    A version is one file under a new name, and nothing is replaced, so there is no moment without one. The two before
    it are kept for readers that are still at them, older ones are removed.
    """
    had = [int(n.partition(".")[0]) for n in names(spark, folder) if n.endswith(".version")]
    version = max(had, default=0) + 1
    write_text(spark, f"{folder}/{version:010d}.version", text)
    for old in sorted(had)[:-2]:
        delete(spark, f"{folder}/{old:010d}.version")
    return version


def current(spark: SparkSession, folder: str) -> str | None:
    """The text in force in ``folder``; null if there is none."""
    had = [n for n in names(spark, folder) if n.endswith(".version")]
    return read_text(spark, f"{folder}/{had[-1]}") if had else None
