"""Snapshots of a vector index: built from active bans under a version of their own, accepted only if they still agree.

A snapshot is a folder of normalised vectors by tenant bucket and a manifest. Writers build a new version beside the one in
force, check what was written, and then publish the manifest, which is one new small file; readers see the old version or
the new one. A writer that stops early leaves a folder nothing refers to.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane import files
from siftlane.functions.vectors import l2_normalize
from siftlane.operators.approximate import GRAPH
from siftlane.operators.ingest import first_of


def content_digest(vectors: DataFrame, id_: str = "frame_id", vector: str = "vector") -> str:
    """A digest of all (id, vector) that does not depend on their order or place; computed in one pass, in parts.

    Rows are hashed where they are, combined by addition and exclusive-or, and only the combination is hashed again.
    """
    h = F.sha2(F.concat_ws("|", F.col(id_).cast("string"), F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")), 256)
    word = lambda k: F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("bigint")
    row = vectors.agg(F.count(F.lit(1)).alias("n"), *(F.sum(word(k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)), *(F.bit_xor(word(k)).alias(f"x{k}") for k in range(4))).first()
    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def normalised(vectors: DataFrame) -> DataFrame:
    """(frame_id, ban_id, chat_id, model_name, model_revision, frame_index, vector) as a snapshot holds them."""
    return vectors.select("frame_id", "ban_id", "chat_id", "model_name", "model_revision", "frame_index", l2_normalize("vector").alias("vector"))


def build(vectors: DataFrame, path: str, buckets: int = 16) -> None:
    """Writes normalised vectors by tenant bucket; a bucket is spread over as many files as its rows ask for."""
    d = normalised(vectors).withColumn("bucket", F.pmod(F.xxhash64("chat_id"), F.lit(buckets)).cast("int"))
    d.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def one_dimension(vectors: DataFrame) -> int:
    """The length all vectors have, 0 if there are none; several lengths are an error."""
    sizes = sorted(r[0] for r in vectors.select(F.size("vector").alias("n")).filter("n > 0").distinct().limit(2).collect())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} elements in one index")
    return sizes[0] if sizes else 0


def manifest(vectors: DataFrame) -> dict:
    """What a snapshot must agree with: kind, number, dimension and digest of the active vectors, parameters."""
    return {"kind": "normalised-parquet", "count": vectors.count(), "dimension": one_dimension(vectors), "digest": content_digest(vectors), "parameters": GRAPH}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest that is in force, null if there is none."""
    text = files.current(spark, f"{path}/manifest")
    return None if text is None else json.loads(text)


def publish(spark: SparkSession, path: str, new: dict) -> None:
    """Puts a manifest into force; readers see the old one or the new one, and there is always one."""
    files.publish(spark, f"{path}/manifest", json.dumps(new, sort_keys=True))


def verified(spark: SparkSession, path: str, stored: dict | None) -> DataFrame | None:
    """The snapshot that ``stored`` names, if all its rows are there and give the digest of when they were written."""
    if stored is None:
        return None
    try:
        index = spark.read.parquet(f"{path}/{stored['version']}").drop("bucket")
        fine = index.count() == stored["count"] and content_digest(index) == stored["checksum"]
    except (PySparkException, Py4JJavaError, KeyError):  # no such folder, files that cannot be read, a manifest of another form
        return None
    return index if fine else None


def load_or_rebuild(spark: SparkSession, vectors: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """(index, rebuilt): the snapshot at ``path`` if its manifest agrees with ``vectors`` and its rows with the manifest.

    Otherwise a new version is built, read back, compared with ``vectors`` and published; the version before the one
    that was in force is removed. Rows that cannot be read when they are looked at count as not agreeing.
    """
    want, stored = manifest(vectors), read_manifest(spark, path)
    if stored is not None and {k: stored.get(k) for k in want} == want and (index := verified(spark, path, stored)) is not None:
        return index, False
    version = f"version-{uuid.uuid4().hex}"
    build(vectors, f"{path}/{version}")
    index = spark.read.parquet(f"{path}/{version}").drop("bucket")
    checksum = content_digest(index)
    # what was written must be what the table holds now, row by row
    if index.count() != want["count"] or checksum != content_digest(normalised(vectors)):
        files.delete(spark, f"{path}/{version}")
        raise RuntimeError("the vectors changed while their snapshot was written")
    publish(spark, path, {**want, "version": version, "checksum": checksum})
    kept = {version, (stored or {}).get("version")}
    for name in files.names(spark, path):
        if name.startswith("version-") and name not in kept:
            files.delete(spark, f"{path}/{name}")
    return index, True


def add_with_compensation(new: DataFrame, store: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], None], undo: Callable[[DataFrame], None]) -> DataFrame:
    """Stores ``new``, then indexes what that call created; if indexing fails, only those rows are taken back.

    ``store`` gives its rows with ``created``; rows that were there before are neither indexed again nor taken back.
    """
    created = store(new).filter("created")
    try:
        index(created)
    except Exception:
        undo(created)
        raise
    return created


def apply_events(index: DataFrame, vectors: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, status): vectors of the events' bans that the index lacks, and per event skipped, already_applied or applied.

    ``events`` (ban_id). A ban without active vectors is skipped; applying an event again adds nothing.
    """
    e = events.select("ban_id").distinct()
    # of several rows with one frame the smallest id is kept, whatever the order of rows
    theirs = first_of(vectors.join(e, "ban_id", "left_semi"), ["ban_id", "frame_index"], ["frame_id"])
    added = theirs.join(index.select("ban_id", "frame_index"), ["ban_id", "frame_index"], "left_anti")
    n = theirs.groupBy("ban_id").agg(F.count(F.lit(1)).alias("have")).join(added.groupBy("ban_id").agg(F.count(F.lit(1)).alias("new")), "ban_id", "left")
    status: Column = F.when(F.col("have").isNull(), "skipped").when(F.col("new").isNull(), "already_applied").otherwise("applied")
    return added, e.join(n, "ban_id", "left").select("ban_id", status.alias("status"))


def active_counts(vectors: DataFrame) -> DataFrame:
    """(chat_id, model_name, model_revision, vectors)."""
    return vectors.groupBy("chat_id", "model_name", "model_revision").agg(F.count(F.lit(1)).alias("vectors"))
