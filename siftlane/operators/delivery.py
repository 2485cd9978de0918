"""Messages delivered more than once: exactly one copy of each stays.

Method: only (identifier, delivery order, file, row position) are shuffled. The winner of an identifier is its smallest
delivery order; the others become per-file deletion vectors. Files without any are read as they are; the others are read
with their vectors beside them, which are broadcast for as many files at a time as a bound allows. Every file is read
once, by Spark's own reader and inside the JVM, and payloads never cross the network.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.files import is_folder
from siftlane.functions.ids import uuid_key
from siftlane.operators.skew import heavy_keys, lookup
from siftlane.session import cut, written
from siftlane.sources.outbox import unwrap

#: Rows of a file that one deletion vector covers; its bitmap has BLOCK / 64 words, 8 KiB.
BLOCK = 1 << 16
#: Deletion vectors that are broadcast at a time: 64 MiB.
VECTORS = 8192


def positions(log: DataFrame, identifier: str = "event_uid", order: str = "delivery_id") -> DataFrame:
    """(ident, ord, file, pos) of a log read from parquet files: the narrow rows that are shuffled."""
    d = unwrap(log.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos")))
    return d.select(uuid_key(identifier).alias("ident"), F.col(order).alias("ord"), F.xxhash64("_file").alias("file"), F.col("_pos").alias("pos"))


def losers(narrow: DataFrame) -> DataFrame:
    """(ident, ord, file, pos, kept): the copies to remove; ``kept`` is the order of the copy that stays.

    Of copies with an equal order (a delivery written twice) the one with the smallest (file, pos) stays; a null order
    comes last. Rows without an identifier are never copies. A hot identifier is combined before the shuffle and its
    rows are then checked by broadcast.
    """
    narrow = cut(narrow.filter(F.col("ident").isNotNull()))
    place = F.struct(F.coalesce("ord", F.lit(2**63 - 1)).alias("ord"), "file", "pos")
    groups = cut(narrow.groupBy("ident").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter(F.col("n") > 1))
    heavy = cut(heavy_keys(groups, "ident"))
    seen = lookup(narrow, groups.select("ident", "first"), "ident", heavy, "inner")
    return seen.filter(place > F.col("first")).select("ident", "ord", "file", "pos", F.col("first.ord").alias("kept"))


def deletion_vectors(lost: DataFrame) -> DataFrame:
    """(file, block, words): per file and block of rows a bitmap of BLOCK bits; a bit that is set is a row to leave out."""
    word = F.expr("shiftleft(cast(1 as bigint), cast(pos % 64 as int))")
    words = lost.groupBy("file", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), F.floor(F.col("pos") % BLOCK / 64).cast("int").alias("word")).agg(F.bit_or(word).alias("bits"))
    found = words.groupBy("file", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return found.select("file", "block", F.expr(f"transform(sequence(0, {BLOCK // 64 - 1}), w -> coalesce(m[w], 0L))").alias("words"))


def read_once(spark: SparkSession, path: str, identifier: str = "event_uid", order: str = "delivery_id", vectors: int = VECTORS) -> DataFrame:
    """The log at ``path`` with all its columns and exactly one delivery of each identifier.

    At most ``vectors`` deletion vectors are broadcast at a time; a file with more than that many blocks is alone.
    """
    log = spark.read.parquet(path)
    dv = written(deletion_vectors(losers(positions(log, identifier, order))))
    blocks = {r["file"]: r["n"] for r in dv.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a file
    # the driver holds the list of files anyway, for the scan
    names = [unquote(f) for f in log.inputFiles()]
    ids = {}
    if blocks:
        listed = spark.createDataFrame([(k, f) for k, f in enumerate(log.inputFiles())], "k INT, f STRING")
        ids = {r["k"]: r["id"] for r in listed.select("k", F.xxhash64(F.regexp_replace("f", "^file:/+", "file:/")).alias("id")).collect()}
        if missing := set(blocks) - set(ids.values()):
            raise ValueError(f"{len(missing)} files of the log are not in its list of files")
    groups: list[list[int]] = [[]]
    room = vectors
    for k in range(len(names)):
        if n := blocks.get(ids.get(k)):
            if n > room and groups[-1]:
                groups.append([])
                room = vectors
            groups[-1].append(k)
            room -= n
    # columns told by folders are those below the path itself
    below = {"basePath": path} if is_folder(spark, path) else {}
    read = lambda ks: spark.read.schema(log.schema).options(**below).parquet(*(names[k] for k in ks))
    clean = [k for k in range(len(names)) if ids.get(k) not in blocks]
    out = read(clean) if clean else log.limit(0)
    for group in filter(None, groups):
        wide = read(group).select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_pos"))
        at = wide.withColumn("_b", F.floor(F.col("_pos") / BLOCK).cast("bigint"))
        here = F.broadcast(dv.filter(F.col("file").isin([ids[k] for k in group])).select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("words").alias("_w")))
        lost = F.coalesce(F.expr(f"shiftrightunsigned(get(_w, cast(_pos % {BLOCK} as int) div 64), cast(_pos % 64 as int)) & 1L"), F.lit(0))
        out = out.unionByName(at.join(here, ["_f", "_b"], "left").filter(lost == 0).select(*log.columns))
    return out


def repeated_deliveries(log: DataFrame) -> DataFrame:
    """(delivery_id) of every delivery of an event_uid but the first; event_uid is found as in ``sources.outbox.unwrap``."""
    lost = losers(positions(log))
    return lost.filter(F.col("ord") > F.col("kept")).select(F.col("ord").alias("delivery_id")).distinct()
