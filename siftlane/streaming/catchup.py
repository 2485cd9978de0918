"""Projections that follow the event log: each index is its own streaming query with its own progress.

A micro-batch applies its supported events in one set operation. Applying is idempotent: rows of the projection are
keyed, so a batch that is replayed after a failure, or that overlaps a snapshot, changes nothing. Events of other types
advance the progress like any other.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftlane import files
from siftlane.functions.ids import uuid_key
from siftlane.operators import progress as checkpoints
from siftlane.operators.ingest import first_of
from siftlane.sources.outbox import CREATED, unwrap


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The event log's parquet files as a stream; a file is one append, and files are taken in order of their time."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


@dataclass(frozen=True)
class Applier:
    """One index's way to follow the log: which events it supports, and the rows it makes of them.

    Events of other types are not handed on, and do not hold the index up.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]
    supports: tuple[str, ...] = (CREATED,)

    def __call__(self, batch: DataFrame) -> DataFrame:
        return self.apply(unwrap(batch).filter(F.col("event_type").isin(*self.supports)).select(*batch.columns))


def applied(batch: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(ban_uid, chat_id, file_unique_id, tx, off): rows the created-ban events of a batch add, one a ban, the first in the log.

    With ``artifacts`` (ban_uid, ...) only bans that have one; an event without an artifact is skipped.
    """
    d = unwrap(batch).filter(F.col("event_type") == CREATED)
    ban = F.from_json("inner", "ban_uid STRING, chat_id BIGINT, file_unique_id STRING")
    d = d.select(ban.alias("b"), F.col("transaction_id").alias("tx"), F.col("log_offset").alias("off")).filter("b.ban_uid <> ''")
    d = d.select(uuid_key("b.ban_uid").alias("ban_uid"), "b.chat_id", "b.file_unique_id", "tx", "off")
    if artifacts is not None:
        d = d.join(artifacts.select(uuid_key("ban_uid").alias("ban_uid")).distinct(), "ban_uid", "left_semi")
    return first_of(d, ["ban_uid"], ["tx", "off"])


#: Buckets of keys within a part; parts of one size that are merged into one of the next.
BUCKETS, MERGE = 32, 8


def _state(spark: SparkSession, target: str) -> dict:
    return json.loads(files.current(spark, f"{target}/manifest") or '{"parts": []}')


def _rows(spark: SparkSession, target: str, state: dict, parts: list[dict]) -> DataFrame:
    """The rows of parts, with their bucket; the schema stands in the manifest, as no part need have any rows."""
    schema = StructType.fromJson(state["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", target).parquet(*(f"{target}/{p['name']}" for p in parts)).select(*schema.names)


def projection(target: str, apply: Callable[[DataFrame], DataFrame], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch that appends to ``target`` the rows whose keys it does not hold.

    The parts in force stand in a manifest, published last; a batch that is run again replaces its own part. Rows lie in
    buckets of their keys, and only buckets that a batch touches are looked up. Parts of one size are merged, so their
    number grows with the logarithm of the number of batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, target)
        parts = [p for p in state["parts"] if p["batch"] != number]
        new = apply(batch).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
        try:
            fresh, state["schema"] = new, json.loads(new.schema.json())
            if parts:
                have = _rows(spark, target, state, parts)
                touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS rows
                fresh = new.join(have.filter(F.col("bucket").isin(touched)).select("bucket", *keys), ["bucket", *keys], "left_anti").select(*new.columns)
            parts.append({"name": _write(fresh, target), "batch": number, "size": 0})
        finally:
            new.unpersist()
        merged: list[dict] = []
        while len(same := [p for p in parts if p["size"] == parts[-1]["size"]]) >= MERGE and number >= 0:
            # the latest batch stays apart, as it may be run again
            old = same[:-1] if parts[-1]["batch"] == number else same
            if len(old) < 2:
                break
            joined = {"name": _write(_rows(spark, target, state, old), target), "batch": -1, "size": old[0]["size"] + 1}
            parts = [p for p in parts if p not in old]
            parts.insert(0, joined)
            merged += old
        files.publish(spark, f"{target}/manifest", json.dumps({**state, "parts": parts}))
        for p in merged:
            files.delete(spark, f"{target}/{p['name']}")

    return run


def _write(rows: DataFrame, target: str) -> str:
    name = f"part={uuid.uuid4().hex}"
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/{name}")
    return name


def follow(log: DataFrame, target: str, progress: str, apply: Callable[[DataFrame], DataFrame] = applied, keys: tuple[str, ...] = ("ban_uid",), every: str | None = None) -> StreamingQuery:
    """Starts the query that keeps ``target`` up to date; ``every`` ("5 seconds") keeps it running, else it ends when caught up."""
    writer = log.writeStream.foreachBatch(projection(target, apply, list(keys))).option("checkpointLocation", progress)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def catch_up(log: DataFrame, indexes: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]], seconds: int = 3600) -> dict[str, str]:
    """Catches up several indexes (target, progress, apply) at the same time; gives the error of each that failed.

    One whose time is up counts as failed, too; its query is stopped. A failed index keeps its progress; see ``settled``.
    """
    started = {name: follow(log, target, progress, apply) for name, (target, progress, apply) in indexes.items()}
    failed = {}
    for name, query in started.items():
        try:
            if not query.awaitTermination(seconds):
                failed[name] = f"not caught up within {seconds} s"
                query.stop()
        except Exception as e:  # noqa: BLE001 - reported, the other indexes go on
            failed[name] = str(e).splitlines()[0]
    return failed


def settled(stored: DataFrame, consumer: str, names: list[str], failed: dict[str, str], tx: int, offset: int) -> DataFrame:
    """The checkpoints after ``catch_up``: indexes that failed are stale where they were, the others are at (tx, offset)."""
    spark = stored.sparkSession
    done = spark.createDataFrame([(consumer, n, str(tx), offset) for n in names if n not in failed], "consumer_id STRING, index_name STRING, tx STRING, off BIGINT")
    wanted = spark.createDataFrame([(consumer, n) for n in names], "consumer_id STRING, index_name STRING")
    others = stored.join(wanted, ["consumer_id", "index_name"], "left_anti").select("consumer_id", "index_name", "last_tx", "last_offset", "stale", "stale_reason")
    mine = checkpoints.advance(checkpoints.get_or_create(stored, wanted), done)
    for name, reason in failed.items():
        mine = checkpoints.mark_stale(mine, F.col("index_name") == name, reason or "failed")
    return others.unionByName(mine.select(*others.columns))


def catch_up_then_follow(log: DataFrame, indexes: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]], every: str = "5 seconds", seconds: int = 3600) -> dict[str, StreamingQuery]:
    """Brings all indexes up to date and only then starts their live queries; if one cannot be, none is started."""
    if failed := catch_up(log, indexes, seconds):
        raise RuntimeError("not caught up: " + "; ".join(f"{n}: {why}" for n, why in sorted(failed.items())))
    return {name: follow(log, target, progress, apply, every=every) for name, (target, progress, apply) in indexes.items()}


def with_restarts(start: Callable[[], StreamingQuery], attempts: int = 6, wait: float = 1.0, growth: float = 1.5, most: float = 60.0) -> None:
    """Runs a query until it ends; one that fails is started again after a pause that grows, at most ``attempts`` times."""
    for k in range(attempts):
        try:
            start().awaitTermination()
            return
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(min(most, wait * growth**k))


def forward(log: DataFrame, progress: str, send: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hands each new part of the log to ``send`` (rows with topic, event_uid and the message as text), at least once.

    A batch counts as sent when ``send`` returns; if it raises, the same batch comes again, so receivers keep one copy of
    each event_uid.
    """

    def run(batch: DataFrame, number: int) -> None:
        d = unwrap(batch)
        send(d.filter("event_type is not null").select(F.col("event_type").alias("topic"), "event_uid", F.col("inner").alias("message"), "transaction_id", "log_offset"), number)

    writer = log.writeStream.foreachBatch(run).option("checkpointLocation", progress)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def snapshot(spark: SparkSession, target: str, base: DataFrame | None = None, keys: tuple[str, ...] = ("ban_uid",)) -> DataFrame:
    """The projection as it stands; rows of ``base`` (a snapshot loaded before) come first, an overlap does no harm."""
    state = _state(spark, target)
    d = _rows(spark, target, state, state["parts"]).drop("bucket")
    return d if base is None else base.unionByName(d.join(base.select(*keys), list(keys), "left_anti"))
