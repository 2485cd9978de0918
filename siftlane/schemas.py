"""Schemas of the stored tables, in order of their versions; keys are semantics, as parquet does not enforce them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlane import files

# Columns and keys of the tables.
TABLES: dict[str, tuple[str, tuple[tuple[str, ...], ...]]] = {
    "media_ban": ("ban_uid STRING, chat_id BIGINT, media_type STRING, file_unique_id STRING, created_by_user_id BIGINT, created_from_message_id BIGINT, active BOOLEAN, origin_replica_id STRING, source_event_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, deactivated_at TIMESTAMP", (("ban_uid",),)),
    "blocked_exact": ("ban_uid STRING, chat_id BIGINT, file_unique_id STRING, created_at TIMESTAMP", (("ban_uid",), ("chat_id", "file_unique_id"))),
    "blocked_image": ("id BIGINT, ban_uid STRING, chat_id BIGINT, file_unique_id STRING, media_type STRING, hash_version STRING, hash_signature STRING, created_at TIMESTAMP", (("id",), ("chat_id", "hash_version", "hash_signature"))),
    "blocked_image_hash": ("image_id BIGINT, variant INT, hash BIGINT", (("image_id", "variant"),)),
    "blocked_video_like": ("id BIGINT, ban_uid STRING, chat_id BIGINT, file_unique_id STRING, source_type STRING, duration_sec INT, hash_version STRING, hash_signature STRING, created_at TIMESTAMP", (("id",), ("chat_id", "hash_version", "hash_signature"))),
    "blocked_video_like_frame_hash": ("video_like_id BIGINT, frame_index INT, position_millis INT, hash BIGINT", (("video_like_id", "frame_index"),)),
    "vector_ban": ("id BIGINT, ban_uid STRING, chat_id BIGINT, file_unique_id STRING, media_type STRING, model_name STRING, model_revision STRING, vector_dim INT, frames_count INT, active BOOLEAN, vector_signature STRING, created_at TIMESTAMP, updated_at TIMESTAMP, deactivated_at TIMESTAMP", (("id",), ("chat_id", "model_name", "model_revision", "vector_signature"))),
    "stored_vector_frame": ("id BIGINT, ban_id BIGINT, frame_index INT, position_millis INT, vector ARRAY<FLOAT>, created_at TIMESTAMP", (("id",), ("ban_id", "frame_index"))),
    "vector_index_state": ("model_name STRING, model_revision STRING, vector_dim INT, index_type STRING, index_path STRING, active_vectors_count BIGINT, active_vectors_hash STRING, index_file_sha256 STRING, rebuilt_at TIMESTAMP", (("model_name", "model_revision", "vector_dim", "index_type"),)),
    "outbox_event": ("transaction_id DECIMAL(20,0), log_offset BIGINT, msg_uuid STRING, created_at TIMESTAMP, payload BINARY, metadata STRING", (("transaction_id", "log_offset"), ("msg_uuid",))),
    "consumer_offset": ("consumer_group STRING, offset_acked BIGINT, last_processed_transaction_id DECIMAL(20,0)", (("consumer_group",),)),
    "index_checkpoint": ("consumer_id STRING, index_name STRING, last_tx DECIMAL(20,0), last_offset BIGINT, updated_at TIMESTAMP, stale BOOLEAN, stale_reason STRING", (("consumer_id", "index_name"),)),
}


def schema(name: str) -> StructType:
    """The schema of a table; no inference."""
    return StructType.fromDDL(TABLES[name][0])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the table's columns and types: missing ones are null, others are left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def key_violations(df: DataFrame, name: str) -> DataFrame:
    """(key, n): values of a table's keys that stand in several rows. Rows with a null in a key are no violation."""
    out = None
    for columns in TABLES[name][1]:
        d = df.filter(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        d = d.select(F.concat_ws("|", F.lit(",".join(columns)), *columns).alias("key"), "n")
        out = d if out is None else out.unionByName(d)
    return out


def migrate(spark: SparkSession, folder: str, to: int | None = None) -> int:
    """Brings the tables in ``folder`` to version ``to``, the latest if none is given: table by table, up or down.

    Version k has the first k tables. A table that comes is empty; one that goes is removed with its rows, after the
    version without it is in force, so a step that fails is done again from the version before or after it.
    """
    names = list(TABLES)
    to = len(names) if to is None else to
    if not 0 <= to <= len(names):
        raise ValueError(f"there is no version {to}")
    at = int(files.current(spark, f"{folder}/version") or 0)
    while at != to:
        up = to > at
        name = names[at] if up else names[at - 1]
        if up and not files.exists(spark, f"{folder}/{name}/_SUCCESS"):
            spark.createDataFrame([], schema(name)).write.mode("overwrite").parquet(f"{folder}/{name}")
        at += 1 if up else -1
        files.publish(spark, f"{folder}/version", str(at))
        if not up:
            files.delete(spark, f"{folder}/{name}")
    return at
