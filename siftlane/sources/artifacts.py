"""Scans of what is blocked: artifacts joined with their active parents and folded to one row an artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.ids import uuid_key
from siftlane.functions.vectors import is_usable


def active_parents(media_ban: DataFrame) -> DataFrame:
    """(ban_uid) of active bans, in the canonical spelling."""
    return media_ban.filter("active").select(uuid_key("ban_uid").alias("ban_uid")).filter("ban_uid is not null")


def _of_active(artifacts: DataFrame, media_ban: DataFrame) -> DataFrame:
    return artifacts.withColumn("ban_uid", uuid_key("ban_uid")).join(active_parents(media_ban), "ban_uid", "left_semi")


def exact(blocked: DataFrame, media_ban: DataFrame, ban_uid: str | None = None) -> DataFrame:
    """(ban_uid, chat_id, file_unique_id) of active bans, of one ban if given; no row means it was not found."""
    d = _of_active(blocked.select("ban_uid", "chat_id", "file_unique_id"), media_ban).distinct()
    return d if ban_uid is None else d.filter(F.col("ban_uid") == uuid_key(F.lit(ban_uid)))


def images(blocked: DataFrame, hashes: DataFrame, media_ban: DataFrame, hash_version: str | None = None, ban_uid: str | None = None) -> DataFrame:
    """(id, ban_uid, chat_id, file_unique_id, media_type, hash_version, hashes): hashes in the order of their variant.

    ``hashes`` has (image_id, variant, hash). An image without hashes has no row, as in an inner join.
    """
    b = _of_active(blocked, media_ban)
    if hash_version is not None:
        b = b.filter(F.col("hash_version") == hash_version)
    if ban_uid is not None:
        b = b.filter(F.col("ban_uid") == uuid_key(F.lit(ban_uid)))
    folded = hashes.groupBy(F.col("image_id").alias("id")).agg(F.transform(F.array_sort(F.collect_set(F.struct("variant", "hash"))), lambda x: x["hash"]).alias("hashes"))
    return b.select("id", "ban_uid", "chat_id", "file_unique_id", "media_type", "hash_version").distinct().join(folded, "id")


def videos(blocked: DataFrame, frames: DataFrame, media_ban: DataFrame | None = None, ban_uid: str | None = None) -> DataFrame:
    """(id, chat_id, source_type, duration_sec, hash_version, frames): frames with a hash, in the order of their index."""
    b = blocked if media_ban is None else _of_active(blocked, media_ban)
    if ban_uid is not None:
        b = b.filter(uuid_key("ban_uid") == uuid_key(F.lit(ban_uid)))
    folded = frames.filter("hash is not null").groupBy(F.col("video_like_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("frame_index", "position_millis", "hash"))).alias("frames"))
    return b.select("id", "chat_id", "source_type", "duration_sec", "hash_version").distinct().join(folded, "id")


def vector_bans(bans: DataFrame, frames: DataFrame, **only: object) -> DataFrame:
    """Active vector bans with their frames in order; ``only`` gives values of chat_id, model_name, model_revision, vector_dim or id.

    Only the conditions given are applied, and they reach the scan.
    """
    b = bans.filter("active")
    for name, value in only.items():
        if value is not None:
            b = b.filter(F.col(name) == value)
    b = b.select("id", "chat_id", "file_unique_id", "media_type", "model_name", "model_revision", "vector_dim").distinct()
    folded = frames.groupBy(F.col("ban_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("frame_index", "position_millis", F.col("id").alias("frame_id"), "vector"))).alias("frames"))
    return b.join(folded, "id")


def active_vectors(frames: DataFrame, bans: DataFrame) -> DataFrame:
    """(frame_id, ban_id, chat_id, model_name, model_revision, frame_index, position_millis, vector): usable vectors of active bans."""
    b = bans.filter("active").select(F.col("id").alias("ban_id"), "chat_id", "model_name", "model_revision", "vector_dim").dropDuplicates(["ban_id"])
    f = frames.select(F.col("id").alias("frame_id"), "ban_id", "frame_index", "position_millis", "vector").dropDuplicates(["frame_id"])
    return f.join(b, "ban_id").filter(is_usable("vector", F.col("vector_dim"))).drop("vector_dim")


def frame_violations(frames: DataFrame, bans: DataFrame) -> DataFrame:
    """(frame_id, violation) of frames without a ban, without a vector, or with a vector of another length than their ban's."""
    b = bans.select(F.col("id").alias("ban_id"), "vector_dim").dropDuplicates(["ban_id"])
    d = frames.select(F.col("id").alias("frame_id"), "ban_id", F.size("vector").alias("n")).distinct().join(b, "ban_id", "left")
    why = F.when(F.col("vector_dim").isNull(), "no ban").when(F.coalesce(F.col("n") < 0, F.lit(True)), "no vector").when(F.col("n") != F.col("vector_dim"), "other length")
    return d.select("frame_id", why.alias("violation")).filter("violation is not null")
