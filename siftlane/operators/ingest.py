"""Writes as set operations: insert-or-get, children, orphaned parents, deactivation, upserts, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in ``order``; rows of a null key stay. The rank is limited before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return rows.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~whole).drop("_n")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one a key, those whose key is not there yet."""
    return first_of(new, keys, order).join(existing.select(*keys), keys, "left_anti")


def insert_or_get(new: DataFrame, existing: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """``new`` with stored_id and created: the id that its key has afterwards, and whether this row brought it.

    Of several new rows with one key the smallest id is stored; a key that exists keeps its smallest id.
    """
    old = existing.groupBy(*keys).agg(F.min(id_).alias("_old"))
    fresh = new.groupBy(*keys).agg(F.min(id_).alias("_new"))
    d = new.join(fresh, keys, "left").join(old, keys, "left")
    stored = F.coalesce("_old", "_new", id_)
    return d.withColumns({"stored_id": stored, "created": F.col("_old").isNull() & (F.col(id_) == stored)}).drop("_old", "_new")


def children(parents: DataFrame, id_: str, values: str, index: str, value: str, existing: DataFrame | None = None) -> DataFrame:
    """(id, index, value) rows of an array column, without those whose (id, index) is there already."""
    d = parents.select(F.col(id_), F.posexplode(values).alias(index, value))
    return d if existing is None else d.join(existing.select(id_, index), [id_, index], "left_anti")


def without_children(parents: DataFrame, key: str, *artifacts: DataFrame) -> DataFrame:
    """Parents that no artifact refers to (a chain of anti-joins); an artifact has a column ``key``."""
    for a in artifacts:
        parents = parents.join(a.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
    return parents


def deactivate(rows: DataFrame, which: Column, now: Column) -> DataFrame:
    """``rows`` with the active ones under ``which`` deactivated at ``now``; doing it again changes nothing."""
    hit = F.coalesce(which, F.lit(False)) & F.col("active")
    return rows.withColumns(
        {
            "deactivated_at": F.when(hit, F.coalesce("deactivated_at", now)).otherwise(F.col("deactivated_at")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
            "active": F.when(hit, F.lit(False)).otherwise(F.col("active")),
        }
    )


def deactivate_with_parents(children_: DataFrame, ids: DataFrame, parents: DataFrame, id_: str, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(children, parents) after the children in ``ids`` are deactivated, and the parents of those that were active."""
    marked = children_.join(ids.select(id_).distinct().withColumn("_hit", F.lit(True)), id_, "left")
    gone = marked.filter("_hit and active").select(key).distinct().withColumn("_hit", F.lit(True))
    return deactivate(marked, F.col("_hit"), now).drop("_hit"), deactivate(parents.join(gone, key, "left"), F.col("_hit"), now).drop("_hit")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their key; ``new`` has one row a key."""
    d = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_src"))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_src")


def outbox_rows(events: DataFrame) -> DataFrame:
    """``events`` (event_uid, event_type, aggregate_type, aggregate_uid, payload STRING) as log rows with an envelope.

    Rows with a null or empty required field raise an error when they are read.
    """
    required = ("event_uid", "event_type", "aggregate_type", "aggregate_uid", "payload")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.coalesce(F.col(c) == "", F.lit(True))
    checked = F.when(missing, F.raise_error(F.lit("an event lacks a required field"))).otherwise(F.col("event_uid"))
    meta = F.struct(F.col("event_uid"), F.col("event_type"), F.col("aggregate_type"), F.col("aggregate_uid"))
    envelope = F.to_json(F.struct(F.col("event_type").alias("destination_topic"), F.col("event_uid").alias("uuid"), F.base64(F.col("payload").cast("binary")).alias("payload"), meta.alias("metadata")))
    return events.select(checked.alias("msg_uuid"), envelope.cast("binary").alias("payload"), F.to_json(meta).alias("metadata"))


def ingest(candidates: DataFrame, stored: dict[str, DataFrame], keys: dict[str, list[str]], fingerprints: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """One batch of bans: (parents kept, artifacts to append by matcher, events).

    ``candidates`` are the parents (ban_uid, chat_id, media_type, file_unique_id); ``fingerprints`` the artifacts each
    matcher has for them (ban_uid and its keys). A parent stays, and is announced, if any of its artifacts is new.
    """
    appended = {name: insert_if_absent(f, stored[name], keys[name], ["ban_uid"]) for name, f in fingerprints.items()}
    kept = None
    for d in appended.values():
        kept = d.select("ban_uid") if kept is None else kept.unionByName(d.select("ban_uid"))
    parents = candidates.join(kept.distinct(), "ban_uid", "left_semi") if kept is not None else candidates.limit(0)
    payload = F.to_json(F.struct("ban_uid", "chat_id", "media_type", "file_unique_id"))
    events = parents.select(F.col("ban_uid").alias("event_uid"), F.lit("media.ban.created.v1").alias("event_type"), F.lit("media_ban").alias("aggregate_type"), F.col("ban_uid").alias("aggregate_uid"), payload.alias("payload"))
    return parents, appended, outbox_rows(events)


def vector_ban_violation(chat: str = "chat_id", model: str = "model_name", dim: str = "vector_dim", frames: str = "frames") -> Column:
    """Why a vector ban cannot be stored, null if it can: frames is ARRAY<STRUCT<frame_index, position_millis, vector>>."""
    f, d = F.col(frames), F.col(dim)
    return (
        F.when(F.col(chat).isNull() | F.coalesce(F.trim(model) == "", F.lit(True)), "no chat or model")
        .when(F.coalesce(d <= 0, F.lit(True)), "no dimension")
        .when(F.coalesce(F.size(f) < 1, F.lit(True)), "no frames")
        .when(F.exists(f, lambda x: F.coalesce(x["frame_index"] < 0, F.lit(True))), "frame index below 0")
        .when(F.exists(f, lambda x: F.coalesce(x["position_millis"] < 0, F.lit(True))), "position below 0")
        .when(F.size(F.array_distinct(F.transform(f, lambda x: x["frame_index"]))) < F.size(f), "frame index repeats")
        .when(F.exists(f, lambda x: F.coalesce(F.size(x["vector"]) != d, F.lit(True))), "vector of another dimension")
    )


def insert_vector_bans(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid rows of ``new`` (id, chat_id, model_name, model_revision, vector_signature, ...) with stored_id and created.

    They are looked up by signature; a row whose key is there gets that id and is not created. Rows with a violation are
    an error when they are read, so nothing of a batch is stored then.
    """
    bad = vector_ban_violation()
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("bigint")).otherwise(F.col("id"))
    return insert_or_get(new.withColumn("id", checked), existing, ["chat_id", "model_name", "model_revision", "vector_signature"])


def insert_videos(new: DataFrame, existing: DataFrame, version: str = "frames-v1") -> DataFrame:
    """``new`` (id, chat_id, hash_version, frames) with hash_signature, stored_id and created; a blank version is ``version``.

    A row without frames is an error when it is read.
    """
    from siftlane.functions.hashes import video_signature

    empty = F.coalesce(F.size("frames") < 1, F.lit(True))
    d = new.withColumns({"hash_version": F.when(F.coalesce(F.trim("hash_version"), F.lit("")) == "", version).otherwise(F.col("hash_version")), "id": F.when(empty, F.raise_error(F.lit("a video has no frames")).cast("bigint")).otherwise(F.col("id"))})
    return insert_or_get(d.withColumn("hash_signature", video_signature("frames")), existing, ["chat_id", "hash_version", "hash_signature"])


def unit_of_work(spark, folder: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Writes several tables as one: each under a new version, then one manifest that puts all of them into force.

    Gives the paths by table. If any of them cannot be written, what was written is removed and the manifest before stays;
    an error while removing is added to the first one.
    """
    import json
    import uuid

    from siftlane import files

    version, paths = uuid.uuid4().hex, {}
    try:
        for name, d in tables.items():
            paths[name] = f"{folder}/{name}/{version}"
            d.write.parquet(paths[name])
        before = json.loads(files.current(spark, f"{folder}/manifest") or "{}")
        files.publish(spark, f"{folder}/manifest", json.dumps({**before, **paths}))
    except Exception as first:
        for path in paths.values():
            try:
                files.delete(spark, path)
            except Exception as second:  # noqa: BLE001 - joined to the first
                first.add_note(f"and while taking back: {second}")
        raise
    return {**before, **paths}
