"""The event log: envelopes, metadata fallbacks and reads after a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.ids import position

CREATED = "media.ban.created.v1"
_META = "event_uid STRING, event_type STRING, aggregate_type STRING, aggregate_uid STRING"
_ENVELOPE = f"destination_topic STRING, uuid STRING, payload STRING, metadata STRUCT<{_META.replace(' STRING', ': STRING')}>"


def _first(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def unwrap(log: DataFrame) -> DataFrame:
    """``log`` with event_uid, event_type, aggregate_type, aggregate_uid, wrapped BOOLEAN and inner STRING.

    A payload is an envelope if it is JSON with a non-empty destination_topic; its inner payload is base64. Values that
    are null or empty are filled from the row's metadata, the envelope's metadata, then msg_uuid and the envelope's uuid
    (event_uid) or the topic (event_type). Texts that are no JSON, and base64 that cannot be decoded, count as absent:
    the row stays, with null in what they would have given. Columns of ``log`` with one of these names are replaced.
    """
    raw = F.col("payload").cast("string")
    m, e = F.from_json("metadata", _META), F.from_json(raw, _ENVELOPE)
    d = log.withColumns({"_m": m, "_e": F.when(raw.contains("destination_topic"), e)})
    wrapped = F.coalesce(F.col("_e.destination_topic") != "", F.lit(False))
    env = lambda name: F.when(wrapped, F.col(f"_e.{name}"))
    return d.withColumns(
        {
            "event_uid": _first(F.col("_m.event_uid"), env("metadata.event_uid"), F.col("msg_uuid"), env("uuid")),
            "event_type": _first(F.col("_m.event_type"), env("metadata.event_type"), env("destination_topic")),
            "aggregate_type": _first(F.col("_m.aggregate_type"), env("metadata.aggregate_type")),
            "aggregate_uid": _first(F.col("_m.aggregate_uid"), env("metadata.aggregate_uid")),
            "wrapped": wrapped,
            "inner": F.when(wrapped, F.try_to_binary(F.col("_e.payload"), F.lit("base64")).cast("string")).otherwise(raw),
        }
    ).drop("_m", "_e")


def ban_created(log: DataFrame) -> DataFrame:
    """Deliveries of a created ban whose inner JSON can be read, with its fields as ``ban`` STRUCT."""
    ban = F.from_json("inner", "ban_uid STRING, chat_id BIGINT, media_type STRING, file_unique_id STRING")
    return unwrap(log).filter(F.col("event_type") == CREATED).withColumn("ban", ban).filter(F.col("ban").isNotNull())


def load_after(log: DataFrame, tx: int | str, offset: int, limit: int | None = None) -> DataFrame:
    """Rows after a position in the order of positions; the predicate reaches the parquet scan."""
    tx = int(tx)
    t = F.col("transaction_id").cast("decimal(20,0)")
    after = log.filter((t > F.lit(tx).cast("decimal(20,0)")) | ((t == F.lit(tx).cast("decimal(20,0)")) & (F.col("log_offset") > F.lit(offset))))
    after = after.orderBy(position())
    return after if limit is None else after.limit(limit)
