"""Queries of the general problems: orphan references (3) and repeated deliveries (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.operators.delivery import read_once, repeated_deliveries
from siftlane.operators.references import ban_references, ban_targets, orphan_report, orphan_rows
from siftlane.session import table


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images, frames, log = (table(spark, d, t) for t in ("blocked_image", "stored_vector_frame", "outbox_event"))
    return ban_references(images, frames, log), ban_targets(table(spark, d, "media_ban"), table(spark, d, "vector_ban"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(*_refs(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    refs, there = _refs(spark, d)
    return orphan_report(refs.distinct(), there)  # equal rows are one record


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_deliveries(table(spark, d, "outbox_event"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    return read_once(spark, f"{d}/outbox_event.parquet").select("delivery_id", "batch_no", "log_offset", F.length("payload").alias("payload_bytes"), F.md5("payload").alias("payload_md5"))


_UID = """CASE WHEN length({0}) = 38 THEN substr(lower({0}), 2, 36) WHEN length({0}) = 45 AND lower({0}) LIKE 'urn:uuid:%' THEN substr(lower({0}), 10)
 WHEN length({0}) = 32 THEN regexp_replace(lower({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN length({0}) = 36 THEN lower({0}) END"""


def _uid(c: str) -> str:
    u = _UID.format(c)
    return f"(CASE WHEN {c} <> '' THEN CASE WHEN regexp_full_match({u}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN {u} ELSE {c} END END)"


_UNWRAPPED = f"""raw AS (SELECT delivery_id, batch_no, log_offset, msg_uuid, created_at, payload, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS m,
  CASE WHEN json_valid(decode(payload)) THEN decode(payload)::JSON END AS j FROM outbox_event),
env AS (SELECT *, coalesce(j->>'destination_topic', '') <> '' AS wrapped FROM raw),
log AS (SELECT delivery_id, batch_no, log_offset, created_at, payload,
  coalesce(nullif(m->>'event_uid', ''), CASE WHEN wrapped THEN nullif(j->'metadata'->>'event_uid', '') END, nullif(msg_uuid, ''), CASE WHEN wrapped THEN nullif(j->>'uuid', '') END) AS uid,
  coalesce(nullif(m->>'event_type', ''), CASE WHEN wrapped THEN nullif(j->'metadata'->>'event_type', '') END, CASE WHEN wrapped THEN j->>'destination_topic' END) AS event_type,
  CASE WHEN wrapped THEN decode(from_base64(j->>'payload')) ELSE j::VARCHAR END AS inn FROM env)"""

_REFS = f"""{_UNWRAPPED},
pay AS (SELECT delivery_id, created_at, CASE WHEN json_valid(inn) THEN inn::JSON->>'ban_uid' END AS b FROM log WHERE event_type = 'media.ban.created.v1'),
refs AS (SELECT DISTINCT 'blocked_image' AS src, id::VARCHAR AS row_key, 'm' || {_uid("ban_uid")} AS ref, created_at FROM blocked_image
  UNION SELECT 'stored_vector_frame', id::VARCHAR, 'v' || ban_id::VARCHAR, created_at FROM stored_vector_frame
  UNION SELECT 'ban_created_payload', delivery_id::VARCHAR, 'm' || {_uid("b")}, created_at FROM pay),
tgt AS (SELECT DISTINCT 'm' || {_uid("ban_uid")} AS ref, created_at AS since, deactivated_at AS until FROM media_ban
  UNION SELECT 'v' || id::VARCHAR, created_at, deactivated_at FROM vector_ban),
judged AS (SELECT src, (year(created_at) * 100 + month(created_at))::INT AS period_ym, row_key,
  NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.ref = refs.ref AND coalesce(since <= refs.created_at, true) AND coalesce(until > refs.created_at, true)) AS dead FROM refs WHERE ref IS NOT NULL)"""

_COPIES = f"""{_UNWRAPPED},
ranked AS (SELECT *, {_uid("uid")} AS ident, row_number() OVER (PARTITION BY {_uid("uid")} ORDER BY delivery_id) AS nth FROM log)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found, "p6_kept": p6_kept}

SQL = {
    "p3_found": f"WITH {_REFS} SELECT DISTINCT src, period_ym, row_key FROM judged WHERE dead",
    "p3_report": f"WITH {_REFS} SELECT src, period_ym, count(*)::BIGINT AS n_references, count(*) FILTER (WHERE dead)::BIGINT AS n_orphans FROM judged GROUP BY ALL",
    "p6_found": f"WITH {_COPIES} SELECT delivery_id FROM ranked WHERE ident IS NOT NULL AND nth > 1",
    "p6_kept": f"WITH {_COPIES} SELECT delivery_id, batch_no, log_offset, octet_length(payload)::INT AS payload_bytes, md5(payload) AS payload_md5 FROM ranked WHERE ident IS NULL OR nth = 1",
}
