"""Queries of the matching engine over the test tables, each with SQL that gives the same rows.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.engine import voted
from siftlane.functions import hashes as H
from siftlane.functions import settings, vectors
from siftlane.functions.ids import uuid_key
from siftlane.operators import index, ingest, matching, media, messages, progress
from siftlane.operators.approximate import approximate_top_k
from siftlane.plans.data_quality import _UNWRAPPED, _uid
from siftlane.session import table
from siftlane.sources import artifacts, outbox

#: Queries of a search; a time that stands for now; a position in the log.
EVERY, NOW, TX, OFFSET = 50, "2026-01-01 00:00:00", 1200, 0


def _images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "stored_image_hash").select("id", "chat_id", "hashes")
    return s.filter(F.col("id") % EVERY == 0).dropDuplicates(["id"]), s


def _videos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = artifacts.videos(table(spark, d, "blocked_video_like"), table(spark, d, "blocked_video_like_frame_hash"), table(spark, d, "media_ban"))
    return s.filter(F.col("id") % EVERY == 0), s


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = artifacts.active_vectors(table(spark, d, "stored_vector_frame"), table(spark, d, "vector_ban"))
    q = s.filter(F.col("frame_id") % EVERY == 0).select(F.col("frame_id").alias("query_id"), F.col("ban_id").alias("own_ban"), "chat_id", "model_name", "model_revision", "vector")
    return q, s


def exact_active_scan(spark: SparkSession, d: str) -> DataFrame:
    bans = table(spark, d, "media_ban")
    return artifacts.exact(bans, bans)


def exact_block_semi(spark: SparkSession, d: str) -> DataFrame:
    bans = table(spark, d, "media_ban").filter("active")
    return matching.exact_blocked(table(spark, d, "blocked_image").select("id", "chat_id", "file_unique_id").distinct(), bans).select("id", "chat_id", "file_unique_id")


def imagehash_radius_semi(spark: SparkSession, d: str) -> DataFrame:
    return matching.image_blocked(*_images(spark, d), itself=False)


def imagehash_min_distance(spark: SparkSession, d: str) -> DataFrame:
    return matching.image_distances(*_images(spark, d), itself=False)


def imagehash_fold(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocked_image")
    rows = ingest.children(b.select("id", H.hashes_of("hash_signature").alias("h")), "id", "h", "variant", "hash").withColumnRenamed("id", "image_id")
    return artifacts.images(b, rows, table(spark, d, "media_ban")).select("id", "ban_uid", H.image_signature("hashes").alias("signature"))


def imagehash_signature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocked_image").select("id", "chat_id", "hash_version", H.image_signature(H.hashes_of("hash_signature")).alias("signature")).filter("signature <> ''").distinct()
    return ingest.first_of(b, ["chat_id", "hash_version", "signature"], ["id"])


def video_fold(spark: SparkSession, d: str) -> DataFrame:
    return _videos(spark, d)[1].select("id", H.video_signature("frames").alias("signature"))


def videolike_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.video_matches(*_videos(spark, d), itself=False).withColumn("matched_ratio", F.round("matched_ratio", 9)).withColumn("reported_ratio", F.round("reported_ratio", 9))


def videolike_first_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.first_match(matching.video_matches(*_videos(spark, d), itself=False))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return matching.vector_top_k(*_vectors(spark, d), itself=False)


def vector_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    return approximate_top_k(*_vectors(spark, d), itself=False)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(hits, checked) of the bans whose id is divisible by EVERY as items, against the vectors of all other bans."""
    s = artifacts.active_vectors(table(spark, d, "stored_vector_frame"), table(spark, d, "vector_ban"))
    i = s.filter(F.col("ban_id") % EVERY == 0)
    q = i.select(F.col("frame_id").alias("query_id"), F.col("ban_id").alias("own_ban"), "chat_id", "model_name", "model_revision", "vector")
    frames = i.select(F.col("frame_id").alias("query_id"), F.col("ban_id").alias("item_id"), F.col("frame_index").alias("frame"))
    hits = matching.vector_top_k(q, s, itself=False).join(frames, "query_id").select("item_id", "frame", "ban_id", "score")
    return hits, i.groupBy(F.col("ban_id").alias("item_id")).agg(F.count(F.lit(1)).alias("checked_frames"))


def vector_static_vote(spark: SparkSession, d: str) -> DataFrame:
    return matching.static_vote(_items(spark, d)[0])


def vector_frame_vote(spark: SparkSession, d: str) -> DataFrame:
    return matching.frame_vote(*_items(spark, d))


def matcher_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Media files (chat_id, file_unique_id) of every 50th image, video and vector ban through all four matchers.

    An item has the fingerprints that its record has; a record does not match itself.
    """
    pick = lambda t, kind, *c: table(spark, d, t).filter(F.col("id") % EVERY == 0).select(F.concat(F.lit(kind), F.col("id")).alias("id"), F.col("id").alias("key"), "chat_id", "file_unique_id", *c).dropDuplicates(["id"])
    files = [pick("stored_image_hash", "i"), pick("blocked_video_like", "v"), pick("vector_ban", "f")]
    named = lambda ids, kind, column="id": ids.select(F.concat(F.lit(kind), F.col(column)).alias("id"))
    hits, checked = _items(spark, d)
    tiers = [
        ("exact", lambda left: matching.exact_blocked(left, table(spark, d, "media_ban").filter("active"))),
        ("imagehash", lambda left: named(matching.image_blocked(*_images(spark, d), itself=False), "i")),
        ("videolike", lambda left: named(matching.video_matches(*_videos(spark, d), itself=False).select("q_id").distinct(), "v", "q_id")),
        ("vector", lambda left: named(voted(hits, checked), "f")),
    ]
    return matching.cascade(files[0].unionByName(files[1]).unionByName(files[2]), tiers)


def media_routing(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "media_ban").select(uuid_key("ban_uid").alias("ban_uid"), "media_type", F.concat("file_unique_id", F.when(F.length("file_unique_id") % 2 == 0, ".webm").otherwise(".jpg")).alias("path")).distinct()
    return b.select("ban_uid", "media_type", media.routes().alias("r")).select("ban_uid", "media_type", "r.*")


def limit_check(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "blocked_video_like").select("id", "source_type", "duration_sec", F.length("hash_signature").alias("size_bytes"), F.lit("x.webm").alias("path")).distinct()
    return v.select("id", media.limit_violation("source_type").alias("violation"))


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, d, "blocked_image").filter("hash_signature is not null").select("id", "chat_id", "hash_version", H.image_signature(H.hashes_of("hash_signature")).alias("signature"), "batch_no").dropDuplicates(["id"])
    # the last batch is the new one; a row without a batch comes after all
    b = b.withColumn("batch_no", F.coalesce("batch_no", F.lit(2**31 - 1)))
    last = b.agg(F.max("batch_no").alias("last"))
    marked = b.join(F.broadcast(last))  # one row
    return marked.filter("batch_no = last").drop("batch_no", "last"), marked.filter("batch_no < last").drop("batch_no", "last")


def ingest_insert_or_get(spark: SparkSession, d: str) -> DataFrame:
    return ingest.insert_or_get(*_batches(spark, d), ["chat_id", "hash_version", "signature"]).select("id", "stored_id", "created")


def ingest_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return ingest.insert_if_absent(*_batches(spark, d), ["chat_id", "hash_version", "signature"], ["id"]).select("id")


def ingest_orphan_delete(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "media_ban").select(uuid_key("ban_uid").alias("ban_uid")).distinct()
    kids = [table(spark, d, t).select(uuid_key("ban_uid").alias("ban_uid")) for t in ("blocked_image", "blocked_video_like")]
    return ingest.without_children(parents, "ban_uid", *kids)


def deactivate_cascade(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocked_image").select("id", uuid_key("ban_uid").alias("ban_uid"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("deactivated_at"), "hash_version").dropDuplicates(["id"])
    p = table(spark, d, "media_ban").select(uuid_key("ban_uid").alias("ban_uid"), "active", F.col("updated_at").cast("timestamp").alias("updated_at"), F.col("deactivated_at").cast("timestamp").alias("deactivated_at")).dropDuplicates(["ban_uid"])
    _, parents = ingest.deactivate_with_parents(b, b.filter("hash_version like '%v0'"), p, "id", "ban_uid", F.lit(NOW).cast("timestamp"))
    return parents.select("ban_uid", "active", F.date_format("deactivated_at", "yyyy-MM-dd HH:mm:ss").alias("deactivated"))


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "vector_ban").dropDuplicates(["id"])
    count = lambda x: x.groupBy("model_name", "model_revision", "vector_dim").agg(F.count(F.lit(1)).alias("bans"))
    return ingest.upsert(count(b), count(b.filter("active and model_revision <> 'r1'")), ["model_name", "model_revision", "vector_dim"])


def outbox_load_after(spark: SparkSession, d: str) -> DataFrame:
    return outbox.load_after(table(spark, d, "outbox_event"), TX, OFFSET, 100).select("delivery_id", F.col("transaction_id").cast("bigint").alias("tx"), "log_offset")


def outbox_unwrap(spark: SparkSession, d: str) -> DataFrame:
    u = outbox.unwrap(table(spark, d, "outbox_event"))
    return u.select("delivery_id", uuid_key("event_uid").alias("event_uid"), "event_type", "wrapped", F.md5(F.get_json_object("inner", "$.ban_uid")).alias("ban_md5"))


def outbox_backlog(spark: SparkSession, d: str) -> DataFrame:
    return progress.backlog(table(spark, d, "outbox_event"), TX, OFFSET, F.lit(NOW).cast("timestamp"))


def event_artifact_join(spark: SparkSession, d: str) -> DataFrame:
    e = outbox.ban_created(table(spark, d, "outbox_event")).select("delivery_id", uuid_key("ban.ban_uid").alias("ban_uid"))
    b = table(spark, d, "blocked_image").select("id", uuid_key("ban_uid").alias("ban_uid")).distinct()
    return e.join(b, "ban_uid").select("delivery_id", "id", "ban_uid")


def checkpoint_advance(spark: SparkSession, d: str) -> DataFrame:
    log = outbox.unwrap(table(spark, d, "outbox_event"))
    of = F.when(F.col("event_type") == outbox.CREATED, "imagehash").otherwise("other")
    applied = log.select(F.lit("replica-a").alias("consumer_id"), of.alias("index_name"), F.col("transaction_id").alias("tx"), F.col("log_offset").alias("off"))
    start = spark.createDataFrame([("replica-a", "imagehash", 0, 0, True, "failed"), ("replica-a", "other", 10**15, 0, True, "failed"), ("replica-b", "imagehash", 0, 0, False, None)], "consumer_id STRING, index_name STRING, last_tx BIGINT, last_offset BIGINT, stale BOOLEAN, stale_reason STRING")
    moved = progress.advance(start.withColumn("last_tx", F.col("last_tx").cast("decimal(20,0)")), applied)
    return moved.select("consumer_id", "index_name", F.col("last_tx").cast("bigint").alias("last_tx"), "last_offset", "stale")


def checkpoint_fresh(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "media_ban").select("media_type").distinct()
    have = kinds.filter("media_type <> 'photo'").select(F.lit("replica-a").alias("consumer_id"), F.col("media_type").alias("index_name"), F.lit(1).cast("decimal(20,0)").alias("last_tx"), F.lit(1).cast("bigint").alias("last_offset"), (F.col("media_type") == "animation").alias("stale"), F.lit("x").alias("stale_reason"))
    return progress.freshness(have, kinds.select(F.lit("replica-a").alias("consumer_id"), F.col("media_type").alias("index_name")))


def active_vector_count(spark: SparkSession, d: str) -> DataFrame:
    return index.active_counts(_vectors(spark, d)[1])


def index_apply_status(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)[1]
    have = v.filter(F.col("model_revision") == "r3")
    return index.apply_events(have, v, table(spark, d, "vector_ban").select(F.col("id").alias("ban_id")))[1]


def vector_blob_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "stored_vector_frame").filter("vector is not null").select("id", "vector").dropDuplicates(["id"])
    blob = f.select("id", "vector", vectors.to_bytes("vector").alias("blob"))
    same = F.forall(F.zip_with("vector", vectors.from_bytes("blob"), lambda x, y: x.eqNullSafe(y)), lambda b: b)
    return blob.select("id", F.length("blob").alias("bytes"), same.alias("same"))


def vector_signatures(spark: SparkSession, d: str) -> DataFrame:
    b = artifacts.vector_bans(table(spark, d, "vector_ban"), artifacts.active_vectors(table(spark, d, "stored_vector_frame"), table(spark, d, "vector_ban")).withColumnRenamed("frame_id", "id"))
    return b.select("id", vectors.vector_signature("frames").alias("signature"))


def http_metrics_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = progress.histogram(table(spark, d, "events"), F.col("value"), ["event_type"], [1.0, 10.0, 100.0, 1000.0])
    return h.withColumn("total", F.round("total", 2))


def message_targets(spark: SparkSession, d: str) -> DataFrame:
    photo = lambda uid: F.array(F.struct(F.lit("s").alias("file_id"), F.lit("small").alias("file_unique_id")), F.struct(F.lit("l").alias("file_id"), uid.alias("file_unique_id")))
    b = table(spark, d, "media_ban").filter("created_from_message_id is not null").select("chat_id", "created_from_message_id", "file_unique_id", "media_type").distinct()
    reply = F.struct(F.col("created_from_message_id").alias("message_id"), photo(F.col("file_unique_id")).alias("photo"))
    raw = b.select(F.to_json(F.struct((F.col("created_from_message_id") + 1).alias("message_id"), F.struct(F.col("chat_id").alias("id"), F.lit("supergroup").alias("type")).alias("chat"), F.lit("/ban@bot").alias("text"), F.when(F.col("media_type") != "photo", reply).alias("reply_to_message"), F.when(F.col("media_type") == "photo", photo(F.col("file_unique_id"))).alias("photo"))).alias("json"))
    return messages.targets(messages.normalized(raw))


def setting_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("m")), (F.col("event_id") % 3 + 1).cast("int"))).alias("duration"), F.concat(F.col("event_id").cast("string"), F.element_at(F.array(F.lit("KiB"), F.lit("mb"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))).alias("size"))
    return e.select("event_id", F.round(settings.duration_seconds("duration"), 6).alias("seconds"), settings.size_bytes("size").alias("bytes"), settings.frame_name("event_id").alias("frame"))


QUERIES = {f.__name__: f for f in (exact_active_scan, exact_block_semi, imagehash_radius_semi, imagehash_min_distance, imagehash_fold, imagehash_signature_dedupe, video_fold, videolike_match, videolike_first_match, vector_topk, vector_topk_approximate, vector_static_vote, vector_frame_vote, matcher_cascade, media_routing, limit_check, ingest_insert_or_get, ingest_insert_if_absent, ingest_orphan_delete, deactivate_cascade, manifest_upsert, outbox_load_after, outbox_unwrap, outbox_backlog, event_artifact_join, checkpoint_advance, checkpoint_fresh, active_vector_count, index_apply_status, vector_blob_roundtrip, vector_signatures, http_metrics_histogram, message_targets, setting_texts)}

_ACTIVE = f"act AS (SELECT DISTINCT {_uid('ban_uid')} AS ban_uid FROM media_ban WHERE active AND ban_uid <> '')"
# hashes of a signature as unsigned numbers, in order
_HS = "list_filter(list_transform(string_split(regexp_replace(hash_signature, '\\s', '', 'g'), '|'), lambda p: TRY_CAST(p AS UBIGINT)), lambda h: h IS NOT NULL)"
_SIG = f"array_to_string(list_transform({_HS}, lambda h: h::VARCHAR), '|')"
_UNSIGNED = "(CASE WHEN {0} < 0 THEN {0}::HUGEINT + 18446744073709551616 ELSE {0}::HUGEINT END)"
_DIST = """h AS (SELECT DISTINCT id, chat_id, h FROM (SELECT id, chat_id, unnest(hashes) AS h FROM stored_image_hash) WHERE h IS NOT NULL),
dist AS (SELECT q.id, min(bit_count(xor(q.h, s.h))::INT) AS distance FROM h q JOIN h s ON q.chat_id = s.chat_id AND q.id <> s.id WHERE q.id % 50 = 0 GROUP BY q.id)"""
_V = f"""{_ACTIVE},
fr AS (SELECT DISTINCT video_like_id AS id, frame_index, position_millis, hash FROM blocked_video_like_frame_hash WHERE hash IS NOT NULL),
v AS (SELECT DISTINCT b.id, b.chat_id, b.hash_version, frame_index, position_millis, hash, count(*) OVER (PARTITION BY b.id) AS n FROM (SELECT DISTINCT id, chat_id, source_type, duration_sec, hash_version FROM blocked_video_like WHERE {_uid('ban_uid')} IN (SELECT ban_uid FROM act)) b JOIN fr USING (id)),
m AS (SELECT q.id AS q_id, s.id AS s_id, q.n AS nq, s.n AS ns, count(DISTINCT (q.frame_index, q.position_millis, q.hash))::INT AS matched_frames FROM v q JOIN v s ON q.chat_id = s.chat_id AND q.hash_version = s.hash_version AND q.id <> s.id AND bit_count(xor(q.hash, s.hash)) <= 12 WHERE q.id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, greatest(2, ceil(0.4 * least(nq, ns))::INT) AS required FROM m),
ok AS (SELECT * FROM r WHERE matched_frames >= required AND least(nq, ns) >= required)"""
_VEC = """vf AS (SELECT DISTINCT ON (id) id AS frame_id, ban_id, frame_index, vector FROM stored_vector_frame),
vb AS (SELECT DISTINCT ON (id) id AS ban_id, chat_id, model_name, model_revision, vector_dim FROM vector_ban WHERE active),
u AS (SELECT frame_id, ban_id, chat_id, model_name, model_revision, frame_index, list_transform(vector, lambda x: x::DOUBLE) AS v FROM vf JOIN vb USING (ban_id)
  WHERE vector IS NOT NULL AND len(vector) = vector_dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
_TOP = _VEC + """, uu AS (SELECT *, sqrt(list_inner_product(v, v)) AS nrm FROM u),
sc AS (SELECT q.frame_id AS query_id, q.ban_id AS item_id, q.frame_index AS frame, s.ban_id, s.frame_index, s.frame_id, round(list_inner_product(q.v, s.v) / (q.nrm * s.nrm), 6) AS score FROM uu q JOIN uu s USING (chat_id, model_name, model_revision) WHERE q.ban_id <> s.ban_id AND q.{0} % 50 = 0),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ban_id, frame_index, frame_id) <= 5)"""
_ITEMS = f"""{_TOP.format("ban_id")}, chk AS (SELECT ban_id AS item_id, count(*) AS n FROM u WHERE ban_id % 50 = 0 GROUP BY ban_id),
vt AS (SELECT item_id, ban_id, count(DISTINCT frame) AS frames FROM top WHERE score >= 0.92 GROUP BY ALL)"""
_BATCH = f"b AS (SELECT DISTINCT id, chat_id, hash_version, {_SIG} AS signature, coalesce(batch_no, 2147483647) AS batch_no FROM blocked_image WHERE hash_signature IS NOT NULL), l AS (SELECT max(batch_no) AS z FROM b)"
_PARENT = f"p AS (SELECT DISTINCT {_uid('ban_uid')} AS ban_uid, active, deactivated_at FROM media_ban)"

SQL = {
    "exact_active_scan": f"WITH {_ACTIVE} SELECT DISTINCT act.ban_uid, chat_id, file_unique_id FROM media_ban m JOIN act ON {_uid('m.ban_uid')} = act.ban_uid",
    "exact_block_semi": "SELECT DISTINCT id, chat_id, file_unique_id FROM blocked_image i WHERE file_unique_id <> '' AND EXISTS (SELECT 1 FROM media_ban m WHERE m.active AND m.chat_id = i.chat_id AND m.file_unique_id = i.file_unique_id)",
    "imagehash_radius_semi": f"WITH {_DIST} SELECT id FROM dist WHERE distance <= 12",
    "imagehash_min_distance": f"WITH {_DIST} SELECT * FROM dist",
    "imagehash_fold": f"WITH {_ACTIVE} SELECT DISTINCT id, act.ban_uid, {_SIG} AS signature FROM blocked_image i JOIN act ON {_uid('i.ban_uid')} = act.ban_uid WHERE len({_HS}) > 0",
    "imagehash_signature_dedupe": f"WITH b AS (SELECT DISTINCT id, chat_id, hash_version, {_SIG} AS signature FROM blocked_image) SELECT min(id) AS id, chat_id, hash_version, signature FROM b WHERE signature <> '' GROUP BY ALL",
    "video_fold": f"WITH {_V} SELECT id, string_agg(concat_ws(':', frame_index, position_millis, {_UNSIGNED.format('hash')}), '|' ORDER BY frame_index, position_millis NULLS FIRST, hash) AS signature FROM v GROUP BY id",
    "videolike_match": f"WITH {_V} SELECT q_id, s_id, matched_frames, round(matched_frames / least(nq, ns), 9) AS matched_ratio, required AS reported_frames, round(required / least(nq, ns), 9) AS reported_ratio FROM ok",
    "videolike_first_match": f"WITH {_V} SELECT q_id, min(s_id) AS s_id FROM ok GROUP BY q_id",
    "vector_topk": f"WITH {_TOP.format('frame_id')} SELECT query_id, ban_id, frame_index, frame_id, score FROM top",
    # every tenant of the test tables is small enough to be searched exactly
    "vector_topk_approximate": f"WITH {_TOP.format('frame_id')} SELECT query_id, ban_id, frame_index, frame_id, score FROM top",
    "vector_static_vote": f"WITH {_ITEMS} SELECT item_id, max(score) >= 0.92 AS blocked FROM top GROUP BY item_id",
    "vector_frame_vote": f"WITH {_ITEMS} SELECT item_id, ban_id, frames FROM vt JOIN chk USING (item_id) WHERE frames >= 2 AND frames / n >= 0.4",
    "matcher_cascade": f"WITH {_V}, {_DIST}, {_ITEMS}, i AS (SELECT DISTINCT ON (id) 'i' || id AS id, id AS key, chat_id, file_unique_id FROM stored_image_hash WHERE id % 50 = 0 UNION ALL SELECT DISTINCT ON (id) 'v' || id, id, chat_id, file_unique_id FROM blocked_video_like WHERE id % 50 = 0 UNION ALL SELECT DISTINCT ON (id) 'f' || id, id, chat_id, file_unique_id FROM vector_ban WHERE id % 50 = 0), vec AS (SELECT item_id FROM top JOIN chk USING (item_id) WHERE n = 1 AND score >= 0.92 UNION SELECT item_id FROM vt JOIN chk USING (item_id) WHERE n > 1 AND frames >= 2 AND frames / n >= 0.4), x AS (SELECT id, CASE WHEN file_unique_id <> '' AND EXISTS (SELECT 1 FROM media_ban m WHERE m.active AND m.chat_id = i.chat_id AND m.file_unique_id = i.file_unique_id) THEN 'exact' WHEN id LIKE 'i%' AND key IN (SELECT id FROM dist WHERE distance <= 12) THEN 'imagehash' WHEN id LIKE 'v%' AND key IN (SELECT q_id FROM ok) THEN 'videolike' WHEN id LIKE 'f%' AND key IN (SELECT item_id FROM vec) THEN 'vector' END AS matched_by FROM i) SELECT id, CASE WHEN matched_by IS NULL THEN 'clean' ELSE 'blocked' END AS status, matched_by FROM x",
    "media_routing": f"SELECT DISTINCT {_uid('ban_uid')} AS ban_uid, media_type, media_type IN ('photo', 'animation', 'sticker_static', 'sticker_animated') AS exact, media_type IN ('photo', 'sticker_static') AND length(file_unique_id) % 2 = 1 AS imagehash, media_type = 'animation' OR media_type = 'sticker_static' AND length(file_unique_id) % 2 = 0 AS videolike, media_type = 'photo' AND length(file_unique_id) % 2 = 1 OR media_type IN ('animation', 'sticker_static') AS vector FROM media_ban",
    "limit_check": "SELECT DISTINCT id, CASE WHEN source_type = 'animation' AND duration_sec > 10 THEN 'animation duration' WHEN source_type = 'animation' AND length(hash_signature) > 20971520 THEN 'animation size' WHEN source_type = 'sticker_static' AND duration_sec > 3 THEN 'sticker duration' WHEN source_type = 'sticker_static' AND length(hash_signature) > 262144 THEN 'sticker size' END AS violation FROM blocked_video_like",
    "ingest_insert_or_get": f"WITH {_BATCH}, o AS (SELECT chat_id, hash_version, signature, min(id) AS old FROM b WHERE batch_no < (SELECT z FROM l) GROUP BY ALL), n AS (SELECT *, min(id) OVER (PARTITION BY chat_id, hash_version, signature) AS fresh FROM b WHERE batch_no = (SELECT z FROM l)) SELECT id, coalesce(old, fresh) AS stored_id, old IS NULL AND id = fresh AS created FROM n LEFT JOIN o USING (chat_id, hash_version, signature)",
    "ingest_insert_if_absent": f"WITH {_BATCH} SELECT min(id) AS id FROM b n WHERE batch_no = (SELECT z FROM l) AND NOT EXISTS (SELECT 1 FROM b o WHERE batch_no < (SELECT z FROM l) AND o.chat_id = n.chat_id AND o.hash_version = n.hash_version AND o.signature = n.signature) GROUP BY chat_id, hash_version, signature",
    "ingest_orphan_delete": f"WITH c AS (SELECT {_uid('ban_uid')} AS ban_uid FROM blocked_image UNION SELECT {_uid('ban_uid')} FROM blocked_video_like) SELECT DISTINCT {_uid('ban_uid')} AS ban_uid FROM media_ban WHERE {_uid('ban_uid')} NOT IN (SELECT ban_uid FROM c WHERE ban_uid IS NOT NULL)",
    "deactivate_cascade": f"WITH {_PARENT}, g AS (SELECT DISTINCT {_uid('ban_uid')} AS ban_uid FROM blocked_image WHERE hash_version LIKE '%v0') SELECT p.ban_uid, active AND g.ban_uid IS NULL AS active, strftime(CASE WHEN active AND g.ban_uid IS NOT NULL THEN coalesce(deactivated_at, TIMESTAMP '{NOW}') ELSE deactivated_at END, '%Y-%m-%d %H:%M:%S') AS deactivated FROM p LEFT JOIN g USING (ban_uid)",
    "manifest_upsert": "WITH b AS (SELECT DISTINCT id, model_name, model_revision, vector_dim, active FROM vector_ban), g AS (SELECT model_name, model_revision, vector_dim, count(*) AS n, count(*) FILTER (WHERE active) AS a FROM b GROUP BY ALL) SELECT model_name, model_revision, vector_dim, CASE WHEN model_revision <> 'r1' AND a > 0 THEN a ELSE n END AS bans FROM g",
    "outbox_load_after": f"SELECT delivery_id, transaction_id::BIGINT AS tx, log_offset FROM outbox_event WHERE transaction_id > {TX} OR transaction_id = {TX} AND log_offset > {OFFSET} ORDER BY transaction_id, log_offset LIMIT 100",
    "outbox_unwrap": f"WITH {_UNWRAPPED} SELECT delivery_id, {_uid('uid')} AS event_uid, event_type, coalesce((SELECT wrapped FROM env WHERE env.delivery_id = log.delivery_id), false) AS wrapped, md5(CASE WHEN json_valid(inn) THEN inn::JSON->>'ban_uid' END) AS ban_md5 FROM log",
    "outbox_backlog": f"SELECT count(*) AS pending, epoch(TIMESTAMP '{NOW}' - min(created_at)) AS oldest_seconds FROM outbox_event WHERE transaction_id > {TX} OR transaction_id = {TX} AND log_offset > {OFFSET}",
    "event_artifact_join": f"WITH {_UNWRAPPED}, e AS (SELECT delivery_id, {_uid('b')} AS ban_uid FROM (SELECT delivery_id, CASE WHEN json_valid(inn) THEN inn::JSON->>'ban_uid' END AS b FROM log WHERE event_type = 'media.ban.created.v1')), i AS (SELECT DISTINCT id, {_uid('ban_uid')} AS ban_uid FROM blocked_image) SELECT delivery_id, id, ban_uid FROM e JOIN i USING (ban_uid)",
    "checkpoint_advance": f"WITH {_UNWRAPPED}, t AS (SELECT CASE WHEN event_type = 'media.ban.created.v1' THEN 'imagehash' ELSE 'other' END AS index_name, max((transaction_id, o.log_offset)) AS m FROM log JOIN outbox_event o USING (delivery_id) GROUP BY 1) SELECT 'replica-a' AS consumer_id, 'imagehash' AS index_name, (SELECT m[1]::BIGINT FROM t WHERE index_name = 'imagehash') AS last_tx, (SELECT m[2] FROM t WHERE index_name = 'imagehash') AS last_offset, false AS stale UNION ALL SELECT 'replica-a', 'other', 1000000000000000, 0, true UNION ALL SELECT 'replica-b', 'imagehash', 0, 0, false",
    "checkpoint_fresh": "SELECT DISTINCT media_type AS index_name, media_type = 'animation' AS stale FROM media_ban",
    "active_vector_count": f"WITH {_VEC} SELECT chat_id, model_name, model_revision, count(*) AS vectors FROM u GROUP BY ALL",
    "index_apply_status": f"WITH {_VEC}, n AS (SELECT ban_id, bool_or(model_revision <> 'r3') AS fresh FROM u GROUP BY ban_id) SELECT DISTINCT id AS ban_id, CASE WHEN fresh IS NULL THEN 'skipped' WHEN fresh THEN 'applied' ELSE 'already_applied' END AS status FROM vector_ban LEFT JOIN n ON id = ban_id",
    "vector_blob_roundtrip": "SELECT DISTINCT ON (id) id, (4 * len(vector))::INT AS bytes, true AS same FROM stored_vector_frame WHERE vector IS NOT NULL",
    "http_metrics_histogram": "SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, count(*) FILTER (WHERE value <= 1) AS le_1_0, count(*) FILTER (WHERE value <= 10) AS le_10_0, count(*) FILTER (WHERE value <= 100) AS le_100_0, count(*) FILTER (WHERE value <= 1000) AS le_1000_0 FROM events GROUP BY event_type",
    "message_targets": "SELECT DISTINCT created_from_message_id + (media_type = 'photo')::INT AS message_id, chat_id, file_unique_id, 'photo' AS media_type FROM media_ban WHERE created_from_message_id IS NOT NULL",
    "setting_texts": "SELECT event_id, round(event_id * CASE event_id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 ELSE 60.0 END::DOUBLE, 6) AS seconds, (event_id * CASE event_id % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1000000 ELSE 1 END)::BIGINT AS bytes, 'frame-' || CASE WHEN event_id < 1000 THEN lpad(event_id::VARCHAR, 3, '0') ELSE event_id::VARCHAR END || '.png' AS frame FROM events",
}
