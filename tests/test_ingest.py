import pytest
from pyspark.sql import functions as F

from siftlane import schemas
from siftlane.operators import index, ingest, progress
from siftlane.sources import artifacts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_or_get(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "a")], "id BIGINT, chat BIGINT, s STRING")
    new = spark.createDataFrame([(5, 10, "a"), (6, 10, "b"), (7, 10, "b"), (8, 20, "a")], "id BIGINT, chat BIGINT, s STRING")
    got = ingest.insert_or_get(new, old, ["chat", "s"]).select("id", "stored_id", "created")
    assert rows(got) == [(5, 1, False), (6, 6, True), (7, 6, False), (8, 8, True)]
    assert rows(ingest.insert_if_absent(new, old, ["chat", "s"], ["id"]).select("id")) == [(6,), (8,)]
    assert ingest.insert_or_get(new.limit(0), old, ["chat", "s"]).count() == 0


def test_children_and_orphans(spark):
    p = spark.createDataFrame([(1, [5, 6]), (2, None)], "id BIGINT, hs ARRAY<BIGINT>")
    have = spark.createDataFrame([(1, 0)], "id BIGINT, variant INT")
    assert rows(ingest.children(p, "id", "hs", "variant", "hash", have)) == [(1, 1, 6)]
    bans = spark.createDataFrame([("a",), ("b",), ("c",)], "ban_uid STRING")
    kids = [spark.createDataFrame([(x,)], "ban_uid STRING") for x in ("a", None)]
    assert rows(ingest.without_children(bans, "ban_uid", *kids)) == [("b",), ("c",)]


def test_deactivate_twice_changes_nothing(spark):
    d = spark.createDataFrame([(1, True), (2, False), (3, None)], "id BIGINT, active BOOLEAN").withColumns({"updated_at": F.lit(None).cast("timestamp"), "deactivated_at": F.lit(None).cast("timestamp")})
    once = ingest.deactivate(d, F.col("id") <= 2, F.lit("2026-01-01").cast("timestamp"))
    twice = ingest.deactivate(once, F.col("id") <= 2, F.lit("2027-01-01").cast("timestamp"))
    assert rows(once) == rows(twice) and [r.active for r in once.orderBy("id").collect()] == [False, False, None]
    assert once.filter("deactivated_at is not null").count() == 1


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k INT, v STRING")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k INT, v STRING")
    assert rows(ingest.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]


def test_ingest_announces_only_what_is_new(spark):
    bans = spark.createDataFrame([("u1", 10, "photo", "f1"), ("u2", 10, "photo", "f2"), ("u3", 10, "photo", "f3")], "ban_uid STRING, chat_id BIGINT, media_type STRING, file_unique_id STRING")
    exact = spark.createDataFrame([(10, "f1")], "chat_id BIGINT, file_unique_id STRING")
    image = spark.createDataFrame([(10, "s1")], "chat_id BIGINT, sig STRING")
    prints = {"exact": bans.select("ban_uid", "chat_id", "file_unique_id"), "image": spark.createDataFrame([("u1", 10, "s1"), ("u2", 10, "s1")], "ban_uid STRING, chat_id BIGINT, sig STRING")}
    parents, appended, events = ingest.ingest(bans, {"exact": exact, "image": image}, {"exact": ["chat_id", "file_unique_id"], "image": ["chat_id", "sig"]}, prints)
    assert rows(parents.select("ban_uid")) == [("u2",), ("u3",)] and appended["image"].count() == 0
    from siftlane.sources.outbox import unwrap

    back = unwrap(events.withColumn("metadata", F.lit(None).cast("string")))
    assert rows(back.select("event_uid", "event_type", "aggregate_uid", F.get_json_object("inner", "$.file_unique_id"))) == [("u2", "media.ban.created.v1", "u2", "f2"), ("u3", "media.ban.created.v1", "u3", "f3")]


def test_events_need_their_fields(spark):
    d = spark.createDataFrame([("u", "", "a", "b", "{}")], "event_uid STRING, event_type STRING, aggregate_type STRING, aggregate_uid STRING, payload STRING")
    with pytest.raises(Exception, match="required field"):
        ingest.outbox_rows(d).collect()


CHECKPOINT = "consumer_id STRING, index_name STRING, last_tx DECIMAL(20,0), last_offset BIGINT, stale BOOLEAN, stale_reason STRING"


def test_checkpoints(spark):
    from decimal import Decimal

    c = spark.createDataFrame([("a", "x", Decimal(5), 2, True, "r"), ("a", "y", Decimal(1), 1, True, "r")], CHECKPOINT)
    applied = spark.createDataFrame([("a", "x", 5, 1), ("a", "y", 10, 1), ("a", "y", 9, 7)], "consumer_id STRING, index_name STRING, tx BIGINT, off BIGINT")
    got = progress.advance(c, applied)
    assert [(r.index_name, int(r.last_tx), r.last_offset, r.stale, r.stale_reason) for r in got.orderBy("index_name").collect()] == [("x", 5, 2, True, "r"), ("y", 10, 1, False, None)]
    wanted = spark.createDataFrame([("a", "x"), ("a", "z")], "consumer_id STRING, index_name STRING")
    assert rows(progress.freshness(c, wanted)) == [("x", True), ("z", False)]
    assert not progress.is_ready(c, wanted) and progress.is_ready(c, wanted.filter("index_name = 'z'"))
    assert progress.mark_stale(got, F.col("index_name") == "y", "failed").filter("stale and stale_reason = 'failed'").count() == 1
    with pytest.raises(ValueError):
        progress.mark_stale(c, F.lit(True), " ")


def test_index_snapshot(spark, tmp_path):
    v = spark.createDataFrame([(1, 7, 10, "m", "r", 0, [1.0, 0.0]), (2, 7, 10, "m", "r", 1, [0.0, 2.0])], "frame_id BIGINT, ban_id BIGINT, chat_id BIGINT, model_name STRING, model_revision STRING, frame_index INT, vector ARRAY<FLOAT>")
    path = str(tmp_path / "index")
    assert index.load_or_rebuild(spark, v, path)[1]
    m = index.read_manifest(spark, path)
    again, rebuilt = index.load_or_rebuild(spark, v, path)
    assert not rebuilt and again.count() == m["count"] == 2
    changed = v.withColumn("vector", F.when(F.col("frame_id") == 1, F.array(F.lit(0.5).cast("float"), F.lit(0.5).cast("float"))).otherwise(F.col("vector")))
    assert index.load_or_rebuild(spark, changed, path)[1]
    m2 = index.read_manifest(spark, path)
    assert m2["count"] == m["count"] and m2["digest"] != m["digest"]
    for f in (tmp_path / "index").rglob("*.parquet"):
        f.write_bytes(b"garbage")
    for f in (tmp_path / "index").rglob(".*.parquet.crc"):
        f.unlink()
    assert index.load_or_rebuild(spark, changed, path)[1]
    assert index.content_digest(v) == index.content_digest(v.orderBy(F.desc("frame_id")).repartition(3))


def test_apply_events(spark):
    s = "frame_id BIGINT, ban_id BIGINT, frame_index INT"
    v, have = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 8, 0)], s), spark.createDataFrame([(1, 7, 0), (2, 7, 1)], s)
    added, status = index.apply_events(have, v, spark.createDataFrame([(7,), (8,), (9,), (9,)], "ban_id BIGINT"))
    assert rows(status) == [(7, "already_applied"), (8, "applied"), (9, "skipped")] and added.count() == 1


def test_schemas(spark):
    d = spark.createDataFrame([("1", "u", "x"), ("1", "u", "y")], "id STRING, ban_uid STRING, other STRING")
    c = schemas.conformed(d, "blocked_image")
    assert c.schema == schemas.schema("blocked_image")
    assert rows(schemas.key_violations(c, "blocked_image")) == [("id|1", 2)]
    assert all(schemas.schema(t) for t in schemas.TABLES)


def test_vector_bans_are_checked_and_found_by_signature(spark):
    schema = "id BIGINT, chat_id BIGINT, model_name STRING, model_revision STRING, vector_signature STRING, vector_dim INT, frames ARRAY<STRUCT<frame_index: INT, position_millis: INT, vector: ARRAY<FLOAT>>>"
    f = lambda i, ms, *v: (i, ms, list(v))
    good = [(1, 5, "m", "r", "s1", 2, [f(0, 0, 1.0, 0.0)]), (2, 5, "m", "r", "s2", 2, [f(0, 0, 0.0, 1.0)]), (3, 5, "m", "r", "s2", 2, [f(0, 0, 0.0, 1.0)])]
    bad = {"no chat or model": (5, None, "m", "r", "x", 2, [f(0, 0, 1.0, 1.0)]), "no dimension": (5, 5, "m", "r", "x", 0, [f(0, 0)]), "no frames": (5, 5, "m", "r", "x", 2, []), "frame index below 0": (5, 5, "m", "r", "x", 1, [f(-1, 0, 1.0)]), "position below 0": (5, 5, "m", "r", "x", 1, [f(0, None, 1.0)]), "frame index repeats": (5, 5, "m", "r", "x", 1, [f(0, 0, 1.0), f(0, 1, 1.0)]), "vector of another dimension": (5, 5, "m", "r", "x", 2, [f(0, 0, 1.0)])}
    d = spark.createDataFrame([*good, *bad.values()], schema)
    assert [r[0] for r in d.select(ingest.vector_ban_violation()).collect()] == [None] * 3 + list(bad)
    have = spark.createDataFrame([(90, 5, "m", "r", "s1")], "id BIGINT, chat_id BIGINT, model_name STRING, model_revision STRING, vector_signature STRING")
    got = {r.id: (r.stored_id, r.created) for r in ingest.insert_vector_bans(spark.createDataFrame(good, schema), have).collect()}
    assert got == {1: (90, False), 2: (2, True), 3: (2, False)}
    with pytest.raises(Exception, match="no frames"):
        ingest.insert_vector_bans(spark.createDataFrame([bad["no frames"]], schema), have).collect()


def test_videos_need_frames_and_a_version(spark):
    schema = "id BIGINT, chat_id BIGINT, hash_version STRING, frames ARRAY<STRUCT<frame_index: INT, position_millis: INT, hash: BIGINT>>"
    none = spark.createDataFrame([], "id BIGINT, chat_id BIGINT, hash_version STRING, hash_signature STRING")
    d = ingest.insert_videos(spark.createDataFrame([(1, 5, " ", [(0, 0, -1)]), (2, 5, None, [(0, 0, -1)])], schema), none, "w1")
    assert {(r.id, r.hash_version, r.hash_signature, r.stored_id, r.created) for r in d.collect()} == {(1, "w1", "0:0:18446744073709551615", 1, True), (2, "w1", "0:0:18446744073709551615", 1, False)}
    with pytest.raises(Exception, match="no frames"):
        ingest.insert_videos(spark.createDataFrame([(1, 5, "w1", [])], schema), none).collect()


def test_unit_of_work(spark, tmp_path):
    folder = str(tmp_path)
    first = ingest.unit_of_work(spark, folder, {"a": spark.range(3), "b": spark.range(5)})
    second = ingest.unit_of_work(spark, folder, {"a": spark.range(4)})
    assert spark.read.parquet(second["a"]).count() == 4 and second["b"] == first["b"]
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        ingest.unit_of_work(spark, folder, {"a": spark.range(9), "b": broken})
    assert len(list((tmp_path / "a").iterdir())) == 2


def test_frames_that_do_not_fit_their_ban(spark):
    frames = spark.createDataFrame([(1, 7, [1.0, 2.0]), (2, 7, [1.0]), (3, 8, [1.0]), (4, 7, None)], "id BIGINT, ban_id BIGINT, vector ARRAY<FLOAT>")
    bans = spark.createDataFrame([(7, 2)], "id BIGINT, vector_dim INT")
    assert {tuple(r) for r in artifacts.frame_violations(frames, bans).collect()} == {(2, "other length"), (3, "no ban"), (4, "no vector")}


def test_stale_indexes_are_counted(spark):
    cp = spark.createDataFrame([("c", "x", True), ("c", "y", False), ("d", "x", True)], "consumer_id STRING, index_name STRING, stale BOOLEAN")
    assert progress.of_indexes(cp, "c", ["x", "z"]).count() == 1
    progress.require_fresh(cp, "c", ["y"])
    with pytest.raises(RuntimeError, match="1 stale"):
        progress.require_fresh(cp, "c", ["x", "y"])


def test_migrations_up_and_down(spark, tmp_path):
    folder = str(tmp_path / "db")
    assert schemas.migrate(spark, folder, 3) == 3 and schemas.migrate(spark, folder) == len(schemas.TABLES)
    first, last = next(iter(schemas.TABLES)), list(schemas.TABLES)[-1]
    assert spark.read.parquet(f"{folder}/{last}").schema == schemas.schema(last)
    assert schemas.migrate(spark, folder, 1) == 1 and {p.name for p in (tmp_path / "db").iterdir()} == {first, "version"}
    with pytest.raises(ValueError):
        schemas.migrate(spark, folder, 99)
