import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siftlane.operators import messages
from siftlane.sources.outbox import CREATED
from siftlane.streaming import catchup

LOG = "transaction_id DECIMAL(20,0), log_offset BIGINT, msg_uuid STRING, payload BINARY, metadata STRING"


def event(tx, off, ban, kind=CREATED):
    inner = json.dumps({"ban_uid": ban, "chat_id": 10, "file_unique_id": "f-" + ban}).encode()
    return (Decimal(tx), off, f"{tx}-{off}", inner, json.dumps({"event_type": kind}))


@pytest.fixture()
def follow(spark, tmp_path):
    log = str(tmp_path / "log")

    def add(*events):
        spark.createDataFrame(list(events), LOG).coalesce(1).write.mode("append").parquet(log)

    def run(name="x", apply=catchup.applied):
        target = str(tmp_path / name)
        q = catchup.follow(catchup.log_stream(spark, log), target, f"{target}-progress", apply)
        q.awaitTermination(120)
        return catchup.snapshot(spark, target)

    add.log, run.dir = log, tmp_path
    return add, run


def bans(df):
    return sorted((r.ban_uid, int(r.tx), r.off) for r in df.collect())


def test_catch_up_and_replay(follow):
    add, run = follow
    add(event(1, 1, "a"), event(1, 2, "b", "unrelated"), event(2, 1, "c"))
    assert bans(run()) == [("a", 1, 1), ("c", 2, 1)]
    add(event(3, 1, "a"), event(3, 2, "d"), event(3, 3, "d"))
    assert bans(run()) == [("a", 1, 1), ("c", 2, 1), ("d", 3, 2)]
    assert bans(run()) == bans(run("y"))  # an index that starts later gets the same


def test_parts_are_merged_and_batches_replaced(spark, tmp_path):
    target = str(tmp_path / "p")
    run = catchup.projection(target, lambda b: b, ["ban_uid"])
    rows = lambda *x: spark.createDataFrame([(u, Decimal(1), k) for k, u in enumerate(x)], "ban_uid STRING, tx DECIMAL(20,0), off BIGINT")
    run(rows(), 0)
    assert catchup.snapshot(spark, target).count() == 0
    for k in range(1, 20):
        run(rows(f"a{k}", f"a{k // 2}", "same"), k)
    run(rows("a19", "b"), 19)  # the same batch again, with other rows
    assert sorted(r.ban_uid for r in catchup.snapshot(spark, target).collect()) == sorted(["same", "b", *(f"a{k}" for k in range(20))])
    assert len(catchup._state(spark, target)["parts"]) < 10


def test_settled_checkpoints(spark):
    have = spark.createDataFrame([("c", "x", Decimal(1), 1, False, None), ("c", "y", Decimal(1), 1, True, "old"), ("d", "x", Decimal(9), 9, False, None)], "consumer_id STRING, index_name STRING, last_tx DECIMAL(20,0), last_offset BIGINT, stale BOOLEAN, stale_reason STRING")
    got = {(r.consumer_id, r.index_name): (int(r.last_tx), r.stale, r.stale_reason) for r in catchup.settled(have, "c", ["x", "y", "z"], {"x": "down"}, 5, 2).collect()}
    assert got == {("c", "x"): (1, True, "down"), ("c", "y"): (5, False, None), ("c", "z"): (5, False, None), ("d", "x"): (9, False, None)}


def test_live_only_after_catch_up(spark, follow):
    add, run = follow
    add(event(1, 1, "a"))
    at = lambda n: (str(run.dir / n), str(run.dir / f"{n}-progress"))
    bad = lambda b: catchup.applied(b).select("ban_uid", F.raise_error(F.lit("down")).alias("v"))
    with pytest.raises(RuntimeError, match="bad: "):
        catchup.catch_up_then_follow(catchup.log_stream(spark, add.log), {"bad": (*at("bad"), bad)}, seconds=60)
    assert not spark.streams.active
    live = catchup.catch_up_then_follow(catchup.log_stream(spark, add.log), {"good": (*at("good"), catchup.applied)}, "1 second", 60)
    add(event(2, 1, "b"))
    live["good"].processAllAvailable()
    live["good"].stop()
    assert bans(catchup.snapshot(spark, at("good")[0])) == [("a", 1, 1), ("b", 2, 1)]


def test_forwarding_is_at_least_once(spark, follow):
    add, run = follow
    add(event(1, 1, "a"), event(1, 2, "b", "other"))
    sent, failures = [], [1]

    def send(rows, number):
        sent.extend((r.topic, r.event_uid) for r in rows.collect())
        if failures.pop() if failures else 0:
            raise RuntimeError("broker gone")

    start = lambda: catchup.forward(catchup.log_stream(spark, add.log), str(run.dir / "sent"), send)
    catchup.with_restarts(start, wait=0.1)
    assert set(sent) == {(CREATED, "1-1"), ("other", "1-2")} and len(sent) == 4
    with pytest.raises(Exception, match="broker gone"):
        failures.extend([1, 1, 1])
        add(event(2, 1, "c"))
        catchup.with_restarts(start, attempts=2, wait=0.1)


def test_messages_arrive_as_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"message_id": 1, "chat": {"id": 5}, "photo": [{"file_id": "p", "file_unique_id": "u"}]}\nnot json\n')
    out = []
    q = messages.updates(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in messages.targets(messages.normalized(b)).collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert out == [(1, 5, "u", "photo")]


def test_predicates_of_messages(spark):
    d = spark.createDataFrame([("ban", "private", ("f", "u", "photo")), (None, "supergroup", ("", "", "")), ("", None, None)], "command STRING, chat_type STRING, content STRUCT<file_id: STRING, file_unique_id: STRING, type: STRING>")
    c = F.col("content")
    got = [tuple(r) for r in d.select(messages.can_download(c), messages.is_zero(c), messages.is_command("command"), messages.is_command("command", "ban"), messages.is_private("chat_type")).collect()]
    assert got == [(True, False, True, True, True), (False, True, False, False, False), (False, True, False, False, False)]


def test_failed_batch_is_taken_again(follow):
    add, run = follow
    add(event(1, 1, "a"))

    def fails(batch):
        return catchup.applied(batch).withColumn("ban_uid", F.raise_error(F.lit("broken")).cast("string"))

    with pytest.raises(Exception, match="broken"):
        run("z", fails)
    assert bans(run("z")) == [("a", 1, 1)]


def test_snapshot_and_log_may_overlap(spark, follow):
    add, run = follow
    add(event(1, 1, "a"), event(1, 2, "b"))
    run()
    base = spark.createDataFrame([("a", 10, "f-a", Decimal(1), 1)], "ban_uid STRING, chat_id BIGINT, file_unique_id STRING, tx DECIMAL(20,0), off BIGINT")
    assert bans(catchup.snapshot(spark, str(run.dir / "x"), base)) == [("a", 1, 1), ("b", 1, 2)]


def test_several_indexes(spark, follow):
    add, run = follow
    add(event(1, 1, "a"), event(1, 2, "b"))
    have = spark.createDataFrame([("b",)], "ban_uid STRING")
    bad = lambda b: catchup.applied(b).select(F.col("ban_uid"), F.raise_error(F.lit("down")).alias("v"))
    at = lambda n: (str(run.dir / n), str(run.dir / f"{n}-progress"))
    failed = catchup.catch_up(catchup.log_stream(spark, add.log), {"exact": (*at("exact"), catchup.applied), "image": (*at("image"), lambda b: catchup.applied(b, have)), "bad": (*at("bad"), bad)}, 120)
    assert list(failed) == ["bad"]
    assert bans(catchup.snapshot(spark, at("exact")[0])) == [("a", 1, 1), ("b", 1, 2)] and bans(catchup.snapshot(spark, at("image")[0])) == [("b", 1, 2)]


def test_an_applier_is_given_what_it_supports(spark):
    d = spark.createDataFrame([event(1, 1, "a"), event(1, 2, "b", "other"), event(1, 3, "c", "third")], LOG)
    assert catchup.Applier("x", lambda b: b, (CREATED, "third"))(d).count() == 2
    assert bans(catchup.Applier("x", catchup.applied)(d)) == [("a", 1, 1)]


def test_an_index_out_of_time_is_reported(spark, follow):
    add, run = follow
    add(event(1, 1, "a"))
    at = (str(run.dir / "slow"), str(run.dir / "slow-progress"))
    slow = lambda b: time.sleep(8) or catchup.applied(b)
    assert list(catchup.catch_up(catchup.log_stream(spark, add.log), {"slow": (*at, slow)}, 1)) == ["slow"]
    assert not spark.streams.active


def test_messages(spark):
    photo = lambda *uids: [{"file_id": u, "file_unique_id": u, "file_size": 5} for u in uids]
    raw = [
        {"message_id": 1, "chat": {"id": 10, "type": "supergroup"}, "from": {"id": 7}, "text": "/ban@bot now", "reply_to_message": {"message_id": 2, "photo": photo("s", "l"), "animation": {"file_unique_id": "no"}}},
        {"message_id": 3, "chat": {"id": 10, "type": "private"}, "sticker": {"file_unique_id": "st", "is_animated": True}},
        {"message_id": 4, "chat": {"id": 10}, "sticker": {"file_unique_id": "sv", "is_video": True}},
        {"message_id": 5, "chat": {"id": 10}, "video": {"file_unique_id": "v"}, "text": "hello /ban"},
        {"message_id": 6, "chat": {"id": 10}, "animation": {"file_unique_id": "an", "duration": 3, "mime_type": "video/mp4"}, "photo": []},
    ]
    d = spark.createDataFrame([(json.dumps(x),) for x in raw] + [("broken {",), (None,)], "json STRING")
    got = {r.id: r for r in messages.normalized(d).collect()}
    assert (got[1].command, got[1].reply_to.chat_id, got[1].reply_to.chat_type, got[1].reply_to.content.file_unique_id) == ("ban", 10, "supergroup", "l")
    assert [got[k].content and got[k].content.type for k in range(1, 7) if k != 2] == [None, "sticker_animated", "sticker_static", None, "animation"]
    assert got[5].command is None and got[None].content is None and got[6].content.duration_sec == 3
    targets = {tuple(r) for r in messages.targets(messages.normalized(d)).collect()}
    assert targets == {(2, 10, "l", "photo"), (3, 10, "st", "sticker_animated"), (4, 10, "sv", "sticker_static"), (6, 10, "an", "animation")}
