import base64
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siftlane.operators import delivery, references
from siftlane.operators.skew import heavy_keys, lookup
from siftlane.sources import outbox

LOG = "delivery_id BIGINT, transaction_id DECIMAL(20,0), log_offset BIGINT, msg_uuid STRING, created_at TIMESTAMP_NTZ, payload BINARY, metadata STRING"
U = [f"0000000{k}-0000-4000-8000-000000000000" for k in range(10)]
AT = datetime(2025, 3, 1)


def row(n, payload=b"{}", metadata=None, msg=None, tx=1, offset=None):
    m = metadata if isinstance(metadata, str) or metadata is None else json.dumps(metadata)
    return (n, Decimal(tx), n if offset is None else offset, msg, AT, payload if isinstance(payload, bytes) or payload is None else json.dumps(payload).encode(), m)


def wrapped(inner, topic="media.ban.created.v1", uid="", meta=None):
    return {"destination_topic": topic, "uuid": uid, "payload": base64.b64encode(inner).decode(), "metadata": meta or {}}


def unwrapped(spark, *rows):
    return {r.delivery_id: r for r in outbox.unwrap(spark.createDataFrame(list(rows), LOG)).collect()}


def test_unwrap(spark):
    inner = b'{"ban_uid":"x"}'
    got = unwrapped(
        spark,
        row(1, inner, {"event_uid": U[1], "event_type": "t"}, U[9]),
        row(2, wrapped(inner, uid=U[2], meta={"aggregate_uid": "a"})),
        row(3, wrapped(inner, uid=U[2], meta={"event_uid": U[3]}), None, U[9]),
        row(4, wrapped(inner, uid=U[2]), {"event_uid": ""}, U[4]),
        row(5, wrapped(inner, topic=""), None, ""),
        row(6, b'{"destination_topic":"media', "no json", U[6]),
        row(7, None, None, None),
        row(8, {**wrapped(inner), "payload": "%%%"}),
    )
    assert [got[k].event_uid for k in range(1, 9)] == [U[1], U[2], U[3], U[4], None, U[6], None, None]
    assert [got[k].event_type for k in range(1, 9)] == ["t", *["media.ban.created.v1"] * 3, None, None, None, "media.ban.created.v1"]
    assert [got[k].wrapped for k in range(1, 9)] == [False, True, True, True, False, False, False, True]
    assert got[2].inner == inner.decode() and got[2].aggregate_uid == "a" and got[8].inner is None and got[1].inner == inner.decode()


def test_load_after(spark):
    log = spark.createDataFrame([row(k, tx=t, offset=o) for k, (t, o) in enumerate([(9, 1), (10, 1), (10, 2), (2, 5)])], LOG)
    at = lambda *a: [(int(r.transaction_id), r.log_offset) for r in outbox.load_after(log, *a).collect()]
    assert at(0, 0) == [(2, 5), (9, 1), (10, 1), (10, 2)] and at("9", 1) == [(10, 1), (10, 2)] and at(2, 5, 1) == [(9, 1)]


def test_load_after_reaches_the_scan(spark, data, capsys):
    outbox.load_after(spark.read.parquet(f"{data}/outbox_event.parquet"), 1200, 0).select("delivery_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [Or(" in plan and "payload" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.fixture()
def log_file(spark, tmp_path):
    """Two files with repeated deliveries: one event in several spellings, one twice in one file, one without identifier."""
    d = spark.createDataFrame(
        [
            row(1, b"{}", {"event_uid": U[1]}),
            row(2, b"{}", {"event_uid": U[1].upper()}),
            row(3, wrapped(b"{}", uid="{" + U[1] + "}")),
            row(4, b"{}", None, U[2]),
            row(5, b"{}", None, None),
            row(6, b"{}", None, ""),
            row(7, b"{}", None, "no uuid"),
            row(8, b"{}", None, "no uuid"),
        ],
        LOG,
    )
    path = str(tmp_path / "log.parquet")
    d.repartition(2, "delivery_id").write.parquet(path)
    return path


def test_repeated_deliveries(spark, log_file):
    got = delivery.repeated_deliveries(spark.read.parquet(log_file))
    assert sorted(r.delivery_id for r in got.collect()) == [2, 3, 8]


def test_read_once(spark, log_file):
    kept = delivery.read_once(spark, log_file)
    assert kept.columns == spark.read.parquet(log_file).columns
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 4, 5, 6, 7]


def test_read_once_without_copies_and_empty(spark, tmp_path):
    d = spark.createDataFrame([row(1, msg=U[1]), row(2, msg=U[2])], LOG)
    for name, df, n in (("a", d, 2), ("b", d.limit(0), 0)):
        df.write.parquet(str(tmp_path / name))
        assert delivery.read_once(spark, str(tmp_path / name)).count() == n
        assert delivery.repeated_deliveries(spark.read.parquet(str(tmp_path / name))).count() == 0


@pytest.mark.parametrize("vectors", [1, 2, 100])
def test_files_in_groups_and_folders_with_odd_names(spark, tmp_path, vectors):
    """Files with and without copies, more than one broadcast holds, in folders that tell a column."""
    path = str(tmp_path / "a log%20of x")
    for k in range(6):
        rows = [row(10 * k + j, msg=U[1] if j == 0 and k % 2 else f"m{k}-{j}") for j in range(4)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/day=d {k % 2}/part={k}")
    kept = delivery.read_once(spark, path, vectors=vectors)
    assert {"day", "part"} <= set(kept.columns)
    assert sorted((r.delivery_id, r.day, r.part) for r in kept.collect()) == sorted((10 * k + j, f"d {k % 2}", k) for k in range(6) for j in range(4) if not (j == 0 and k in (3, 5)))


def test_rows_written_twice_keep_one(spark, tmp_path):
    d = spark.createDataFrame([row(1, msg=U[1], payload=b"x" * 5000)] * 3 + [row(2, msg=U[1])], LOG)
    d.write.parquet(str(tmp_path / "c"))
    assert [r.delivery_id for r in delivery.read_once(spark, str(tmp_path / "c")).collect()] == [1]


def test_extra_columns_do_not_clash(spark, tmp_path):
    d = spark.createDataFrame([row(1, msg=U[1]), row(2, msg=U[1])], LOG).withColumns({"event_uid": F.lit("other"), "pos": F.lit(1), "file": F.lit("f"), "ident": F.lit("i"), "n": F.lit(1)})
    d.write.parquet(str(tmp_path / "e"))
    kept = delivery.read_once(spark, str(tmp_path / "e")).collect()
    assert [(r.delivery_id, r.event_uid, r.ident) for r in kept] == [(1, "other", "i")]


def test_vectors_of_many_blocks(spark, tmp_path):
    n = 3 * delivery.BLOCK
    d = spark.range(n).select(F.col("id").alias("delivery_id"), F.lit(None).cast("string").alias("metadata"), F.lit(b"{}").alias("payload"), F.concat(F.lit("u"), F.floor(F.col("id") / 2).cast("string")).alias("msg_uuid"))
    d.coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = delivery.read_once(spark, str(tmp_path / "d"))
    assert kept.count() == n // 2 and kept.filter("delivery_id % 2 = 1").count() == 0


def _targets(spark, *rows):
    return references.targets(spark.createDataFrame(list(rows), "ban_uid STRING, created_at TIMESTAMP_NTZ, deactivated_at TIMESTAMP_NTZ"), "k", F.col("ban_uid"))


def _refs(spark, *rows):
    return references.references(spark.createDataFrame(list(rows), "id BIGINT, r STRING, created_at TIMESTAMP_NTZ"), "s", F.col("r"), "k", F.col("id"))


def test_orphans(spark):
    d = lambda *a: datetime(2025, *a)
    target = _targets(spark, ("a", d(2, 1), None), ("b", d(2, 1), d(2, 10)), ("c", None, None), ("d", d(2, 1), d(2, 5)), ("d", d(3, 1), None), (None, d(1, 1), None))
    refs = _refs(
        spark,
        *[(1, "a", d(2, 1)), (2, "a", d(1, 31)), (3, "a", d(2, 20))],
        *[(4, "b", d(2, 9)), (5, "b", d(2, 10)), (6, "zz", d(2, 9)), (7, None, d(2, 9)), (8, "", d(2, 9))],
        *[(9, "c", d(1, 1)), (10, "c", None), (11, "zz", None), (12, "d", d(2, 6)), (13, "d", d(2, 4)), (14, "d", d(3, 2)), (6, "zz", d(2, 9))],
    )
    got = sorted((int(r.row_key), r.period_ym) for r in references.orphan_rows(refs, target).collect())
    assert got == [(2, 202501), (5, 202502), (6, 202502), (11, None), (12, 202502)]
    report = {(r.src, r.period_ym): (r.n_references, r.n_orphans) for r in references.orphan_report(refs, target).collect()}
    assert report == {("s", 202501): (2, 1), ("s", 202502): (8, 4), ("s", 202503): (1, 0), ("s", None): (2, 1)}
    assert references.orphan_rows(refs.limit(0), target).count() == 0 and references.orphan_rows(refs, target.limit(0)).count() == 12


def test_heavy_keys_are_looked_up(spark, monkeypatch):
    from siftlane.operators import skew

    monkeypatch.setattr(skew, "LEAST", 10)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, F.col("id").cast("string")).alias("k"))
    heavy = heavy_keys(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k is not null"), "k")
    assert [r.k for r in heavy.collect()] == ["hot"]
    target = spark.createDataFrame([("hot", 1), ("250", 2)], "k STRING, v INT")
    got = lookup(rows, target, "k", heavy)
    assert got.count() == 300 and got.filter("v = 1").count() == 200 and got.filter("v = 2").count() == 1
    assert lookup(rows, target, "k", heavy, "inner").count() == 201
