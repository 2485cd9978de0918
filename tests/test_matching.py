import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.operators import approximate, matching, media

FRAMES = "id BIGINT, chat_id BIGINT, hash_version STRING, frames ARRAY<STRUCT<frame_index: INT, position_millis: INT, hash: BIGINT>>"


def video(id_, hashes, chat=3, version="w1"):
    return (id_, chat, version, [(k, 250 * k, h) for k, h in enumerate(hashes)])


def test_exact(spark):
    block = spark.createDataFrame([(10, "f")], "chat_id BIGINT, file_unique_id STRING")
    items = spark.createDataFrame([(1, 10, "f"), (2, 20, "f"), (3, 10, ""), (4, 10, None), (1, 10, "f")], "id BIGINT, chat_id BIGINT, file_unique_id STRING")
    assert {r.id for r in matching.exact_blocked(items, block).collect()} == {1}
    assert matching.exact_blocked(items, block.limit(0)).count() == 0


IMAGES = "id BIGINT, chat_id BIGINT, hashes ARRAY<BIGINT>"


def test_images(spark):
    s = spark.createDataFrame([(70, 5, [0b1010_0101]), (71, 5, None), (72, 5, []), (73, None, [1])], IMAGES)
    q = spark.createDataFrame([(1, 5, [0b1010_0101]), (2, 6, [0b1010_0101]), (3, 5, [0b1010_0111]), (4, 5, None), (5, 5, [None, 0b1010_0101]), (6, None, [1])], IMAGES)
    ids = lambda **k: {r.id for r in matching.image_blocked(q, s, **k).collect()}
    assert ids(bits=0) == {1, 5} and ids(bits=1) == {1, 3, 5}
    assert {(r.id, r.distance) for r in matching.image_distances(q, s).collect()} == {(1, 0), (3, 1), (5, 0)}
    assert matching.image_blocked(s, s, itself=False).count() == 0


def brute_videos(q, s, bits, ratio, least=2):
    """The rule, pair by pair and frame by frame."""
    out = set()
    for i, chat, version, frames in q:
        for j, chat_, version_, frames_ in s:
            if (chat, version) != (chat_, version_) or not frames or not frames_:
                continue
            near = sum(any(((f[2] ^ g[2]) & (2**64 - 1)).bit_count() <= bits for g in frames_) for f in frames)
            small = min(len(frames), len(frames_))
            need = max(least, int(np.ceil(ratio * small)))
            if near >= need and small >= need:
                out.add((i, j, near, near / small))
    return out


@pytest.mark.parametrize(("cell", "step"), [(20_000, 4_000_000), (3, 5)])
def test_videos_against_the_rule(spark, monkeypatch, cell, step):
    """Random videos of 0 to 9 frames from few hashes, in two chats and versions; cells and steps of few rows, too."""
    monkeypatch.setattr(matching, "CELL", cell)
    monkeypatch.setattr(matching, "STEP", step)
    rng = np.random.default_rng(12)
    pool = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    make = lambda k: video(k, [pool[int(rng.integers(0, 6))] ^ int(1 << rng.integers(0, 60)) for _ in range(int(rng.integers(0, 10)))], int(rng.integers(1, 3)), f"w{int(rng.integers(1, 3))}")
    q, s = [make(k) for k in range(12)], [make(100 + k) for k in range(25)]
    for bits, ratio in ((0, 0.3), (2, 0.4), (2, 0.9)):
        got = matching.video_matches(spark.createDataFrame(q, FRAMES), spark.createDataFrame(s + s[:3], FRAMES), bits=bits, min_ratio=ratio).collect()
        assert {(r.q_id, r.s_id, r.matched_frames, r.matched_ratio) for r in got} == brute_videos(q, s, bits, ratio)
        assert len(got) == len({(r.q_id, r.s_id) for r in got})
    assert matching.video_matches(spark.createDataFrame(s, FRAMES), spark.createDataFrame(s[:1], FRAMES), itself=False).filter("q_id = s_id").count() == 0


def test_reported_frames_stop_at_the_rule(spark):
    q, s = (spark.createDataFrame([video(k, range(10))], FRAMES) for k in (1, 2))
    r = matching.video_matches(q, s, bits=0).first()
    assert (r.matched_frames, r.reported_frames, r.reported_ratio) == (10, 4, 0.4)


def test_first_match(spark):
    q, s = spark.createDataFrame([video(1, [1, 2])], FRAMES), spark.createDataFrame([video(k, [1, 2]) for k in (5, 3, 9)], FRAMES)
    assert [tuple(r) for r in matching.first_match(matching.video_matches(q, s, bits=0)).collect()] == [(1, 3)]


STORED = "frame_id BIGINT, ban_id BIGINT, frame_index INT, chat_id BIGINT, model_name STRING, model_revision STRING, vector ARRAY<FLOAT>"
ASKED = "query_id BIGINT, chat_id BIGINT, model_name STRING, model_revision STRING, vector ARRAY<FLOAT>"


def test_top_k(spark):
    s = spark.createDataFrame([(1, 4, 0, 10, "m", "r", [0.0, 2.0]), (2, 4, 1, 10, "m", "r", [3.0, 0.0]), (3, 9, 0, 20, "m", "r", [0.0, 1.0]), (5, 9, 0, 10, "m", "r", [0.0, 0.0]), (6, 9, 0, 10, "m", "r", [1.0, float("nan")]), (7, 9, 0, 10, "m", "r", [1.0, 1.0, 1.0])], STORED)
    q = lambda chat: spark.createDataFrame([(1, chat, "m", "r", [0.2, 0.8])], ASKED)
    top = sorted(matching.vector_top_k(q(10), s, 2).collect(), key=lambda r: -r.score)
    assert [(r.ban_id, r.frame_index) for r in top] == [(4, 0), (4, 1)] and top[0].score == round(0.8 / (0.2**2 + 0.8**2) ** 0.5, 6)
    assert [r.ban_id for r in matching.vector_top_k(q(20), s, 5).collect()] == [9]
    assert matching.vector_top_k(q(30), s, 5).count() == 0 and matching.vector_top_k(q(10), s.limit(0), 5).count() == 0
    assert matching.vector_top_k(q(10).withColumn("own_ban", F.lit(4)), s, 5, itself=False).count() == 0
    with pytest.raises(ValueError):
        matching.vector_top_k(q(10), s, 0)


def clustered(spark, n, rng, dim=16):
    centres = rng.standard_normal((40, dim))
    x = centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, dim))
    x[n // 2 : n // 2 + 30] = x[0]  # ties
    return x, spark.createDataFrame([(k, k // 3, k % 3, 1 if k % 3 else 2, "m", "r", [float(v) for v in r]) for k, r in enumerate(x)], STORED)


def exact_top(x, chats, k):
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    out = {}
    for i in range(0, len(x), 50):
        same = np.flatnonzero(chats == chats[i])
        score = np.round(u[same] @ u[i], 6)
        out[i] = set(same[np.lexsort((same, -score))[:k]].tolist())
    return out


def test_top_k_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(matching, "CELL", 70)
    monkeypatch.setattr(matching, "STEP", 300)
    x, s = clustered(spark, 600, np.random.default_rng(3))
    q = s.filter("frame_id % 50 = 0").withColumnRenamed("frame_id", "query_id")
    got = {}
    for r in matching.vector_top_k(q, s, 5).collect():
        got.setdefault(r.query_id, set()).add(r.frame_id)
    assert got == exact_top(x, np.array([1 if k % 3 else 2 for k in range(600)]), 5)


def test_approximate_recall(spark):
    x, s = clustered(spark, 6000, np.random.default_rng(4))
    q = s.filter("frame_id % 50 = 0").withColumnRenamed("frame_id", "query_id")
    want = exact_top(x, np.array([1 if k % 3 else 2 for k in range(6000)]), 5)
    p = approximate.Parameters(lists=64, probes=8, exact=3000)  # one chat is above, the other below
    got = {(r.query_id, r.frame_id) for r in approximate.approximate_top_k(q, s, 5, p).collect()}
    recall = lambda of: sum((i, j) in got for i in of for j in want[i]) / sum(len(want[i]) for i in of)
    assert recall([i for i in want if i % 3]) >= 0.9 and recall([i for i in want if i % 3 == 0]) == 1
    with pytest.raises(ValueError):
        approximate.Parameters(lists=0)
    with pytest.raises(ValueError):
        approximate.approximate_top_k(q, s.unionByName(s.limit(1).withColumn("vector", F.array(F.lit(1.0).cast("float")))))


def test_votes(spark):
    hits = spark.createDataFrame([(1, 0, 10, 0.95), (1, 1, 10, 0.94), (1, 2, 11, 0.96), (1, 0, 10, 0.93)], "item_id BIGINT, frame INT, ban_id BIGINT, score DOUBLE")
    checked = spark.createDataFrame([(1, 3)], "item_id BIGINT, checked_frames INT")
    assert [tuple(r) for r in matching.frame_vote(hits, checked).collect()] == [(1, 10, 2)]
    assert matching.frame_vote(hits, checked.withColumn("checked_frames", F.lit(6))).count() == 0
    assert matching.static_vote(hits).first().blocked and not matching.static_vote(hits, 0.97).first().blocked


def test_cascade(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id BIGINT")
    errors = spark.createDataFrame([(3, "video"), (1, "video")], "id BIGINT, tier STRING")
    got = matching.cascade(ids(1, 2, 3, 4, 4), [("exact", ids(1)), ("image", ids(1, 2)), ("video", ids(2)), ("vector", ids(3))], errors).collect()
    assert {tuple(r) for r in got} == {(1, "blocked", "exact"), (2, "blocked", "image"), (3, "error", "video"), (4, "clean", None)}


def test_tiers_are_given_what_is_left(spark):
    seen = []
    tier = lambda *x: lambda left: seen.append(sorted(r.id for r in left.collect())) or left.filter(F.col("id").isin(*x)).select("id")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id BIGINT, v STRING")
    got = matching.cascade(items, [("x", tier(1)), ("y", tier(1, 3))])
    assert {tuple(r) for r in got.collect()} == {(1, "blocked", "x"), (3, "blocked", "y"), (2, "clean", None)} and seen == [[1, 2, 3], [2, 3]]


ROUTES = [
    ("photo", "a.jpg", (True, True, False, True)),
    ("photo", "a.mp4", (True, False, False, False)),
    ("animation", "a.mp4", (True, False, True, True)),
    ("sticker_static", "a.webm", (True, False, True, True)),
    ("sticker_static", "a.webp", (True, True, False, True)),
    ("sticker_animated", "a.tgs", (True, False, False, False)),
    ("video", "a.mp4", (False, False, False, False)),
]


def test_routes(spark):
    d = spark.createDataFrame([(m, p) for m, p, _ in ROUTES], "media_type STRING, path STRING")
    assert [tuple(r[0]) for r in d.select(media.routes()).collect()] == [w for _, _, w in ROUTES]


def test_limits(spark):
    rows = [("animation", "x", 10, 20971520), ("animation", "x", 11, 1), ("animation", "x", 1, 20971521), ("sticker_static", "a.webp", 4, 1), ("sticker_static", "a.webm", 3, 262145), ("sticker_static", "a.webp", None, 262145)]
    d = spark.createDataFrame(rows, "media_type STRING, path STRING, duration_sec INT, size_bytes BIGINT")
    assert [r[0] for r in d.select(media.limit_violation()).collect()] == [None, "animation duration", "animation size", "sticker duration", "sticker size", None]
