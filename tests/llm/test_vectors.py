import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm import vectors

BANS = "id BIGINT, chat_id BIGINT, model_name STRING, model_revision STRING, vector_dim INT, active BOOLEAN"
FRAMES = "id BIGINT, ban_id BIGINT, vector ARRAY<FLOAT>"


def brute(frames, bans, k=5, least=0.8):
    """The definition, row by row."""
    of = {b[0]: b for b in bans if b[5]}
    use = {}
    for i, b, v in frames:
        if b in of and None not in of[b][1:4] and v is not None and len(v) == of[b][4] and None not in v and np.isfinite(v).all() and np.any(v):
            use[i] = (of[b][1:5], b, np.array(np.float32(v), float))
    out = set()
    for q, (g, b, v) in use.items():
        near = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), n) for n, (h, c, w) in use.items() if h == g and c != b]
        out |= {(q, n, -c) for c, n in sorted(x for x in near if -x[0] >= least)[:k]}
    return out


def found(spark, frames, bans, **k):
    f, b = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(bans, BANS)
    return {(r.q, r.n, r.cos) for r in vectors.most_similar(f, b, **k).collect()}


def test_whole_tables_against_brute_force(spark, data):
    f, b = spark.read.parquet(f"{data}/stored_vector_frame.parquet"), spark.read.parquet(f"{data}/vector_ban.parquet")
    frames = [(r.id, r.ban_id, r.vector) for r in f.dropDuplicates(["id"]).collect()]
    bans = [(r.id, r.chat_id, r.model_name, r.model_revision, r.vector_dim, r.active) for r in b.dropDuplicates(["id"]).collect()]
    got = {(r.q, r.n, r.cos) for r in vectors.most_similar(f, b).collect()}
    assert got == brute(frames, bans) and got


def test_ties_nulls_and_unusable(spark):
    bans = [(k, 1, "m", "r", 2, True) for k in range(1, 9)] + [(9, 1, "m", "r", 2, False), (10, 2, "m", "r", 2, True), (11, 1, "m", "s", 2, True), (12, None, "m", "r", 2, True), (13, 1, "m", "r", 3, True), (1, 1, "m", "r", 2, True)]
    frames = [(100 + k, k, [1.0, 1.0]) for k in range(1, 14)] + [(120 + k, k, [2.0, 2.0]) for k in range(1, 4)]
    frames += [(200, 1, None), (201, 2, [0.0, 0.0]), (202, 3, [float("nan"), 1.0]), (203, 4, [1.0]), (204, 5, [1.0, None]), (205, 99, [1.0, 1.0]), (206, None, [1.0, 1.0]), (207, 6, [float("inf"), 1.0]), (101, 1, [1.0, 1.0])]
    assert found(spark, frames, bans) == brute(list({x[0]: x for x in frames}.values()), bans)


def test_empty(spark):
    assert found(spark, [], []) == set() and found(spark, [(1, 1, [1.0])], []) == set()


def test_many_copies(spark):
    rng = np.random.default_rng(1)
    bans = [(k, 1, "m", "r", 4, True) for k in range(60)]
    frames = [(k, k % 60, [1.0, 2.0, 3.0, 4.0]) for k in range(200)] + [(1000 + k, k % 60, list(map(float, rng.normal(size=4)))) for k in range(100)]
    frames += [(2000 + k, 59, [1.0, 2.0, 3.0, 4.5]) for k in range(20)]
    assert found(spark, frames, bans) == brute(frames, bans)


def test_recall_in_large_groups(spark, data):
    """Clusters of vectors in one group of many lists: at least 0.9 of the neighbours must come out."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(400, 16))
    x = np.repeat(centers, 10, axis=0) + rng.normal(size=(4000, 16)) * 0.35
    bans = [(k, 1, "m", "r", 16, True) for k in range(4000)]
    frames = [(k, k, list(map(float, v))) for k, v in enumerate(x)]
    got = {(q, n) for q, n, _ in found(spark, frames, bans)}
    u = np.float32(x).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -1)
    want = {(q, int(n)) for q in range(4000) for n in np.lexsort((np.arange(4000), -s[q]))[:5] if s[q, n] >= 0.8}
    assert len(want) > 5000 and len(got & want) / len(want) >= 0.97 and len(got - want) < 0.03 * len(want)


def test_extra_columns_do_not_clash(spark):
    bans = spark.createDataFrame([(k, 1, "m", "r", 2, True) for k in (1, 2)], BANS).withColumns({"g": F.lit(1), "ban": F.lit(2), "h": F.lit(3), "n": F.lit(4), "vector": F.lit(5), "list": F.lit(6)})
    frames = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0])], FRAMES).withColumns({"g": F.lit(1), "ban": F.lit(2), "chat_id": F.lit(9), "active": F.lit(False), "size": F.lit(1), "dim": F.lit(1)})
    assert {(r.q, r.n) for r in vectors.most_similar(frames, bans).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("k", [1, 2, 700])
def test_graph_finds_the_nearest_centroids(k):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(k, 8)).astype(np.float32)
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    x = rng.normal(size=(200, 8)).astype(np.float32)
    ids, sims = vectors.nearest(x, c, vectors.linked(c))
    assert (np.argmax(x @ c.T, axis=1) == ids[:, 0]).mean() >= 0.97 and (np.diff(sims, axis=1) <= 0).all()


def test_clusters_are_balanced():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.1 + 1, rng.normal(size=(1000, 8))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    own = np.argmax(np.float32(x) @ vectors.balanced(x, 16).T, axis=1)
    assert np.bincount(own, minlength=16).max() < 1400


def whole(x, ids, bans, k=5, least=0.8):
    """The definition for one group of vectors, in blocks."""
    u = np.float32(x).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    order = np.argsort(ids)
    u, ids, bans = u[order], np.array(ids)[order], np.array(bans)[order]
    out = set()
    for q in range(len(u)):
        cos = np.where(bans == bans[q], -1, np.round(u @ u[q], 6))
        out |= {(int(ids[q]), int(ids[n])) for n in np.lexsort((ids, -cos))[:k] if cos[n] >= least}
    return out


def crowded(kind):
    """(vectors, ids, bans) of one group in which true neighbours lie in many lists."""
    rng = np.random.default_rng(8)
    n, d = 9000, 16
    x = rng.normal(size=d) + rng.normal(size=(n, d)) * {"dense": 0.3, "near equal": 1e-4, "scattered": 9, "copies": 1e-4}[kind]
    ids, bans = rng.permutation(n), rng.integers(0, 900, n)
    if kind == "copies":  # rows of one ban with the smallest ids stand before those of all others
        x[:4000], bans[:4000] = x[0], np.arange(4000) % 400
        bans[np.isin(ids, np.arange(30))] = 399
    return x, ids.tolist(), bans.tolist()


@pytest.mark.parametrize("kind", ["dense", "near equal", "scattered", "copies"])
@pytest.mark.parametrize("block", [1000, 20_000])
def test_no_neighbour_is_missed(spark, monkeypatch, kind, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x, ids, bans = crowded(kind)
    got = {(q, n) for q, n, _ in found(spark, [(i, b, list(map(float, v))) for i, b, v in zip(ids, bans, x, strict=True)], [(b, 1, "m", "r", 16, True) for b in range(900)])}
    assert got == whole(x, ids, bans)
