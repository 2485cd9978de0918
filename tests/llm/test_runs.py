from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm.runs import runs

EVENTS = "video_like_id BIGINT, frame_index INT, position_millis INT, hash BIGINT"


def brute(rows, bits=4):
    frames = defaultdict(dict)
    key = lambda ms, h: (h is None, h or 0, ms is None, ms or 0)
    for v, i, ms, h in rows:
        if v is not None and i is not None and (i not in frames[v] or key(ms, h) < key(*frames[v][i])):
            frames[v][i] = (ms, h)
    out = set()
    for v, by in frames.items():
        run = []
        for i in [*sorted(by), None]:
            ms, h = by.get(i, (None, None))
            if run and h is not None and run[-1][2] is not None and ((run[-1][2] ^ h) & (2**64 - 1)).bit_count() <= bits:
                run.append((i, ms, h))
                continue
            if len(run) > 1:
                t = [x[1] for x in run if x[1] is not None]
                out.add((v, run[0][0], run[-1][0], len(run), max(t) - min(t) if t else None))
            run = [(i, ms, h)]
    return out


def found(spark, rows, **k):
    r = runs(spark.createDataFrame(rows, EVENTS), "video_like_id", "frame_index", "position_millis", "hash", **k)
    return {(x.entity, x.first_index, x.last_index, x.n_events, x.duration_millis) for x in r.collect()}


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/blocked_video_like_frame_hash.parquet").select("video_like_id", "frame_index", "position_millis", "hash").collect()]
    assert found(spark, rows) == brute(rows) and brute(rows)


@pytest.mark.parametrize("block", [4096, 16, 1])
def test_blocks_are_joined(spark, block):
    """Runs that end at, begin at and span several blocks; gaps in the index, also of whole blocks, do not end a run."""
    rng = np.random.default_rng(8)
    rows = []
    for v in range(6):
        h = 0
        for i in range(-5, 300):
            if rng.random() < 0.2 or 100 <= i < 170 and v == 3:
                continue
            if rng.random() < 0.15:
                h = int(rng.integers(-(2**62), 2**62))
            rows.append((v, i, None if rng.random() < 0.1 else i * 40, None if rng.random() < 0.05 else h ^ int(1 << rng.integers(0, 60))))
    rows += rows[:50]
    assert found(spark, rows, block=block) == brute(rows)


def test_classes_drift_and_come_back(spark):
    """A chain of near hashes ends far from where it began: its class is one, but neighbours that are far apart part runs."""
    chain = [(1 << 3 * k) - 1 for k in range(12)]
    rows = [(1, k, k * 10, h) for k, h in enumerate(chain + [chain[0]] * 3 + chain[::-1] + [None, chain[5], chain[5], None, None])]
    rows += [(2, k, k, chain[(k * 5) % 12]) for k in range(60)] + [(3, k, k, chain[k % 2]) for k in range(9)]
    assert found(spark, rows) == brute(rows)
    assert {r for r in brute(rows) if r[0] == 1} == {(1, 0, 11, 12, 110), (1, 12, 14, 3, 20), (1, 15, 26, 12, 110), (1, 28, 29, 2, 10)}


def test_edges(spark):
    rows = [(1, 0, 0, 5), (1, 0, 0, 5), (1, 1, None, 5), (1, 2, None, None), (1, 3, 9, 5), (None, 1, 1, 5), (2, None, 1, 5), (3, 0, 0, 5), (4, 0, 0, -1), (4, 5, 10, -1), (5, 0, None, 1), (5, 1, None, 1), (6, 0, 0, 1), (6, 1, 1, 2**40), (6, 1, 1, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()


def test_long_entity(spark):
    d = spark.range(50_000).select(F.lit(1).alias("video_like_id"), F.col("id").cast("int").alias("frame_index"), F.col("id").cast("int").alias("position_millis"), F.element_at(F.array(*map(F.lit, (0, 4095, 4095 << 30))), (F.floor(F.col("id") / 20_000) + 1).cast("int")).alias("hash")).withColumns({"entity": F.lit(9), "i": F.lit(1), "block": F.lit(2), "h": F.lit("x")})
    got = sorted((x.first_index, x.last_index, x.n_events) for x in runs(d, "video_like_id", "frame_index", "position_millis", "hash").collect())
    assert got == [(0, 19_999, 20_000), (20_000, 39_999, 20_000), (40_000, 49_999, 10_000)]
