from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm import hashsets

SETS = "id BIGINT, chat_id BIGINT, hashes ARRAY<BIGINT>"


def brute(rows, bits=4, cover=0.6):
    groups = defaultdict(dict)
    for id_, chat, hs in rows:
        hs = [h for h in hs or [] if h is not None]
        if hs and id_ is not None and chat is not None:
            groups[chat][id_] = np.array(hs, np.int64).view("u8")
    out = set()
    for members in groups.values():
        for (i, a), (j, b) in combinations(sorted(members.items()), 2):
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= bits
            if (near.any(1).sum() + near.any(0).sum()) / (len(a) + len(b)) >= cover:
                out.add((i, j))
    return out


def found(spark, rows):
    m, links = hashsets.similar_sets(spark.createDataFrame(rows, SETS), ["chat_id"])
    pairs = [(r.a, r.b) for r in hashsets.similar_pairs(m, links).collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_whole_table_against_brute_force(spark, data):
    d = spark.read.parquet(f"{data}/stored_image_hash.parquet").select("id", "chat_id", "hashes")
    m, links = hashsets.similar_sets(d, ["chat_id"])
    got = {(r.a, r.b) for r in hashsets.similar_pairs(m, links).collect()}
    assert got == brute([tuple(r) for r in d.collect()]) and got


@pytest.mark.parametrize("frequent", [32, 2])
def test_hot_hashes_and_noise(spark, monkeypatch, frequent):
    """A hash that half of all rows hold, with and without flipped bits; every level of combinations is used."""
    monkeypatch.setattr(hashsets, "FREQUENT", frequent)
    rng = np.random.default_rng(4)
    rows, hot = [], int(rng.integers(-(2**62), 2**62))
    flip = lambda h, n: int(np.int64(h) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, n, replace=False))))
    for k in range(300):
        base = [int(x) for x in rng.integers(-(2**62), 2**62, int(rng.integers(1, 6)))]
        if k % 2:
            base[0] = flip(hot, int(rng.integers(0, 4)))
        rows.append((3 * k, k % 2, base))
        rows.append((3 * k + 1, k % 2, [flip(h, int(rng.integers(0, 6))) for h in base][:: int(rng.choice([1, -1]))]))
        rows.append((3 * k + 2, k % 2, base[:-1] + [flip(h, 2) for h in base[-1:]]))
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_heavy_tokens_are_counted_before_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(hashsets, "HEAVY", 5)
    rows = [(k, 1, [7, 1000 + k, 2000 + k]) for k in range(60)] + [(100 + k, 1, [7 ^ 3]) for k in range(3)]
    assert found(spark, rows) == brute(rows)


def test_one_key_and_one_class_of_a_third_of_all_rows(spark, monkeypatch):
    """Blocks of few rows: keys beyond them at the last level are split, and so are classes."""
    monkeypatch.setattr(hashsets, "BLOCK", 7)
    monkeypatch.setattr(hashsets, "FREQUENT", 4)
    rng = np.random.default_rng(5)
    rows = [(k, 1, [5, int(rng.integers(-(2**62), 2**62))]) for k in range(60)] + [(100 + k, 1, [5, 6]) for k in range(50)]
    rows += [(200 + k, 1, [int(rng.integers(-(2**62), 2**62))]) for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, 1, [1, 2, 3, 4]), (2, 1, [4, 3, 2, 1]), (3, 1, None), (4, 1, []), (5, 1, [None]), (6, 1, [1, None, 2, 3, 4]), (7, None, [1, 2, 3, 4]), (8, 2, [1, 2, 3, 4]), (None, 1, [1, 2, 3, 4]), (1, 1, [1, 2, 3, 4]), (9, 1, [1] * 40), (10, 1, [-1, -2]), (11, 1, list(range(0, 400_000, 1000))), (12, 1, list(range(0, 400_000, 1000))[::-1])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()


def test_members_and_links(spark):
    d = spark.createDataFrame([(5, 1, [1, 2]), (3, 1, [2, 1]), (9, 1, [1, 3]), (4, 1, [1 << 40, 1 << 50])], SETS).withColumns({"g": F.lit(1), "elems": F.lit("x"), "e": F.lit(1), "rep": F.lit(1), "n": F.lit(2), "_0": F.lit(1)})
    m, links = hashsets.similar_sets(d, ["chat_id"])
    assert {tuple(r) for r in m.collect()} == {(5, 3), (3, 3), (9, 9), (4, 4)}
    assert {tuple(r) for r in links.select("a", "b").collect()} >= {(3, 9)}


def test_pieces_cover_all_bits():
    for width in (64, 52, 51, 41):
        for n in (5, 7):
            p = hashsets.pieces(width, n)
            assert [b for low, size in p for b in range(low, low + size)] == list(range(width))


def _keys(n_keys, rows, seed):
    """Batches sorted by key, as Spark hands them on: keys of ``rows`` rows whose elements are near each other."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    key = np.repeat(np.arange(n_keys), rows)
    e = rng.integers(0, 2**60, n_keys)[key] ^ (np.int64(1) << rng.integers(16, 60, len(key)))
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key))), pa.array(e), pa.array(np.ones(len(key), np.int32))], ["key", "id", "e", "px"])
    return whole, [whole.slice(k, 10_000) for k in range(0, len(key), 10_000)]


def _traced(batches, level=1, limit=10**9):
    """Pairs that leave a task, its largest batch, and its peak of memory in MB without what it was given."""
    import tracemalloc

    tracemalloc.start()
    seen, largest = 0, 0
    for out in hashsets._meet(4, 64, level, limit)(iter(batches)):
        seen, largest = seen + out.num_rows, max(largest, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return seen, largest, peak


def test_memory_of_a_task_does_not_grow_with_its_partition():
    """1.5 million rows in small keys; a batch that leaves the task is bounded too."""
    _, batches = _keys(500_000, 3, 1)
    seen, largest, peak = _traced(batches)
    assert seen == 1_500_000 and largest < 600_000 and peak < 150


def test_memory_of_a_key_of_many_near_rows(monkeypatch):
    """A key of BLOCK rows that are all near: 8.4 million pairs, each leaving it once."""
    whole, batches = _keys(1, hashsets.BLOCK, 2)
    seen, largest, peak = _traced(batches)
    assert seen == hashsets.BLOCK * (hashsets.BLOCK - 1) // 2 and largest < 1_500_000 and peak < 250


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_whole_keys_across_batches(monkeypatch, rows):
    monkeypatch.setattr(hashsets, "ROWS", rows)
    whole, _ = _keys(60, 5, 3)
    for size in (1, 3, 5, 10, 300):
        tables = list(hashsets._whole_keys(whole.slice(k, size) for k in range(0, whole.num_rows, size)))
        keys = [set(t.column("key").to_pylist()) for t in tables]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 60 and sum(t.num_rows for t in tables) == 300
        assert max(t.num_rows for t in tables) <= rows + 5 + size


def test_strips_of_keys_and_sets_give_the_same_pairs(spark, monkeypatch):
    """Few pairs of elements at once, streams of few rows: every strip of a key and of two large sets."""
    monkeypatch.setattr(hashsets, "CELLS", 64)
    monkeypatch.setattr(hashsets, "ROWS", 16)
    rng = np.random.default_rng(6)
    hot = int(rng.integers(0, 2**60))
    rows = [(k, k % 2, [hot ^ (1 << int(rng.integers(60))), *map(int, rng.integers(0, 2**60, int(rng.integers(0, 3))))]) for k in range(150)]
    long = [int(x) for x in rng.integers(0, 2**60, 90)]
    rows += [(200 + k, 1, [h ^ (1 << int(rng.integers(60))) for h in long[k:]]) for k in range(4)]
    assert found(spark, rows) == brute(rows)
