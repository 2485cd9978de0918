from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlane.llm import history

IMAGES = "id BIGINT, chat_id BIGINT, hash_version STRING, hash_signature STRING, batch_no INT"
TEXTS = "id BIGINT, chat_id BIGINT, file_unique_id STRING, batch_no INT"


def parse(s, last):
    out = []
    for p in "".join(s.split()).split("|"):
        p = p.split(":")[-1] if last else p
        if p.isdigit() and int(p) < 2**64:
            out.append(int(p))
    return np.array(out, "u8")


def image(a, b):
    return len(a) == len(b) and 4 * int((np.bitwise_count(a ^ b) <= 6).sum()) >= 3 * len(a)


def video(a, b):
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
    return (near.any(1).sum() + near.any(0).sum()) / (len(a) + len(b)) >= 0.6


def text(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] <= 2


def in_order(rows, match):
    """The definition: rows (group, batch, id, content) one after the other against all accepted before."""
    accepted, cases = defaultdict(list), set()
    for group, _, id_, content in sorted(rows, key=lambda r: (2**31 if r[1] is None else r[1], r[2])):
        if any(match(content, x) for x in accepted[group]):
            cases.add(id_)
        else:
            accepted[group].append(content)
    return cases


def expected(images=(), videos=(), texts=()):
    hashed = lambda rows, last: [((c, v), b, i, parse(s, last)) for i, c, v, s, b in set(rows) if s is not None and len(parse(s, last))]
    out = {(0, i) for i in in_order(hashed(images, False), image)} | {(1, i) for i in in_order(hashed(videos, True), video)}
    return out | {(2, i) for i in in_order([((c,), b, i, s.strip()) for i, c, s, b in set(texts) if s is not None], text)}


def found(spark, images=None, videos=None, texts=None, **k):
    frame = lambda rows, schema: None if rows is None else spark.createDataFrame(list(rows), schema)
    rec = history.records(frame(images, IMAGES), frame(videos, IMAGES), frame(texts, TEXTS))
    return {(r.kind, r.id) for r in history.repeats(rec, **k).collect()}


def read(spark, data):
    pick = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(*c).collect()]
    hashed = ("id", "chat_id", "hash_version", "hash_signature", "batch_no")
    return pick("blocked_image", *hashed), pick("blocked_video_like", *hashed), pick("vector_ban", "id", "chat_id", "file_unique_id", "batch_no")


def test_whole_tables(spark, data):
    tables = read(spark, data)
    want = expected(*tables)
    assert want and found(spark, *tables) == want


def test_frequent_chunks_are_extended(spark, monkeypatch):
    """A third of all rows share hashes, and counts of few rows are hot: all levels and blocks are used, in every batch."""
    monkeypatch.setattr(history, "MERGE", 2)
    rng = np.random.default_rng(6)
    flip = lambda h, n: h ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False))
    hot = int(rng.integers(0, 2**63))
    near = [flip(hot, 5) for _ in range(20)]
    image = lambda k: "|".join(str(flip(near[k % 20], int(rng.integers(0, 3))) if k % 3 == 0 and p < 2 else int(rng.integers(0, 2**63))) for p in range(4))
    images = [(k, 1, "v", image(k), k // 40) for k in range(160)]
    images += [(1000 + k, 1, "v", "|".join(str(flip(int(x), 6)) for x in images[k][3].split("|")), 5) for k in range(30)]
    video = lambda k: "|".join(f"{j}:{j}:{flip(hot, 2) if j == 0 else int(rng.integers(0, 2**63))}" for j in range(1 + k % 4))
    videos = [(k, 1, "v", video(k), k // 40) for k in range(120)]
    texts = [(k, 1, f"AgAD{k % 7:03d}abcd{k // 7:05d}", k // 50) for k in range(150)]
    want = expected(images, videos, texts)
    assert len(want) > 60 and found(spark, images, videos, texts, frequent=12) == want


def test_places_that_turn_hot_late_and_after_reopening(spark, tmp_path):
    """Small batches, so places of every level turn hot at different times; the history is opened again in between."""
    rng = np.random.default_rng(9)
    flip = lambda h, n: h ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False))
    base = [int(rng.integers(0, 2**63)) for _ in range(3)]
    images = [(k, 1, "v", "|".join(str(flip(base[p], 3 + k % 4) if p < 3 and k % 5 else int(rng.integers(0, 2**63))) for p in range(4)), k // 25) for k in range(125)]
    repeats = expected(images)
    rec = history.records(spark.createDataFrame(images, IMAGES))
    for batch in range(5):
        h = history.History(spark, str(tmp_path / "h"), buckets=2, frequent=9)
        h.accept(rec.filter(F.col("seq.batch") == batch), f"b{batch}")
        accepted = {r.rid // 3 for r in h.accepted().collect()}
        h.forget()
        assert accepted == {k for k in range(25 * batch + 25) if (0, k) not in repeats}
    assert h.hot[1].any() and 10 < len(repeats) < 110


def test_edges(spark):
    images = [(1, 1, "v", "1|2|3|4", 1), (2, 1, "v", " 01 | 2|3|| 4 ", 1), (3, 1, "w", "1|2|3|4", 1), (4, 2, "v", "1|2|3|4", 1), (5, 1, "v", None, 1), (6, 1, "v", "", 1), (7, 1, "v", "|x|", 1), (8, 1, "v", "1|2|3", 2), (9, None, None, "1|2|3|4", 2), (10, None, None, "1|2|3|4", None), (11, 1, "v", "63|2|3|4", 2), (12, 1, "v", "127|2|3|18446744073709551615", 2), (1, 1, "v", "1|2|3|4", 1)]
    videos = [(1, 1, "v", "0:0:5", 1), (2, 1, "v", "0:0:5|1:1:5|2:2:5", 1), (3, 1, "v", "0:0:15|1:100:18446744073709551615", 2), (4, 1, "v", "0:0:", 2), (5, 1, "v", "|".join(f"{k}:{k}:{k * 2654435761 % 2**64}" for k in range(2000)), 1), (6, 1, "v", "|".join(f"{k}:{k}:{k * 2654435761 % 2**64}" for k in range(2000)), 3)]
    texts = [(1, 1, "abcdefghij", 1), (2, 1, " abcdefghij\t", 1), (3, 1, "abXdefghiY", 2), (4, 1, "abXdefghYZ", 2), (5, 1, "", 1), (6, 1, "a", 1), (7, 1, "ab", 2), (8, 1, "abc", 2), (9, 1, None, 2), (10, 1, "x" * 5000, 1), (11, 1, "x" * 5002, 2), (12, 1, "xyz", 2), (13, 1, "cdefghij", 3), (14, 1, "zzabcdefghij", 3)]
    assert found(spark, images, videos, texts) == expected(images, videos, texts)
    assert found(spark, [], [], []) == set()


def test_chain_is_settled_in_order(spark):
    """2 repeats 1; 3 is like 2 only, which was not accepted, so 3 is accepted; 4 repeats 3."""
    h = [0, 0b111111, 0b111111111111, 0b111111111111 ^ 1]
    images = [(k + 1, 1, "v", "|".join([str(x)] * 4), 1) for k, x in enumerate(h)]
    assert found(spark, images) == {(0, 2), (0, 4)} == expected(images)


def test_rounds_and_one_task_agree(spark, monkeypatch):
    monkeypatch.setattr(history, "SETTLE", 3)
    chain = [(1 << 6 * k) - 1 for k in range(9)]
    images = [(k + 1, 1 + k // 9, "v", "|".join([str(chain[k % 9])] * 4), 1) for k in range(27)]
    assert found(spark, images) == expected(images)


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(2)
    other = ["|".join(map(str, rng.integers(0, 2**63, 4))) for _ in range(200)]
    images = [(k, 1, "v", "7|8|9|10" if k % 3 == 0 else other[k % 200], k // 50) for k in range(600)]
    assert found(spark, images) == expected(images)


def test_a_history_is_kept_and_a_batch_given_again_replaces_its_part(spark, tmp_path):
    rec = history.records(spark.createDataFrame([(1, 1, "v", "1|2|3|4", 1), (2, 1, "v", "1|2|3|5", 1)], IMAGES))
    h = history.History(spark, str(tmp_path / "h"), buckets=3)
    for _ in range(2):
        h.accept(rec, "a")
        assert [r.rid for r in h.accepted().collect()] == [3]
    h.forget()
    again = history.History(spark, str(tmp_path / "h"))
    again.accept(history.records(spark.createDataFrame([(9, 1, "v", "1|2|3|4", 2), (10, 1, "v", "|".join([str(2**60 - 1)] * 4), 2)], IMAGES)), "b")
    assert again.buckets == 3 and sorted(r.rid for r in again.accepted().collect()) == [3, 30]
    again.forget(keep=False)
    assert not (tmp_path / "h").exists()


def test_extra_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, 1, "v", "1|2|3|4", 1), (2, 1, "v", "1|2|3|4", 1)], IMAGES).withColumns({"rid": F.lit(0), "g": F.lit(0), "kind": F.lit(9), "elems": F.lit("x"), "seq": F.lit(1), "_h": F.lit(1), "txt": F.lit("t")})
    assert [(r.kind, r.id) for r in history.repeats(history.records(d)).collect()] == [(0, 2)]


words = st.text("abcAB-", min_size=0, max_size=18)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.sampled_from("abcAB-")), max_size=2))
def test_pieces_meet_within_two_edits(word, edits):
    """The argument behind the pieces of texts, without Spark: one of them is found at a moved place."""
    other = word
    for kind, at, ch in edits:
        at = min(at, len(other))
        other = other[:at] + ch + other[at:] if kind == 0 else other[:at] + other[at + 1 :] if kind == 1 else other[:at] + ch + other[at + 1 :] if at < len(other) else other

    def cuts(n):
        a = history.LEAD + (n - history.LEAD) // 3 if n >= history.LEAD + 3 else n // 3
        b = (n - a) // 2
        return [(0, a), (a, b), (a + b, n - a - b)]

    index = {(len(word), k, word[a : a + m]) for k, (a, m) in enumerate(cuts(len(word)))}
    probe = set()
    for delta in range(-2, 3):
        if len(other) - delta >= 0:
            for k, (a, m) in enumerate(cuts(len(other) - delta)):
                for shift in range(-k, k + 1):
                    if abs(shift - delta) <= 2 - k and a + shift >= 0 and a + shift + m <= len(other):
                        probe.add((len(other) - delta, k, other[a + shift : a + shift + m]))
    assert index & probe
