import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.functions import hashes, settings, vectors
from siftlane.functions.ids import position_text_after, uuid_key, uuid_or_null
from siftlane.sources import media


def test_uuid_spellings(spark):
    u = "1231cdd1-147c-49d2-a8be-949dcc86b83e"
    spellings = [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, "URN:UUID:" + u.upper()]
    rows = spark.createDataFrame([(x,) for x in spellings], "x STRING").select(uuid_or_null("x")).collect()
    assert {r[0] for r in rows} == {u}
    others = spark.createDataFrame([(None,), ("",), ("no uuid",), ("g" * 32,)], "x STRING").select(uuid_or_null("x"), uuid_key("x")).collect()
    assert [tuple(r) for r in others] == [(None, None), (None, None), (None, "no uuid"), (None, "g" * 32)]


def test_hash_texts(spark):
    rows = [("0", 0), ("18446744073709551615", -1), ("9223372036854775808", -(2**63)), ("00042", 42), ("18446744073709551616", None), ("x", None), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t STRING").select(hashes.from_decimal("t").alias("h")).select("h", hashes.to_decimal("h")).collect()
    assert [r[0] for r in got] == [h for _, h in rows]
    assert [r[1] for r in got[:4]] == ["0", "18446744073709551615", "9223372036854775808", "42"]


def test_signatures(spark):
    d = spark.createDataFrame([(" 007 |18446744073709551615||x", "0:0: 5|1:1000:|2:2000:06")], "i STRING, v STRING")
    r = d.select(hashes.image_signature(hashes.hashes_of("i")), hashes.video_signature(hashes.frames_of("v"))).first()
    assert tuple(r) == ("7|18446744073709551615", "0:0:5|2:2000:6")


def test_hamming(spark):
    r = spark.createDataFrame([(0, -1), (5, 6)], "a BIGINT, b BIGINT").select(hashes.hamming("a", "b")).collect()
    assert [x[0] for x in r] == [64, 2]


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    r = d.select(vectors.dot("a", "b"), vectors.l2_normalize("a"), vectors.is_usable("a", F.lit(2)), vectors.from_bytes(vectors.to_bytes("a")), F.length(vectors.to_bytes("a"))).collect()
    assert [x[0] for x in r] == [11.0, 0.0, None, None]
    assert r[0][1] == [0.6, 0.8] and r[1][1] is None
    assert [x[2] for x in r] == [True, False, False, False]
    assert r[0][3] == [3.0, 4.0] and r[0][4] == 8 and r[3][3] is None


def test_vector_signature_layout(spark):
    d = spark.createDataFrame([([(0, 0, [1.0, 2.0]), (1, 1000, [3.0, 4.0])],), (None,)], "f ARRAY<STRUCT<frame_index: INT, position_millis: INT, vector: ARRAY<FLOAT>>>")
    want = hashlib.sha256(struct.pack(">iq2f".replace("2f", ""), 0, 0) + struct.pack("<2f", 1, 2) + struct.pack(">iq", 1, 1000) + struct.pack("<2f", 3, 4)).hexdigest()
    assert [r[0] for r in d.select(vectors.vector_signature("f")).collect()] == [want, None]


@pytest.mark.parametrize(("text", "seconds"), [("10s", 10.0), ("500ms", 0.5), ("2m", 120.0), ("1h", 3600.0), ("7", 7.0), ("x", None), ("5 d", None)])
def test_durations(spark, text, seconds):
    assert spark.range(1).select(settings.duration_seconds(F.lit(text))).first()[0] == seconds


@pytest.mark.parametrize(("text", "size"), [("256KiB", 262144), ("20MiB", 20971520), ("1kb", 1000), ("12", 12), ("1.5 gib", 1610612736), ("1tb", None)])
def test_sizes(spark, text, size):
    assert spark.range(1).select(settings.size_bytes(F.lit(text))).first()[0] == size


def test_names(spark):
    d = spark.createDataFrame([("a/b.WEBM", 7), ("x.tar.mp4", 1234), ("none", 0)], "p STRING, i INT")
    r = d.select(settings.extension("p"), settings.is_video_file("p"), settings.frame_name("i"), settings.frame_position("i")).collect()
    assert [tuple(x) for x in r] == [(".webm", True, "frame-007.png", 7000), (".mp4", True, "frame-1234.png", 1234000), ("", False, "frame-000.png", 0)]


def test_positions_are_numbers(spark):
    d = spark.createDataFrame([("10", 1, "9", 5), ("9", 5, "9", 5), ("9", 6, "9", 5), ("x", 1, "9", 5)], "a STRING, b BIGINT, c STRING, d BIGINT")
    assert [r[0] for r in d.select(position_text_after(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, True, False]


def _pattern():
    a = np.full((96, 128, 3), 255, np.uint8)
    a[8:80, 12:24] = 0
    a[64:78, 12:96] = 0
    a[20:42, 72:108] = (0, 0, 180)  # blue, green, red
    return a


def test_perceptual_hash():
    white = [media.quarter_turns(np.full((h, w, 3), 255, np.uint8).tobytes(), w, h, 3) for h, w in ((128, 128), (240, 320))]
    assert min((a ^ b).bit_count() for a in white[0] for b in white[1]) <= 8
    a = _pattern()
    up, down = (media.quarter_turns(np.ascontiguousarray(x).tobytes(), x.shape[1], x.shape[0], 3) for x in (a, np.rot90(a, 2)))
    assert min((p ^ q).bit_count() for p in up for q in down) <= 8
    assert media.quarter_turns(a.tobytes(), 128, 96, 3) == up


def test_image_hash_column(spark):
    a = _pattern()
    d = spark.createDataFrame([(a.tobytes(), 128, 96, 3), (None, None, None, None)], "p BINARY, w INT, h INT, c INT")
    r = d.select(media.image_hashes("p", "w", "h", "c")).collect()
    assert [x & (2**64 - 1) for x in r[0][0]] == media.quarter_turns(a.tobytes(), 128, 96, 3) and r[1][0] is None


def test_sampled_frames(spark):
    d = spark.createDataFrame([(1, t) for t in (0, 400, 999, 1000, 2500, 2600)] + [(2, 0)], "video INT, at_millis INT")
    got = sorted(map(tuple, media.sampled(d, max_frames=2).collect()))
    assert got == [(1, 0, 0), (1, 1, 1000), (2, 0, 0)]


def test_files_are_bounded(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "large.bin").write_bytes(b"x" * 100)
    assert [r.length for r in media.files(spark, str(tmp_path), 10).collect()] == [3]


def png(pixels, filters=(0,), colour=None):
    """A PNG of grey (height, width) or colour (height, width, samples) pixels, its rows filtered in turn."""
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = np.asarray(pixels, np.uint8)
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, n = pixels.shape
    flat, rows, above = pixels.reshape(h, w * n).astype(int), b"", np.zeros(w * n, int)
    for y, row in enumerate(flat):
        left, corner = (np.concatenate([np.zeros(n, int), x[:-n]]) for x in (row, above))
        best = np.array([min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner, strict=True)])
        kind = filters[y % len(filters)]
        rows += bytes([kind]) + ((row - (np.zeros(w * n, int), left, above, (left + above) // 2, best)[kind]) % 256).astype(np.uint8).tobytes()
        above = row
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n] if colour is None else 3
    table = b"" if colour is None else part(b"PLTE", np.asarray(colour, np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + table + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_of_all_filters(samples):
    x = np.random.default_rng(samples).integers(0, 256, (11, 7, samples)).astype(np.uint8)
    width, height, channels, pixels = media.decode_png(png(x, (0, 1, 2, 3, 4)))
    want = x[:, :, :1] if samples < 3 else x[:, :, 2::-1]
    assert (width, height, channels) == (7, 11, want.shape[2]) and pixels == want.tobytes()


def test_png_with_palette_and_broken_ones():
    table = [[1, 2, 3], [4, 5, 6]]
    assert media.decode_png(png([[0, 1], [1, 0]], colour=table))[3] == bytes([3, 2, 1, 6, 5, 4, 6, 5, 4, 3, 2, 1])
    good = png([[0, 1], [1, 2]])
    assert media.decode_png(png([[0, 1], [1, 2]], colour=table)) is None
    assert [media.decode_png(x) for x in (b"", good[:20], good[:45], GIF, good.replace(b"IDAT", b"IDAX"))] == [None] * 5


GIF = bytes.fromhex("47494638396101000100800000000000ffffff2c00000000010001000002024401003b")
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08\x00\x30\x00\x40\x03" + b"\0" * 20
WEBP = {
    "x": b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"),
    "l": b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 8,
    "p": b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + (100).to_bytes(2, "little") + (50).to_bytes(2, "little"),
}


def test_images_of_all_kinds(spark, tmp_path):
    for name, data in {"a.png": png(np.full((4, 5), 9)), "big.png": png(np.full((40, 50), 9)), "b.gif": GIF, "c.jpg": JPEG, "d.webp": WEBP["x"] + b"\0" * 9, "e.txt": b"none"}.items():
        (tmp_path / name).write_bytes(data)
    assert [media._size_of(w + b"\0" * 9) for w in WEBP.values()] == [("webp", 100, 50)] * 3
    got = {r.path.rsplit("/", 1)[1]: r for r in media.images(spark, str(tmp_path), max_pixels=1999 * 4).collect()}
    sizes = {n: (r.kind, r.width, r.height, r.problem) for n, r in got.items()}
    assert sizes == {"a.png": ("png", 5, 4, None), "big.png": ("png", 50, 40, None), "b.gif": ("gif", 1, 1, None), "c.jpg": ("jpeg", 64, 48, "not decoded"), "d.webp": ("webp", 100, 50, "not decoded"), "e.txt": (None, None, None, "unknown kind")}
    assert set(got["a.png"].pixels) == {9} and got["d.webp"].pixels is None
    decode = lambda x: (100, 50, 1, b"\1" * 5000) if x[8:12] == b"WEBP" else None
    got = {r.path.rsplit("/", 1)[1]: r for r in media.images(spark, str(tmp_path), 5000, decode).collect()}
    assert got["d.webp"].problem is None and len(got["d.webp"].pixels) == 5000 and got["a.png"].problem == "not decoded"
    assert {n: r.problem for n, r in got.items() if n == "big.png"} == {"big.png": "not decoded"}
    heads = {r.path.rsplit("/", 1)[1]: r.problem for r in media.image_headers(spark, str(tmp_path), max_bytes=10_000, max_pixels=1000).collect()}
    assert heads["big.png"] == heads["d.webp"] == heads["c.jpg"] == "too many pixels" and heads["a.png"] is None
    assert media.image_headers(spark, str(tmp_path), max_bytes=3).filter("problem = 'too many bytes'").count() == 6


def test_resizing():
    assert media.contained(640, 480) == (320, 240) and media.contained(10, 40) == (80, 320)
    flat = media.resized(np.full((30, 20, 3), 77, np.uint8), 8, 12)
    assert flat.shape == (12, 8, 3) and (flat == 77).all()
    ramp = media.resized(np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 4, 0), 10, 2)[0, :, 0].astype(int)
    assert (np.diff(ramp) > 0).all() and abs(ramp[0] - 5) <= 4


def test_lengths_and_names(spark):
    d = spark.createDataFrame([(1, 2, 3, 4), (9, 2, 3, 4), (None, None, 3, 9), (8, None, None, None)], "a INT, b INT, c INT, d INT")
    assert [r[0] for r in d.select(media.length_violation("a", "b", "c", "d", 8)).collect()] == [None, "declared length", "actual length", None]
    assert spark.range(1).select(settings.formatted("queue.%s.x", F.lit("r1")), settings.formatted("plain")).first() == ("queue.r1.x", "plain")


def test_vectors_that_cannot_be_normalised_are_an_error(spark):
    d = spark.createDataFrame([([3.0, 4.0],)], "v ARRAY<FLOAT>")
    assert d.select(vectors.checked_unit("v", 2)).first()[0] == [0.6, 0.8]
    for bad in ([0.0, 0.0], [1.0], [1.0, float("nan")]):
        with pytest.raises(Exception, match="vector"):
            spark.createDataFrame([(bad,)], "v ARRAY<FLOAT>").select(vectors.checked_unit("v", 2)).collect()
