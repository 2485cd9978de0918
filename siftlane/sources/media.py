"""Files: bounded reads, pixels, sampled frames and perceptual hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

# Largest file and image that are read; frames and edge of a sampled video.
MAX_BYTES, MAX_PIXELS, MAX_FRAMES, MAX_EDGE = 20 * 1024**2, 20_000_000, 20, 1024


def length_violation(declared: Column | str, remote: Column | str, header: Column | str, actual: Column | str, max_bytes: int = MAX_BYTES) -> Column:
    """Which of the four lengths of a download is over the limit, in the order in which they become known; null if none is.

    A length that is not given is not checked; the limit itself is allowed.
    """
    out = F.lit(None).cast("string")
    for name, c in reversed((("declared", declared), ("remote", remote), ("header", header), ("actual", actual))):
        out = F.when((F.col(c) if isinstance(c, str) else c) > max_bytes, f"{name} length").otherwise(out)
    return out


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of files up to ``max_bytes``; the length is known before a file is read, so larger ones are not."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes).select("path", "length", "content")


def _size_of(head: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) told by the first bytes of a file; none if it is not of a kind that is known."""
    big, little = (lambda a, n: int.from_bytes(head[a : a + n], "big")), (lambda a, n: int.from_bytes(head[a : a + n], "little"))
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return "png", big(16, 4), big(20, 4)
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return "gif", little(6, 2), little(8, 2)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return "webp", little(24, 3) + 1, little(27, 3) + 1
        if head[12:16] == b"VP8L":
            return "webp", (little(21, 4) & 0x3FFF) + 1, (little(21, 4) >> 14 & 0x3FFF) + 1
        if head[12:16] == b"VP8 ":
            return "webp", little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:  # from segment to segment, up to the one that begins a frame
            mark = head[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "jpeg", big(at + 7, 2), big(at + 5, 2)
            at += 2 + big(at + 2, 2) if not (mark == 0x01 or 0xD0 <= mark <= 0xD9) else 2
    return None


@F.arrow_udf(StructType().add("kind", StringType()).add("width", IntegerType()).add("height", IntegerType()))
def image_size(content: pa.Array) -> pa.Array:
    """STRUCT(kind, width, height) of PNG, GIF, JPEG and WebP files from their headers; null for others. Nothing is decoded."""
    out = [None if x is None else _size_of(x) for x in content.to_pylist()]
    return pa.array([x and dict(zip(("kind", "width", "height"), x, strict=True)) for x in out], pa.struct([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))


def image_headers(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(path, length, kind, width, height, problem): every file, and why it cannot be taken: bytes, kind, pixels; else null."""
    d = spark.read.format("binaryFile").load(path)
    # the content of files that are too long is not read
    small = d.filter(F.col("length") <= max_bytes).select("path", "length", image_size("content").alias("h"))
    known = small.select("path", "length", "h.kind", "h.width", "h.height", F.when(F.col("h").isNull(), "unknown kind").when(F.col("h.width").cast("bigint") * F.col("h.height") > max_pixels, "too many pixels").alias("problem"))
    none = lambda kind: F.lit(None).cast(kind)
    return known.unionByName(d.filter(F.col("length") > max_bytes).select("path", "length", none("string").alias("kind"), none("int").alias("width"), none("int").alias("height"), F.lit("too many bytes").alias("problem")))


def images(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS, decode: Callable[[bytes], tuple[int, int, int, bytes] | None] | None = None) -> DataFrame:
    """(path, kind, width, height, channels, pixels, problem) of every file: those that cannot be taken say why.

    Sizes are read from the headers, and images with more pixels are not decoded. The rest is decoded by ``decode``, which
    gives (width, height, channels, pixels blue first) or None; without it by the JVM, file by file and by path, which
    knows PNG, GIF and JPEG, but not WebP: such images come out with the problem ``not decoded``. Of an animation the
    first picture is taken. Nothing is left out.
    """
    heads = image_headers(spark, path, max_pixels=max_pixels)
    if decode is None:
        # a bad image gives a row with width -1; those that are too large are kept from the decoder by their size in bytes only
        data = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").filter("width > 0").select(F.col("origin").alias("path"), F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
    else:
        @F.arrow_udf(StructType().add("channels", IntegerType()).add("pixels", BinaryType()))
        def pictures(content: pa.Array) -> pa.Array:
            out = [decode(x) if (h := _size_of(x)) and h[1] * h[2] <= max_pixels else None for x in content.to_pylist()]
            return pa.array([x and {"channels": x[2], "pixels": x[3]} for x in out], pa.struct([("channels", pa.int32()), ("pixels", pa.binary())]))

        data = files(spark, path).select("path", pictures("content").alias("p")).filter("p is not null").select("path", "p.channels", "p.pixels")
    d = heads.withColumn("_p", F.regexp_replace("path", "^file:/+", "file:/")).join(data.withColumn("_p", F.regexp_replace("path", "^file:/+", "file:/")).drop("path"), "_p", "left").drop("_p")
    lost = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("pixels").isNull(), "not decoded")
    keep = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return d.select("path", "kind", "width", "height", keep("channels"), keep("pixels"), lost.alias("problem"))


def decode_png(content: bytes) -> tuple[int, int, int, bytes] | None:
    """(width, height, channels, pixels blue first) of a PNG of 8 bits a sample, as sampled frames are; else None.

    Grey and colour, with or without alpha (which is left out), or with a palette; not interlaced.
    """
    if (head := _size_of(content)) is None or head[0] != "png" or len(content) < 33 or content[24] != 8 or content[28]:
        return None
    _, width, height = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(content[25])
    at, data, palette = 8, b"", None
    while at + 12 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        if kind == b"IDAT":
            data += content[at + 8 : at + 8 + size]
        elif kind == b"PLTE":
            palette = np.frombuffer(content[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += 12 + size
    try:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
    except zlib.error:
        return None
    if samples is None or len(raw) != height * (1 + width * samples):
        return None
    rows = raw.reshape(height, 1 + width * samples)
    out = np.zeros((height, width * samples), np.uint8)
    before = np.zeros(width * samples, np.uint8)
    for y in range(height):
        out[y] = before = _unfiltered(int(rows[y, 0]), rows[y, 1:], before, samples)
    pixels = out.reshape(height, width, samples)
    if content[25] == 3:
        if palette is None or pixels.max() >= len(palette):
            return None
        pixels = palette[pixels[:, :, 0]]
    colour = pixels[:, :, :1] if samples <= 2 and content[25] != 3 else pixels[:, :, 2::-1]
    return width, height, colour.shape[2], colour.tobytes()


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of samples from its differences to the left, to the row above, to their mean, or to the best of three."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = [0] * step + row.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        left, top, corner = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + top) // 2
        else:
            nearest = left + top - corner
            guess = min((left, top, corner), key=lambda v: abs(nearest - v))
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def contained(width: int, height: int, edge: int = 320) -> tuple[int, int]:
    """The size of an image scaled to fit into a square of ``edge``, larger or smaller, with its aspect kept."""
    scale = edge / max(width, height)
    return max(1, round(width * scale)), max(1, round(height * scale))


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (height, width, channels) in another size, by a Lanczos window of three lobes that widens when shrinking."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m
        x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    h, w = pixels.shape[:2]
    out = np.einsum("yh,hwc,xw->yxc", weights(h, height), pixels.astype(float), weights(w, width), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def sampled(frames: DataFrame, fps: int = 1, max_frames: int = MAX_FRAMES) -> DataFrame:
    """(video, frame_index, position_millis): of frames (video, at_millis) the first in each 1/fps s, at most ``max_frames``.

    Frames are numbered in order; the position is the index times 1000 / fps.
    """
    slot = F.floor(F.col("at_millis") * fps / 1000)
    d = frames.select("video", slot.alias("slot")).distinct()
    d = d.groupBy("video").agg(F.slice(F.array_sort(F.collect_set("slot")), 1, max_frames).alias("slots"))
    return d.select("video", F.posexplode("slots").alias("frame_index", "_")).select("video", "frame_index", (F.col("frame_index") * (1000 // fps)).alias("position_millis"))


def cosine_rows(n: int, rows: int) -> np.ndarray:
    """The first ``rows`` rows of the cosine transform of ``n`` values."""
    k, x = np.arange(rows)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def perceptual_hash(grey: np.ndarray) -> int:
    """64-bit hash of a grey image: scaled to 64 x 64, cosine transform, low 8 x 8 above their median, first bit highest."""
    h, w = grey.shape
    y, x = (np.arange(64) + 0.5) * h / 64 - 0.5, (np.arange(64) + 0.5) * w / 64 - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    top = grey[np.ix_(y0, x0)] * (1 - fx) + grey[np.ix_(y0, x1)] * fx
    low = grey[np.ix_(y1, x0)] * (1 - fx) + grey[np.ix_(y1, x1)] * fx
    c = cosine_rows(64, 64)
    # rounding keeps a flat image's coefficients at zero, whatever its size
    block = np.round((c @ (top * (1 - fy) + low * fy) @ c.T)[:8, :8].ravel(), 6)
    return int("".join("1" if b else "0" for b in block > np.median(block)), 2)


def quarter_turns(pixels: bytes, width: int, height: int, channels: int) -> list[int]:
    """Hashes of an image (rows from above, blue-green-red or grey) turned by 0, 90, 180 and 270 degrees."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(float)
    grey = a[:, :, 0] if channels == 1 else a[:, :, 2] * 0.299 + a[:, :, 1] * 0.587 + a[:, :, 0] * 0.114
    return [perceptual_hash(np.rot90(grey, k)) for k in range(4)]


@F.arrow_udf(ArrayType(LongType()))
def image_hashes(pixels: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array) -> pa.Array:
    """The four hashes of decoded pixels as bit patterns; null for null."""
    rows = zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), channels.to_pylist(), strict=True)
    out = [None if p is None else [v - (1 << 64) if v >> 63 else v for v in quarter_turns(p, w, h, c)] for p, w, h, c in rows]
    return pa.array(out, pa.list_(pa.int64()))
