"""64-bit perceptual hashes, held as BIGINT bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of different bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def from_decimal(text: Column | str) -> Column:
    """The bit pattern of an unsigned decimal text; null if it is none or exceeds 64 bits."""
    t = F.col(text) if isinstance(text, str) else text
    v = F.when(t.rlike("^[0-9]+$"), t.try_cast("decimal(38,0)"))
    two63, two64 = F.expr("9223372036854775808BD"), F.expr("18446744073709551616BD")
    return F.when(v < two63, v.cast("decimal(20,0)").cast("bigint")).when(v < two64, (v - two64).cast("decimal(20,0)").cast("bigint"))


def to_decimal(pattern: Column | str) -> Column:
    """The unsigned decimal text of a bit pattern."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.when(p >= 0, p.cast("string")).otherwise((p.cast("decimal(20,0)") + F.expr("18446744073709551616BD")).cast("decimal(20,0)").cast("string"))


def image_signature(hashes: Column | str) -> Column:
    """The decimal hashes in order, joined by ``|``."""
    return F.array_join(F.transform(hashes, to_decimal), "|")


def video_signature(frames: Column | str) -> Column:
    """``index:position:hash`` of frames (frame_index, position_millis, hash) in order, joined by ``|``."""
    return F.array_join(F.transform(frames, lambda f: F.concat_ws(":", f["frame_index"], f["position_millis"], to_decimal(f["hash"]))), "|")


def hashes_of(signature: Column | str) -> Column:
    """The hashes of an image signature in order; blanks, leading zeros and empty or unreadable pieces mean nothing."""
    s = F.col(signature) if isinstance(signature, str) else signature
    return F.filter(F.transform(F.split(F.regexp_replace(s, r"\s", ""), r"\|"), from_decimal), lambda h: h.isNotNull())


def frames_of(signature: Column | str) -> Column:
    """The frames of a video signature as an array of (frame_index, position_millis, hash)."""
    s = F.col(signature) if isinstance(signature, str) else signature
    parts = F.transform(F.split(F.regexp_replace(s, r"\s", ""), r"\|"), lambda p: F.split(p, ":"))
    frames = F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.struct(p[0].try_cast("int").alias("frame_index"), p[1].try_cast("int").alias("position_millis"), from_decimal(p[2]).alias("hash")))
    return F.filter(frames, lambda f: f["hash"].isNotNull())
