"""Which matcher takes which media, and limits on what is fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane.functions.settings import extension, is_video_file

# Limits in seconds and bytes, by kind of video.
ANIMATION_SEC, ANIMATION_BYTES, STICKER_SEC, STICKER_BYTES = 10, 20 * 1024**2, 3, 256 * 1024


def routes(media_type: Column | str = "media_type", path: Column | str = "path") -> Column:
    """STRUCT(exact, imagehash, videolike, vector) of BOOLEAN: the matchers that take a file."""
    m = F.col(media_type) if isinstance(media_type, str) else media_type
    video, webm = is_video_file(path), extension(path) == ".webm"
    photo, sticker, animation = m == "photo", m == "sticker_static", m == "animation"
    no = F.lit(False)
    out = {
        "exact": m.isin("photo", "animation", "sticker_static", "sticker_animated"),
        "imagehash": (photo | sticker) & ~video,
        "videolike": animation | sticker & webm,
        "vector": photo & ~video | animation | sticker & (webm | ~video),
    }
    return F.struct(*(F.coalesce(c, no).alias(k) for k, c in out.items()))


def limit_violation(media_type: Column | str = "media_type", path: Column | str = "path", duration: Column | str = "duration_sec", size: Column | str = "size_bytes") -> Column:
    """Which limit of the video matcher a file exceeds, null if none; a limit itself is allowed.

    The duration of a static sticker counts before its file is known, its size only for a .webm.
    """
    m, d, n = (F.col(x) if isinstance(x, str) else x for x in (media_type, duration, size))
    webm = extension(path) == ".webm"
    return (
        F.when((m == "animation") & (d > ANIMATION_SEC), "animation duration")
        .when((m == "animation") & (n > ANIMATION_BYTES), "animation size")
        .when((m == "sticker_static") & (d > STICKER_SEC), "sticker duration")
        .when((m == "sticker_static") & webm & (n > STICKER_BYTES), "sticker size")
    )
