"""Texts of settings: durations, byte sizes, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of durations in seconds, and of sizes in bytes.
DURATION_UNITS = {"": 1.0, "ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
SIZE_UNITS = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1024, "mib": 1024**2, "gib": 1024**3}
# File extensions of videos.
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov", ".mkv")


_NUMBER = r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$"


def _scaled(text: Column | str, units: dict) -> Column:
    t = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    unit = F.regexp_extract(t, _NUMBER, 2)
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in units.items() for x in pair)), unit)
    return F.when(t.rlike(_NUMBER) & unit.isin(list(units)), F.regexp_extract(t, _NUMBER, 1).try_cast("double") * factor)


def scaled(text: object, units: dict) -> float | None:
    """The same for a single value on the driver; None for anything that cannot be read."""
    m = re.fullmatch(_NUMBER, str(text).strip().lower())
    return float(m[1]) * units[m[2]] if m and m[2] in units else None


def duration_seconds(text: Column | str) -> Column:
    """Seconds of ``10s``, ``500ms``, ``5m``, ``1h`` or a bare number; null for anything else."""
    return _scaled(text, DURATION_UNITS)


def size_bytes(text: Column | str) -> Column:
    """Bytes of ``256KiB``, ``20MiB``, ``1kb`` or a bare number; null for anything else."""
    return _scaled(text, SIZE_UNITS).cast("bigint")


def extension(path: Column | str) -> Column:
    """The extension in lower case with its point; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_video_file(path: Column | str) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def frame_name(index: Column | str) -> Column:
    """``frame-000.png``; three digits or more."""
    i = (F.col(index) if isinstance(index, str) else index).cast("string")
    return F.concat(F.lit("frame-"), F.lpad(i, F.greatest(F.lit(3), F.length(i)), F.lit("0")), F.lit(".png"))


def frame_position(index: Column | str) -> Column:
    """Position in milliseconds of a frame sampled once a second."""
    return (F.col(index) if isinstance(index, str) else index) * 1000


def formatted(template: str, *values: Column | str) -> Column:
    """A name from a template with ``%s``, as of queues; a template without a place for a value is taken as it is."""
    return F.format_string(template, *values) if "%" in template else F.lit(template)


def derived_uid(*parts: Column | str) -> Column:
    """A reproducible identifier in UUID spelling from the values of ``parts``."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
