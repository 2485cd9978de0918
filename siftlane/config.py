"""Settings of the engine: defaults, overrides from a mapping, validation. Unknown names are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from siftlane.functions.settings import DURATION_UNITS, SIZE_UNITS, scaled


@dataclass(frozen=True)
class Settings:
    """Durations are seconds and sizes bytes; texts such as "10s" and "256KiB" are read in ``with_values``."""

    image_bits: int = 12
    video_bits: int = 12
    min_frames: int = 2
    min_ratio: float = 0.4
    vector_score: float = 0.92
    top_k: int = 5
    animation_seconds: float = 10
    animation_bytes: int = 20 * 1024**2
    sticker_seconds: float = 3
    sticker_bytes: int = 256 * 1024
    max_frames: int = 10
    catch_up_seconds: float = 5
    catch_up_batch: int = 100

    def __post_init__(self) -> None:
        wrong = [n for n in ("image_bits", "video_bits") if getattr(self, n) < 0]
        wrong += [n for n in ("min_frames", "top_k", "max_frames", "catch_up_batch") if getattr(self, n) < 1]
        wrong += [n for n in ("animation_seconds", "animation_bytes", "sticker_seconds", "sticker_bytes", "catch_up_seconds") if getattr(self, n) <= 0]
        wrong += ["vector_score"] * (not 0 <= self.vector_score <= 1) + ["min_ratio"] * (not 0 < self.min_ratio <= 1)
        if wrong:
            raise ValueError("out of range: " + ", ".join(wrong))

    def with_values(self, values: Mapping[str, object]) -> Settings:
        """These settings with others in their place."""
        kinds = {f.name: str(f.type) for f in fields(self)}
        if unknown := sorted(set(values) - set(kinds)):
            raise ValueError("unknown: " + ", ".join(unknown))
        read: dict[str, object] = {}
        for name, value in values.items():
            if name.endswith(("_seconds", "_bytes")):
                number = scaled(value, DURATION_UNITS if name.endswith("_seconds") else SIZE_UNITS)
                if number is None:
                    raise ValueError(f"{name}: {value!r} cannot be read")
                read[name] = number if name.endswith("_seconds") else int(number)
            else:
                read[name] = int(str(value)) if kinds[name] == "int" else float(str(value))
        return replace(self, **read)

    @classmethod
    def load(cls, path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "SIFTLANE_") -> Settings:
        """Defaults, then the values of a YAML file, then those of the environment (``SIFTLANE_TOP_K`` is top_k).

        A name in the file or, with the prefix, in the environment that is no setting is an error; empty values of the
        environment count as not given.
        """
        values: dict[str, object] = {}
        if path is not None:
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading a settings file needs yaml") from e
            with open(path) as f:
                values = yaml.safe_load(f) or {}
            if not isinstance(values, dict):
                raise ValueError(f"{path} has no mapping of settings")
        given = os.environ if environment is None else environment
        values |= {k.removeprefix(prefix).lower(): v for k, v in given.items() if k.startswith(prefix) and v != ""}
        return cls().with_values(values)
