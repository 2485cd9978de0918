"""The engine as a whole: matchers behind one protocol, checks, ingest, search, readiness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.config import Settings
from siftlane.functions.hashes import image_signature, video_signature
from siftlane.functions.vectors import vector_signature
from siftlane.operators import ingest, matching, progress
from siftlane.operators.approximate import Parameters, approximate_top_k
from siftlane.session import cut
from siftlane.sources.media import contained, cosine_rows, decode_png, resized


class Matcher(Protocol):
    """One strategy: what it keeps of an item, which items it finds blocked, and the key under which it stores them."""

    name: str
    keys: list[str]

    def fingerprint(self, items: DataFrame) -> DataFrame: ...

    def blocked(self, items: DataFrame, stored: DataFrame) -> DataFrame: ...


@dataclass
class ExactMatcher:
    name: str = "exact"
    keys: tuple[str, ...] = ("chat_id", "file_unique_id")

    def fingerprint(self, items: DataFrame) -> DataFrame:
        return items.filter("file_unique_id <> ''").select("ban_uid", "chat_id", "file_unique_id")

    def blocked(self, items: DataFrame, stored: DataFrame) -> DataFrame:
        return matching.exact_blocked(items, stored).select("id")


@dataclass
class ImageMatcher:
    """Items with an array ``hashes``; those without are not its business."""

    bits: int = matching.IMAGE_BITS
    name: str = "imagehash"
    keys: tuple[str, ...] = ("chat_id", "hash_signature")

    def fingerprint(self, items: DataFrame) -> DataFrame:
        return items.filter(F.size("hashes") > 0).select("ban_uid", "chat_id", "hashes", image_signature("hashes").alias("hash_signature"))

    def blocked(self, items: DataFrame, stored: DataFrame) -> DataFrame:
        return matching.image_blocked(items.select("id", "chat_id", "hashes"), stored, self.bits)


@dataclass
class VideoMatcher:
    """Items with frames (an array of frame_index, position_millis, hash) and a hash_version."""

    bits: int = matching.VIDEO_BITS
    min_frames: int = matching.MIN_FRAMES
    min_ratio: float = matching.MIN_RATIO
    name: str = "videolike"
    keys: tuple[str, ...] = ("chat_id", "hash_version", "hash_signature")

    def fingerprint(self, items: DataFrame) -> DataFrame:
        # the stored id is derived, so that the same content has the same id in every run
        d = items.filter(F.size("frames") > 0).withColumn("hash_signature", video_signature("frames"))
        return d.select(F.xxhash64("chat_id", "hash_version", "hash_signature").alias("id"), "ban_uid", "chat_id", "hash_version", "frames", "hash_signature")

    def blocked(self, items: DataFrame, stored: DataFrame) -> DataFrame:
        found = matching.video_matches(items.select("id", "chat_id", "hash_version", "frames"), stored, self.bits, self.min_frames, self.min_ratio)
        return found.select(F.col("q_id").alias("id")).distinct()


@dataclass
class VectorMatcher:
    """Items with vectors (an array of frame_index, position_millis, vector), a model_name and a model_revision.

    An item of one frame is blocked by any hit of the score, one of several by enough frames that hit the same ban.
    """

    score: float = matching.VECTOR_SCORE
    top_k: int = matching.TOP_K
    min_frames: int = matching.MIN_FRAMES
    min_ratio: float = matching.MIN_RATIO
    parameters: Parameters | None = None
    name: str = "vector"
    keys: tuple[str, ...] = ("chat_id", "model_name", "model_revision", "vector_signature")

    def fingerprint(self, items: DataFrame) -> DataFrame:
        d = items.filter(F.size("vectors") > 0).withColumn("vector_signature", vector_signature("vectors"))
        return d.select(F.xxhash64("chat_id", "model_name", "model_revision", "vector_signature").alias("id"), "ban_uid", "chat_id", "model_name", "model_revision", "vectors", "vector_signature")

    def hits(self, items: DataFrame, stored: DataFrame) -> DataFrame:
        """(item_id, frame, ban_id, score): the top hits of each frame."""
        scope = ("chat_id", "model_name", "model_revision")
        q = items.select(F.col("id").alias("item_id"), *scope, F.inline("vectors")).withColumn("query_id", F.xxhash64("item_id", "frame_index"))
        s = stored.select(F.col("id").alias("ban_id"), *scope, F.inline("vectors")).withColumn("frame_id", F.xxhash64("ban_id", "frame_index"))
        asked = q.select("query_id", *scope, "vector")
        top = matching.vector_top_k(asked, s, self.top_k) if self.parameters is None else approximate_top_k(asked, s, self.top_k, self.parameters)
        return top.select("query_id", "ban_id", "score").join(q.select("query_id", "item_id", F.col("frame_index").alias("frame")), "query_id").drop("query_id")

    def blocked(self, items: DataFrame, stored: DataFrame) -> DataFrame:
        items = items.filter(F.size("vectors") > 0)
        hits = cut(self.hits(items, stored))
        checked = items.select(F.col("id").alias("item_id"), F.size("vectors").alias("checked_frames"))
        return voted(hits, checked, self.score, self.min_frames, self.min_ratio)


def voted(hits: DataFrame, checked: DataFrame, score: float = matching.VECTOR_SCORE, min_frames: int = matching.MIN_FRAMES, min_ratio: float = matching.MIN_RATIO) -> DataFrame:
    """(id) of blocked items: those of one frame by their best hit, those of several by the votes of their frames."""
    one = checked.filter("checked_frames = 1").select("item_id")
    single = matching.static_vote(hits.join(one, "item_id", "left_semi"), score).filter("blocked").select("item_id")
    many = matching.frame_vote(hits, checked.filter("checked_frames > 1"), score, min_frames, min_ratio).select("item_id")
    return single.unionByName(many).select(F.col("item_id").alias("id")).distinct()


class Engine:
    """Matchers in the order in which they are asked, over tables of what each has stored."""

    def __init__(self, matchers: list[Matcher], stored: dict[str, DataFrame], settings: Settings | None = None) -> None:
        self.matchers, self.stored, self.settings = matchers, dict(stored), settings or Settings()

    def check(self, items: DataFrame, errors: DataFrame | None = None) -> DataFrame:
        """(id, status, matched_by) of ``items``; each matcher is given only what those before it left."""
        ask = lambda m: lambda left: m.blocked(left, self.stored[m.name])
        return matching.cascade(items, [(m.name, ask(m)) for m in self.matchers], errors)

    def ban(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(parents, events) of ``items`` (ban_uid, chat_id, media_type, file_unique_id, ...); what is new is stored."""
        prints = {m.name: m.fingerprint(items) for m in self.matchers}
        parents, appended, events = ingest.ingest(items.select("ban_uid", "chat_id", "media_type", "file_unique_id"), self.stored, {m.name: list(m.keys) for m in self.matchers}, prints)
        for name, rows in appended.items():
            self.stored[name] = self.stored[name].unionByName(rows, allowMissingColumns=True)
        return parents, events

    def search(self, queries: DataFrame, vectors: DataFrame, parameters: Parameters | None = None) -> DataFrame:
        """The nearest stored vectors of each query: all of them, or by the approximate index if it has ``parameters``."""
        if parameters is None:
            return matching.vector_top_k(queries, vectors, self.settings.top_k)
        return approximate_top_k(queries, vectors, self.settings.top_k, parameters)

    def ready(self, checkpoints: DataFrame, consumer: str) -> bool:
        """Whether no index of ``consumer`` is stale; one without a checkpoint counts as fresh."""
        names = checkpoints.sparkSession.createDataFrame([(consumer, m.name) for m in self.matchers], "consumer_id STRING, index_name STRING")
        return progress.is_ready(checkpoints, names)


def upload_violation(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """(request_id, violation): requests (request_id, length) with too many files or bytes; null if a request is fine."""
    d = files.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return d.select("request_id", F.when(F.col("n") > max_files, "too many files").when(F.col("bytes") > max_bytes, "too many bytes").alias("violation"))


def request_violation(files: DataFrame) -> DataFrame:
    """(request_id, violation): requests (request_id, name, length) whose files cannot be embedded; null if they can.

    A request has one file at least, and every file a name and content.
    """
    d = files.groupBy("request_id").agg(F.count("length").alias("n"), F.count_if(F.coalesce(F.trim("name") == "", F.lit(True)) & F.col("length").isNotNull()).alias("nameless"), F.count_if(F.col("length") == 0).alias("empty"))
    return d.select("request_id", F.when(F.col("n") == 0, "no files").when(F.col("nameless") > 0, "a file without a name").when(F.col("empty") > 0, "an empty file").alias("violation"))


def embedder(load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], decode: Callable[[bytes], tuple[int, int, int, bytes] | None] = decode_png, edge: int = 320) -> Callable[[Column | str], Column]:
    """A column function from image bytes to unit vectors; ``load`` runs once a worker and gives the model.

    The model takes a batch of images (height, width, 3), red first, scaled to fit into ``edge``, and gives a matrix; rows
    are normalised here. Null, and what ``decode`` does not know, gives null.
    """

    def picture(content: bytes | None) -> np.ndarray | None:
        if content is None or (p := decode(bytes(content))) is None:
            return None
        width, height, channels, pixels = p
        a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
        a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, ::-1]
        return resized(a, *contained(width, height, edge))

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for contents in batches:
            images = [picture(x) for x in contents]
            there = [k for k, x in enumerate(images) if x is not None]
            out = pd.Series([None] * len(images), dtype=object)
            if there:
                v = np.asarray(model([images[k] for k in there]), np.float32)
                v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
                for k, row in zip(there, v, strict=True):
                    out[k] = row
            yield out

    return lambda c: embed(F.col(c) if isinstance(c, str) else c)


def spectrum(images: list[np.ndarray], side: int = 8) -> np.ndarray:
    """A descriptor that needs no weights: the lowest ``side`` x ``side`` cosine coefficients of each colour, 64 x 64 pixels."""
    c = cosine_rows(64, side)
    small = np.stack([resized(x, 64, 64) for x in images]).astype(np.float64) / 255 - 0.5
    return np.einsum("ay,nyxk,bx->nkab", c, small, c, optimize=True).reshape(len(images), -1)
