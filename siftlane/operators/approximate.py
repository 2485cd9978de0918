"""Approximate nearest vectors: a large tenant's vectors are put into lists by their nearest centroid, a query looks into few.

A tenant with few vectors is one list and is searched exactly, as all of its vectors may be far from a query. Centroids are fitted on a bounded sample, every vector is indexed. Lists that a query looks into are searched exactly, in
the cells of ``operators.matching``, so a list of any size is split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from siftlane.operators.matching import TOP_K, vector_top_k
from siftlane.session import cut

# Parameters of the graph index this one stands for; ef_search / ef_construction bound what is looked at.
GRAPH = {"m": 32, "ef_construction": 80, "ef_search": 64}
#: Vectors the centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8


@dataclass(frozen=True)
class Parameters:
    """Knobs of the index: lists, lists a query looks into, vectors up to which a tenant is searched exactly. All 1 or more."""

    lists: int = 64
    probes: int = 16
    exact: int = 5_000

    def __post_init__(self) -> None:
        if min(self.lists, self.probes, self.exact) < 1:
            raise ValueError("lists, probes and exact must be 1 or more")


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that are not null and have the length most of them have, normalised."""
    rows = [k for k, v in enumerate(vectors) if v.is_valid]
    x = vectors.take(pa.array(rows, pa.int64()))
    sizes = np.diff(x.offsets.to_numpy())
    return np.array(rows), _unit(x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), sizes[0] if len(sizes) else 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(stored: DataFrame, lists: int, dim: int, vector: str = "vector", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of at most ``lists`` lists, from at most ``sample`` vectors of ``dim`` elements, chosen by a hash."""
    picked = stored.filter(F.size(vector) == dim).select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()
    x = _unit(np.array([r[0] for r in picked], np.float32).reshape(len(picked), -1))
    if len(x) <= lists:
        return x
    c = x[np.random.default_rng(3).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where((np.abs(sums).sum(1) > 0)[:, None], _unit(sums), c)
    return c


def nearest_lists(centroids: np.ndarray, probes: int):
    """A column function: the numbers of the ``probes`` lists nearest to a vector; null for null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def assign(vectors: pa.Array) -> pa.Array:
        rows, x = _matrix(vectors)
        out: list = [None] * len(vectors)
        if len(rows):
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
            for k, row in zip(rows, near.tolist(), strict=True):
                out[k] = row
        return pa.array(out, pa.list_(pa.int32()))

    return assign


def approximate_top_k(queries: DataFrame, stored: DataFrame, k: int = TOP_K, parameters: Parameters = Parameters(), itself: bool = True) -> DataFrame:
    """As ``vector_top_k``, but a query is compared with the lists nearest to it only; all vectors have one length.

    Vectors of different lengths are an error, as one index has one dimension.
    """
    sizes = [r[0] for r in stored.select(F.size("vector").alias("n")).filter("n > 0").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("an index has vectors of one dimension")
    dim = sizes[0] if sizes else 1
    tenant = ["chat_id", "model_name", "model_revision"]
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    large = cut(stored.filter(fine).groupBy(*tenant).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > parameters.exact).withColumn("_large", F.lit(True)).drop("_n"))
    if large.isEmpty():
        return vector_top_k(queries, stored, k, itself)
    fits = lambda d: d.filter((F.size("vector") == dim) & fine).join(large, tenant, "left")
    s, q = fits(stored), fits(queries)
    centroids = fit(s.filter("_large"), parameters.lists, dim)
    here = lambda n: F.when(F.col("_large"), nearest_lists(centroids, min(n, len(centroids)))("vector")).otherwise(F.array(F.lit(0)))
    return vector_top_k(q.withColumn("list", F.explode(here(parameters.probes))), s.withColumn("list", here(1)[0]), k, itself, ("list",))
