"""Filling fixed-capacity containers with items (problem 7).

Method: minimum bin slack. For each bin the largest item left is set, then a subset-sum dynamic program over the lengths
still available, its reachable sums held in the bits of one integer, finds the fullest feasible combination; its items
are removed. Items are spread over shards of a bounded size, which are packed at the same time; the items of bins that
stayed too empty are spread over fewer shards and packed again, until one shard is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.session import cut

#: Items a shard is meant to hold, and the share of a bin that may stay empty without another try.
SHARD, SLACK = 10_000, 0.005

_PACKED = "container STRING, capacity BIGINT, doc_id BIGINT, piece BIGINT, size BIGINT, shard BIGINT, bin BIGINT, filled BIGINT"


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """The lengths, of those available (descending; ``left`` has their numbers), that fill ``room`` best."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for length in lengths:
        if length > room:
            continue
        n, many = min(left[length], room // length), 1
        while n and not reach & full:
            take = min(many, n)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            n, many = n - take, many * 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; every size lies between 1 and ``capacity``."""
    items: dict[int, list[int]] = {}
    for k, size in enumerate(sizes):
        items.setdefault(size, []).append(k)
    left = {size: len(x) for size, x in items.items()}
    lengths = sorted(items, reverse=True)
    out, bin_ = [0] * len(sizes), 0
    while lengths:
        first = lengths[0]
        left[first] -= 1
        chosen = [first, *(fullest(capacity - first, lengths, left) if capacity > first else ())]
        left[first] += 1
        for size in chosen:
            left[size] -= 1
            out[items[size].pop()] = bin_
        lengths = [x for x in lengths if left[x]]
        bin_ += 1
    return out


def _pack(table):
    """Packs one shard; ties are settled by doc_id and piece, so the result does not depend on the order of rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.sort_by([("size", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
    bins = fill(table.column("size").to_pylist(), table.column("capacity")[0].as_py())
    table = table.append_column("bin", pa.array(bins, pa.int64()))
    sums = table.group_by("bin").aggregate([("size", "sum")])
    filled = dict(zip(sums.column("bin").to_pylist(), sums.column("size_sum").to_pylist(), strict=True))
    table = table.append_column("filled", pa.array([filled[b] for b in bins], pa.int64()))
    return table.select([x.split()[0] for x in _PACKED.split(", ")]).set_column(1, "capacity", pc.cast(table.column("capacity"), pa.int64()))


def pack(sizes: DataFrame, containers: DataFrame, shard: int = SHARD, slack: float = SLACK) -> DataFrame:
    """(container, bin_id, doc_id, piece, first_token, n_tokens, bin_tokens): the bins of each container kind.

    ``sizes`` (doc_id, n_tokens), one row a document; ``containers`` (container, capacity_tokens), a table of settings.
    A document that fits is one piece; a longer one is split into full containers and a rest, which is packed like any
    other item. Documents of no tokens need no room: they come out with a null bin_id and n_tokens 0. Null sizes count
    as 0. Every container kind holds all documents. Capacities must be 1 or more.
    """
    kinds = [(r["container"], int(r["capacity_tokens"])) for r in containers.select("container", "capacity_tokens").distinct().collect()]
    if any(c < 1 for _, c in kinds):
        raise ValueError("a container has no capacity")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds))) if kinds else F.explode(F.array().cast("array<struct<container:string,capacity:bigint>>"))
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    d = sizes.select("doc_id", n.alias("n"), each.alias("k")).select("doc_id", "n", "k.*")
    whole = F.floor(F.col("n") / F.col("capacity")).cast("bigint")
    full = d.filter(F.col("n") >= F.col("capacity")).select("container", F.col("capacity"), "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    full = full.select("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.col("capacity").alias("bin_tokens"))
    empty = d.filter("n = 0").select("container", F.lit(None).cast("string").alias("bin_id"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("bin_tokens"))
    items = d.withColumns({"piece": whole, "size": F.col("n") - whole * F.col("capacity")}).filter("size > 0").select("container", "capacity", "doc_id", "piece", "size")
    items, out, step = cut(items), [full, empty], 0
    counts = {r["container"]: r["count"] for r in items.groupBy("container").count().collect()}
    while counts:
        shards = {c: max(1, -(-k // shard)) for c, k in counts.items()}
        n_shards = F.element_at(F.create_map(*(F.lit(x).cast("string" if i % 2 == 0 else "bigint") for c, k in shards.items() for i, x in enumerate((c, k)))), F.col("container"))
        spread = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(step)), n_shards))
        packed = cut(spread.groupBy("container", "shard").applyInArrow(_pack, _PACKED))
        # a kind's last round keeps every bin: one shard, or no fewer items than before
        again = (F.col("filled") < F.col("capacity") * (1 - slack)) & (n_shards > 1)
        left = {r["container"]: r["count"] for r in packed.filter(again).groupBy("container").count().collect()}
        stuck = [c for c, k in left.items() if k > 0.9 * counts[c]]
        again = again & ~F.col("container").isin(stuck)
        out.append(packed.filter(~again).select("container", F.concat_ws("-", F.lit(step), "shard", "bin").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("size").alias("n_tokens"), F.col("filled").alias("bin_tokens")))
        items = packed.filter(again).select("container", "capacity", "doc_id", "piece", "size")
        counts, step = {c: k for c, k in left.items() if c not in stuck}, step + 1
    d = out[0]
    for more in out[1:]:
        d = d.unionByName(more)
    return d
