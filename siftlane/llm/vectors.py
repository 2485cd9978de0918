"""Most similar vectors for every vector (problem 1).

Method: balanced posting lists. A group of comparable vectors is cut into balanced clusters whose centroids are fitted
on a bounded sample; every vector is then indexed. Vectors near a boundary are replicated to several clusters. The
nearest centroids of a vector are found in an in-memory graph of the group's centroids, and it searches the lists whose
distance is within a ratio of the nearest one's. Vectors meet in their lists, which hold about LIST rows; a group with
no more than BLOCK rows is one list and is searched exactly. In larger ones what the lists gave is a bound: a second
pass searches every list that may hold a neighbour beyond it, by the angle to the list's centroid less the widest angle
of its rows, so no neighbour is missed. Neighbours have their cosine computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.operators.skew import heavy_keys, lookup
from siftlane.session import cut

#: Rows a posting list is meant to hold; rows of a group that share one copy of its centroids while lists are selected,
#: and that meet in one task when a group is searched exactly.
LIST, BLOCK = 512, 20_000
#: Sampled rows a centroid, and at most in a group: centroids are fitted on no more than these.
PER_CENTROID, SAMPLE = 64, 65_536
#: A vector is replicated to at most REPLICAS lists within NEAR times the distance of its nearest centroid, and searches
#: at most PROBES lists within REACH times that distance.
REPLICAS, NEAR, PROBES, REACH = 4, 1.08, 8, 1.16
#: Links of a centroid in the graph, beam of its search.
DEGREE, BEAM = 16, 32
#: Rows of one vector, written several times, that take part; the others take over their neighbours.
COPIES = 10

_POSTING = "g BIGINT, list BIGINT, id BIGINT, ban BIGINT, member BOOLEAN, probe BOOLEAN, vector ARRAY<FLOAT>"


def _unit(table, name: str = "vector") -> np.ndarray:
    """Rows of a list column of equal lengths, normalised, as a matrix."""
    column = table.column(name)
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balanced(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """About ``k`` unit centroids of unit vectors; crowded clusters are cut again until all hold about the same.

    Vectors that cannot be told apart stay one cluster.
    """
    rng = np.random.default_rng(7)
    x = x.astype(np.float32)
    limit = 1.4 * len(x) / k
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        parts = min(8, -(-len(at) // max(1, int(limit / 1.4))))
        if len(at) <= limit or parts < 2:
            out.append(at)
            continue
        c = x[rng.permutation(at)[:parts]]
        for _ in range(rounds):
            own = np.argmax(x[at] @ c.T, axis=1)
            sums = np.stack([x[at[own == j]].sum(0) for j in range(parts)])
            length = np.sqrt((sums * sums).sum(1, keepdims=True))
            # an empty cluster starts again from some vector
            c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), x[at[rng.integers(0, len(at), parts)]])
        own = np.argmax(x[at] @ c.T, axis=1)
        split = [at[own == j] for j in range(parts) if (own == j).any()]
        if len(split) == 1:
            out.append(at)
        else:
            todo += split
    c = np.stack([x[at].sum(0) for at in sorted(out, key=lambda a: a[0])])
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)


def linked(c: np.ndarray) -> np.ndarray:
    """The graph: DEGREE nearest centroids of each, and a few others as long links."""
    k = len(c)
    rng = np.random.default_rng(11)
    far = rng.integers(0, k, (k, 4))
    near = np.concatenate([np.argsort(-(c[lo : lo + 512] @ c.T), axis=1, kind="stable")[:, 1 : DEGREE + 1] for lo in range(0, k, 512)])
    return np.concatenate([near, far], axis=1) if k > 1 else far


def nearest(x: np.ndarray, c: np.ndarray, links: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of up to ``beam`` near centroids of each row of ``x``, by a best-first walk through the graph."""
    k, rows = len(c), np.arange(len(x))[:, None]
    entry = np.unique(np.linspace(0, k - 1, min(k, beam)).astype(int))
    ids = np.broadcast_to(entry, (len(x), len(entry)))
    sims = x @ c[entry].T
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[rows, order], sims[rows, order]
    done = np.full(ids.shape, len(entry) == k)
    for _ in range(4 * beam):
        if done.all():
            break
        best = np.argmin(done, axis=1)  # the nearest that has not been expanded
        hops = links[ids[rows[:, 0], best]]
        done[rows[:, 0], best] = True
        hops = np.sort(hops, axis=1)
        known = (hops[:, :, None] == ids[:, None, :]).any(2)
        known[:, 1:] |= hops[:, 1:] == hops[:, :-1]
        s = np.where(known, -np.inf, np.einsum("bd,bkd->bk", x, c[hops])).astype(sims.dtype)
        ids, sims, done = np.concatenate([ids, hops], 1), np.concatenate([sims, s], 1), np.concatenate([done, known], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
        done |= np.isneginf(sims)
    return ids, sims


def _fit(table):
    """The centroids of a group from its sampled rows, with their links."""
    import pyarrow as pa

    n = table.column("n")[0].as_py()
    table = table.sort_by("id")
    x = _unit(table)
    k = max(2, min(-(-n // LIST), SAMPLE // 16, len(x)))
    c = balanced(x, k) if len(x) > 1 else x.astype(np.float32)
    links = linked(c)
    g = pa.array(np.full(len(c), table.column("g")[0].as_py()))
    vector = pa.ListArray.from_arrays(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32), pa.array(c.astype(np.float32).ravel()))
    near = np.argmax(c @ balanced(c, -(-n // BLOCK)).T, axis=1)
    return pa.table({"g": g, "near": pa.array(near.astype(np.int64)), "n": pa.array(np.full(len(c), n)), "list": pa.array(np.arange(len(c))), "vector": vector, "links": pa.array([[int(y) for y in x] for x in links], pa.list_(pa.int32()))})


def _select(rows, centroids):
    """Postings of a block of rows of one group: the lists each is a member of and those it searches."""
    import pyarrow as pa

    schema = pa.schema([("g", pa.int64()), ("list", pa.int64()), ("id", pa.int64()), ("ban", pa.int64()), ("member", pa.bool_()), ("probe", pa.bool_()), ("vector", pa.list_(pa.float32()))])
    if not rows.num_rows:
        return schema.empty_table()
    out = []
    if centroids.num_rows:
        centroids = centroids.sort_by("list")
        c = _unit(centroids).astype(np.float32)
        links = np.array(centroids.column("links").to_pylist())
    for lo in range(0, rows.num_rows, 4096):
        part = rows.slice(lo, 4096).combine_chunks()
        if not centroids.num_rows:  # the sample of the group was empty: one list
            who, lists, member = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
            probe = member
        else:
            x = _unit(part).astype(np.float32)
            ids, sims = nearest(x, c, links)
            ids, sims = ids[:, :PROBES], sims[:, :PROBES]
            d = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
            reach = d <= d[:, :1] * REACH
            take = d <= d[:, :1] * NEAR
            take[:, REPLICAS:] = False
            # a list is left out if one already taken lies nearer to its centroid than the vector does
            for j in range(1, min(REPLICAS, take.shape[1])):
                for i in range(j):
                    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bd->b", c[ids[:, i]], c[ids[:, j]]), 0))
                    take[:, j] &= ~(take[:, i] & (apart < d[:, j]))
            take[:, 0] = reach[:, 0] = True
            at = np.nonzero(take | reach)
            who, lists, member, probe = at[0], ids[at].astype(np.int64), take[at], reach[at]
        p = part.take(pa.array(who))
        out.append(pa.table([p.column("g"), pa.array(lists), p.column("id"), p.column("ban"), pa.array(member), pa.array(probe), p.column("vector").cast(pa.list_(pa.float32()))], schema=schema))
    return pa.concat_tables(out)


def _home(rows, centroids):
    """(g, id, list, cos): the list each row of a block is counted in for the bounds, and its cosine with the centroid."""
    import pyarrow as pa

    schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("list", pa.int64()), ("cos", pa.float64())])
    if not rows.num_rows:
        return schema.empty_table()
    centroids = centroids.sort_by("list")
    c, x = _unit(centroids), _unit(rows)
    lists, cos = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ c.T
        lists[lo : lo + 1024], cos[lo : lo + 1024] = np.argmax(s, axis=1), s.max(axis=1)
    return pa.table([rows.column("g"), rows.column("id"), pa.array(centroids.column("list").to_numpy()[lists]), pa.array(cos)], schema=schema)


def _highest(cos: np.ndarray, low: np.ndarray | float) -> np.ndarray:
    """The highest cosine a row may have with rows of a list: ``cos`` with its centroid, whose rows have ``low`` or more."""
    return np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - np.arccos(np.clip(low, -1, 1)), 0)) + 1e-6


def _wanted(rows, centroids):
    """(g, id, part): the parts of a group in which a row may have a neighbour beyond its bound."""
    import pyarrow as pa

    schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("part", pa.int64())])
    if not rows.num_rows or not centroids.num_rows:
        return schema.empty_table()
    c, x = _unit(centroids), _unit(rows)
    low, first, part = (centroids.column(z).to_numpy() for z in ("low", "first", "part"))
    at, last, ids, g = (rows.column(z).to_numpy() for z in ("at", "last", "id", "g"))
    names, of = np.unique(part, return_inverse=True)
    out = []
    for lo in range(0, len(x), 1024):
        z = slice(lo, lo + 1024)
        floor = np.where(last[z, None] > first, at[z, None] - 5e-7, at[z, None] + 5e-7)
        may = _highest(x[z] @ c.T, low) >= floor
        who, where = np.nonzero(np.stack([may[:, of == j].any(1) for j in range(len(names))], axis=1))
        out.append(pa.table([pa.array(g[z][who]), pa.array(ids[z][who]), pa.array(names[where])], schema=schema))
    return pa.concat_tables(out)


def _beyond(x: np.ndarray, ids: np.ndarray, bans: np.ndarray, q: np.ndarray, lists: list[np.ndarray], k: int, at: np.ndarray, last: np.ndarray):
    """(rows, neighbours, cosines): of each row in ``q`` the ``k`` best of other bans in ``lists`` beyond its bound.

    A neighbour counts if its rounded cosine is above ``at``, or equal to it and its id below ``last``. The rows of a list
    stand in the order of ids, so a row with k neighbours in hand needs a higher cosine from there on. The bound rises with
    what is found, so few pairs are kept at a time.
    """
    small, slack = x.astype(np.float32), (x.shape[1] + 8) * 6e-8  # the most that single precision can be off
    balls = []
    for m in lists if len(lists) > 1 else []:
        c = x[m].sum(0)
        c /= max(np.sqrt(c @ c), 1e-12)
        balls.append((c, (x[m] @ c).min()))
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(q), 1024):
        rows, bound, before = q[lo : lo + 1024], at[lo : lo + 1024].copy(), last[lo : lo + 1024].copy()
        top = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for j, m in enumerate(lists):
            may = _highest(x[rows] @ balls[j][0], balls[j][1]) if balls else np.full(len(rows), 1 + 1e-6)
            for cut_at in range(0, len(m), 512):
                cols = m[cut_at : cut_at + 512]
                floor = np.where(before > ids[cols[0]], bound - 5e-7, bound + 5e-7) - 1e-9
                open_ = np.flatnonzero((may >= floor) & (floor <= 1))
                if not len(open_):
                    break
                s = small[rows[open_]] @ small[cols].T
                a, b = np.nonzero(s >= (floor[open_] - slack)[:, None].astype(np.float32))
                if not len(a):
                    continue
                if len(a) > s.size // 8 and len(cols) > k:
                    # many: of each row only the k best, ties to the first
                    s = np.where(bans[rows[open_], None] == bans[cols], -2, np.round(x[rows[open_]] @ x[cols].T, 6))
                    kth = np.partition(s, len(cols) - k, axis=1)[:, len(cols) - k, None]
                    tie = s == kth
                    a, b = np.nonzero((s > kth) | (tie & (np.cumsum(tie, axis=1, dtype=np.int16) <= k)))
                    cos = s[a, b]
                else:
                    cos = np.round(np.einsum("ij,ij->i", x[rows[open_[a]]], x[cols[b]]), 6)
                a, b = open_[a], cols[b]
                good = (bans[rows[a]] != bans[b]) & ((cos > bound[a]) | ((cos == bound[a]) & (ids[b] < before[a])))
                if not good.any():
                    continue
                a, b, cos = (np.concatenate(z) for z in zip(top, (a[good], b[good], cos[good]), strict=True))
                best = np.lexsort((ids[b], -cos, a))
                a, b, cos = a[best], b[best], cos[best]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                top = a[rank < k], b[rank < k], cos[rank < k]
                full = rank == k - 1
                bound[a[full]], before[a[full]] = cos[full], ids[b[full]]
        found.append((rows[top[0]], top[1], top[2]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _rows(found: list[tuple[np.ndarray, ...]]):
    import pyarrow as pa

    columns = [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int64)), pa.array(columns[3].astype(np.float64))], names=["q", "n", "ban", "cos"])


def _search(k: int, least: float):
    """For the lists of a bucket: the ``k`` best of each searching row among the members of other bans."""

    def run(table):
        import pyarrow as pa

        g, lists, ids = (table.column(c).to_numpy() for c in ("g", "list", "id"))
        order = np.lexsort((ids, lists, g))
        g, lists, ids = g[order], lists[order], ids[order]
        keep = np.ones(len(g), bool)  # rows that repeat count once
        keep[1:] = (g[1:] != g[:-1]) | (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1])
        order, g, lists, ids = order[keep], g[keep], lists[keep], ids[keep]
        bans, member, probe = (table.column(c).to_numpy()[order] for c in ("ban", "member", "probe"))
        vectors = table.column("vector").combine_chunks().take(pa.array(order))
        flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        ends = np.flatnonzero(np.append((g[1:] != g[:-1]) | (lists[1:] != lists[:-1]), True)) + 1
        found: list[tuple[np.ndarray, ...]] = []
        start = 0
        for end in ends:
            m, q = np.flatnonzero(member[start:end]), np.flatnonzero(probe[start:end])
            if len(m) and len(q) and bans[start:end].min() != bans[start:end].max():
                x = flat[offsets[start] : offsets[end]].astype(np.float64).reshape(end - start, -1)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                i, b = ids[start:end], bans[start:end]
                a, n, cos = _beyond(x, i, b, q, [m], k, np.full(len(q), least), np.full(len(q), np.iinfo(np.int64).max))
                found.append((i[a], i[n], b[n], cos))
            start = end
        return _rows(found)

    return run


def _finish(k: int):
    """For the rows that meet in a part of a group: neighbours beyond the bounds of the searching ones."""

    def run(table):
        table = table.sort_by([("list", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, bans, lists, member, at, last = (table.column(c).to_numpy() for c in ("id", "ban", "list", "member", "at", "last"))
        x, q, m = _unit(table), np.flatnonzero(~member), np.flatnonzero(member)
        if not len(q) or not len(m):
            return _rows([])
        parts = np.split(m, np.flatnonzero(lists[m][1:] != lists[m][:-1]) + 1)
        a, n, cos = _beyond(x, ids, bans, q, sorted(parts, key=lambda z: ids[z[0]]), k, at[q], last[q])
        return _rows([(ids[a], ids[n], bans[n], cos)])

    return run


def usable(frames: DataFrame, bans: DataFrame) -> DataFrame:
    """(id, ban, g, h): frames that can be compared; g is their group, h a digest of the vector.

    A frame's ban must exist and be active; its vector must have vector_dim elements, none null, NaN or infinite and not
    all zero. Groups are chat, model, revision and dimension; a ban without one of these is comparable with none.
    """
    b = bans.filter("active and chat_id is not null and model_name is not null and model_revision is not null").select(F.col("id").alias("ban"), F.xxhash64("chat_id", "model_name", "model_revision", "vector_dim").alias("g"), F.col("vector_dim").alias("dim")).dropDuplicates(["ban"])
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    f = frames.filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine).select("id", F.col("ban_id").alias("ban"), F.size(v).alias("size"), F.xxhash64(v).alias("h"))
    return f.dropDuplicates(["id"]).join(b, "ban").filter("size = dim").select("id", "ban", "g", "h")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each q, ties to the smaller n; the limit is applied before the shuffle, too."""
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "n")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def postings(frames: DataFrame, take: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, large, centroids): the rows of all posting lists, for the frames in ``take`` (id, ban, g, only).

    Rows with ``only`` search and are no members. ``large`` holds the rows of groups of more than BLOCK rows.
    """
    sizes = cut(take.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    heavy = cut(heavy_keys(sizes, "g"))
    take = cut(lookup(take, sizes, "g", heavy).select("id", "ban", "g", "only", "n"))
    wide = frames.select("id", "vector")
    # one row in eight is enough for PER_CENTROID rows a centroid; of large groups fewer are kept
    share = F.least(F.lit(PER_CENTROID / LIST), F.lit(SAMPLE) / F.col("n"))
    bucket: Column = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / F.lit(1 << 20)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = wide.join(take, "id")
    small = rows.filter(F.col("n") <= BLOCK).select("g", F.lit(0).cast("bigint").alias("list"), "id", "ban", (~F.col("only")).alias("member"), F.lit(True).alias("probe"), "vector")
    large = cut(wide.join(take.filter(F.col("n") > BLOCK), "id").dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).select("g", "n", "block", "id", "ban", "only", "vector"))
    sample = large.filter(bucket < share).select("g", "n", "id", "vector")
    centroids = cut(sample.groupBy("g").applyInArrow(_fit, "g BIGINT, near BIGINT, n BIGINT, list BIGINT, vector ARRAY<FLOAT>, links ARRAY<INT>"))
    copies = centroids.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("g", "block", "list", "vector", "links")
    members = large.filter(~F.col("only")).select("g", "block", "id", "ban", "vector")
    return small.unionByName(members.groupBy("g", "block").cogroup(copies.groupBy("g", "block")).applyInArrow(_select, _POSTING)), large, centroids


def beyond(large: DataFrame, centroids: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    """(q, n, ban, cos): neighbours of the rows of ``large`` that ``found`` lacks, from all lists that may hold any."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    copies = centroids.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = large.filter(~F.col("only"))
    home = cut(members.select("g", "block", "id", "vector").groupBy("g", "block").cogroup(copies.select("g", "block", "list", "vector").groupBy("g", "block")).applyInArrow(_home, "g BIGINT, id BIGINT, list BIGINT, cos DOUBLE"))
    lists = home.groupBy("g", "list").agg(F.min("cos").alias("low"), F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    # neighbouring lists make a part of about BLOCK rows
    w = Window.partitionBy("g").orderBy("near", "list").rowsBetween(Window.unboundedPreceding, -1)
    lists = cut(centroids.join(lists, ["g", "list"]).withColumn("part", F.floor(F.coalesce(F.sum("rows").over(w), F.lit(0)) / BLOCK)).select("g", "n", "list", "vector", "low", "first", "part"))
    kth = found.groupBy("q").agg(F.count(F.lit(1)).alias("had"), F.max(F.struct((-F.col("cos")).alias("cos"), "n")).alias("x")).filter(F.col("had") >= k)
    kth = kth.select(F.col("q").alias("id"), (-F.col("x.cos")).alias("at"), F.col("x.n").alias("last"))
    bound = F.coalesce("at", F.lit(float(least))).alias("at"), F.coalesce("last", F.lit((1 << 63) - 1)).alias("last")
    rows = cut(large.join(kth, "id", "left").select("g", "block", "id", "ban", "vector", *bound))
    near = lists.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("g", "block", "vector", "low", "first", "part")
    wanted = cut(rows.select("g", "block", "id", "at", "last", "vector").groupBy("g", "block").cogroup(near.groupBy("g", "block")).applyInArrow(_wanted, "g BIGINT, id BIGINT, part BIGINT"))
    salts = cut(wanted.groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")))
    ask = wanted.join(F.broadcast(salts), ["g", "part"]).select("id", "part", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    ask = rows.join(ask, "id").select("g", "part", "salt", "id", "ban", F.lit(-1).cast("bigint").alias("list"), F.lit(False).alias("member"), "at", "last", "vector")
    own = home.join(F.broadcast(lists.select("g", "list", "part")), ["g", "list"]).join(F.broadcast(salts), ["g", "part"]).select("id", "list", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = members.join(own, "id").select("g", "part", "salt", "id", "ban", "list", F.lit(True).alias("member"), F.lit(0.0).alias("at"), F.lit(0).cast("bigint").alias("last"), "vector")
    return ask.unionByName(own).groupBy("g", "part", "salt").applyInArrow(_finish(k), "q BIGINT, n BIGINT, ban BIGINT, cos DOUBLE")


def most_similar(frames: DataFrame, bans: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(q, n, cos): of every usable frame q up to ``k`` frames n of other bans in its group with the highest cosine.

    Cosines are rounded to 6 decimals, those below ``least`` do not count, ties go to the smaller id. No neighbour is
    missed. Rows that repeat are one. Of one vector written many times only COPIES rows are indexed, and one row a ban
    searches; the ban's other rows of that vector take its neighbours.
    """
    all_ = cut(usable(frames, bans))
    per_ban = Window.partitionBy("g", "h", "ban").orderBy("id")
    per_vector = Window.partitionBy("g", "h").orderBy("id")
    ranked = all_.withColumn("i", F.row_number().over(per_ban)).filter(F.col("i") <= k).withColumn("j", F.row_number().over(per_vector))
    kept = cut(ranked.withColumn("only", F.col("j") > max(COPIES, 2 * k)).filter((F.col("i") == 1) | ~F.col("only")).select("id", "ban", "g", "h", "i", "only"))
    buckets = max(1, all_.count() // 6000)
    lists, large, centroids = postings(frames, kept.select("id", "ban", "g", "only"))
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("g", "list"), F.lit(buckets)))
    met = lists.groupBy("bucket").applyInArrow(_search(k, least), "q BIGINT, n BIGINT, ban BIGINT, cos DOUBLE")
    found = cut(_best(met.dropDuplicates(["q", "n"]), k))
    if not large.isEmpty():
        # a row that only searches has the indexed copies of its vector, all of other bans
        lone = large.filter("only").select("id").join(kept.select("id", "g", "h"), "id").select(F.col("id").alias("q"), "g", "h")
        first = kept.filter(~F.col("only")).withColumn("nth", F.row_number().over(per_vector)).filter(F.col("nth") <= k)
        found = cut(found.unionByName(lone.join(first, ["g", "h"]).select("q", F.col("id").alias("n"), "ban", F.lit(1.0).alias("cos"))))
        found = cut(_best(found.unionByName(beyond(large, centroids, found, k, least)).dropDuplicates(["q", "n"]), k))
    extra = cut(all_.join(kept.select("id"), "id", "left_anti"))
    if extra.isEmpty():
        return found.select("q", "n", "cos")
    # rows of one vector and ban have the same neighbours
    same = kept.filter("i = 1").select("g", "h", "ban", F.col("id").alias("q"))
    taken = extra.select("id", "g", "h", "ban").join(same, ["g", "h", "ban"]).select("id", "q").join(found.select("q", "n", "cos"), "q").select(F.col("id").alias("q"), "n", "cos")
    return found.select("q", "n", "cos").unionByName(taken)
