"""Matchers: exact membership, Hamming radius, frame fingerprints, vector votes, and their cascade.

Every match is scoped to a tenant (a chat), which is always an equality. Queries and stored rows of a tenant meet in cells
of bounded size: each side is cut into blocks of at most about CELL rows, a cell compares one block of queries with one of
stored rows by whole matrices (popcounts, products), and only what a cell found leaves it. No pair becomes a row of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import cut

# Thresholds and rules used where none is given.
IMAGE_BITS = VIDEO_BITS = 12
MIN_FRAMES, MIN_RATIO = 2, 0.4
VECTOR_SCORE, TOP_K = 0.92, 5
#: Rows of a block, and about the rows that a task gets at a time; numbers compared in one step within a cell.
CELL, STEP = 20_000, 4_000_000


def cells(queries: DataFrame, stored: DataFrame, tenant: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell (a text: tenant and blocks) and bucket (cells that share a task).

    Tenants that only one side has, and rows with a null in ``tenant``, are left out before anything is copied. A row is
    copied once for each block the other side has of its tenant; both sides are counted first, so a tenant of few rows is
    one cell without copies.
    """
    rows = rows or CELL
    known = " and ".join(f"{c} is not null" for c in tenant)
    name = F.concat_ws("\x1f", *tenant)
    q, s = (d.filter(known).withColumn("_t", name) for d in (queries, stored))
    n = F.count(F.lit(1))
    counts = q.groupBy("_t").agg(n.alias("l")).join(s.groupBy("_t").agg(n.alias("r")), "_t")
    blocks = cut(counts.selectExpr("_t", f"cast(ceil(l / {rows}) as int) as _a", f"cast(ceil(r / {rows}) as int) as _b", "l", "r").selectExpr("_t", "_a", "_b", "l * _b + r * _a as copies"))
    buckets = max(1, ceil((blocks.agg(F.sum("copies")).first()[0] or 0) / rows))

    def placed(d: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        columns = [f"`{c}`" for c in d.columns if c != "_t"]
        at = d.join(blocks, "_t").selectExpr("_t", *columns, f"cast(pmod(xxhash64({', '.join(columns)}), {mine}) as int) as {own}", f"explode(sequence(0, {theirs} - 1)) as {other}")
        # new names for all columns: both sides may come from one table
        cell = at.selectExpr(*(f"{c} as {c}" for c in columns), "concat_ws('\x1f', _t, _i, _j) as cell")
        return cell.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))

    return placed(q, "_i", "_a", "_j", "_b"), placed(s, "_j", "_b", "_i", "_a")


def _in_cells(queries: DataFrame, stored: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """What ``compare`` gives for the two sides of each cell, as Arrow tables; both sides have cell and bucket."""

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [c.split()[0] for c in schema.split(", ")]
        out = []
        if left.num_rows and right.num_rows:
            parts = []
            for t in (left, right):
                t = t.take(pc.sort_indices(t, [("cell", "ascending")])).combine_chunks()
                runs = pc.run_end_encode(t.column("cell").combine_chunks())
                ends = runs.run_ends.to_numpy()
                parts.append((t, {c: (a, z) for c, a, z in zip(runs.values.to_pylist(), [0, *ends[:-1]], ends, strict=True)}))
            (lt, la), (rt, ra) = parts
            for cell, (a, z) in la.items():
                if cell in ra:
                    c, y = ra[cell]
                    out += compare(lt.slice(a, z - a), rt.slice(c, y - c))
        columns = list(zip(*out, strict=True)) if out else []
        kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        return pa.table([pa.array(np.concatenate(c) if columns else [], t) for c, t in zip(columns or [[]] * len(names), types, strict=True)], names=names)

    return queries.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(run, schema)


def _lists(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column of whole rows, one after another, and where each row begins (and the last ends)."""
    column = table.column(name).combine_chunks()
    at = column.offsets.to_numpy()
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def exact_blocked(items: DataFrame, blocklist: DataFrame) -> DataFrame:
    """The ``items`` whose (chat_id, file_unique_id) is blocked; an empty or null file_unique_id never is."""
    return items.filter("file_unique_id <> ''").join(blocklist.select("chat_id", "file_unique_id"), ["chat_id", "file_unique_id"], "left_semi")


def _nearest_hash(itself: bool):
    def compare(q, s) -> Iterator[tuple]:
        h, at = _lists(q, "hashes")
        g, to = _lists(s, "hashes")
        h, g = h.view("u8"), g.view("u8")
        ids, owner = q.column("id").to_numpy(), np.repeat(np.arange(len(at) - 1), np.diff(at))
        theirs = None if itself else np.repeat(s.column("id").to_numpy(), np.diff(to))
        g = np.unique(g) if itself else g
        best = np.full(len(ids), 127, np.int64)
        for lo in range(0, len(h), max(1, STEP // max(1, len(g)))):
            z = slice(lo, lo + max(1, STEP // max(1, len(g))))
            d = np.bitwise_count(h[z, None] ^ g[None, :])
            if not itself:
                d[ids[owner[z], None] == theirs[None, :]] = 127
            np.minimum.at(best, owner[z], d.min(1))
        yield ids[best < 127], best[best < 127]

    return compare


def _hashed(d: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the distinct hashes, none null, of rows that have any."""
    return d.select(*columns, F.filter(F.array_distinct("hashes"), lambda h: h.isNotNull()).alias("hashes")).filter(F.size("hashes") > 0)


def image_distances(queries: DataFrame, stored: DataFrame, itself: bool = True) -> DataFrame:
    """(id, distance): the least Hamming distance between any hash of a query (id, chat_id, hashes) and any stored one of its chat.

    Null and empty arrays match nothing, null hashes are ignored. Where a collection is searched for its own rows,
    ``itself`` false leaves out a query's own id.
    """
    q, s = _hashed(queries, "id", "chat_id"), _hashed(stored, *(["chat_id"] if itself else ["id", "chat_id"]))
    met = _in_cells(*cells(q.distinct(), s.distinct(), ["chat_id"]), _nearest_hash(itself), "id BIGINT, distance BIGINT")
    return met.groupBy("id").agg(F.min("distance").cast("int").alias("distance"))


def image_blocked(queries: DataFrame, stored: DataFrame, bits: int = IMAGE_BITS, itself: bool = True) -> DataFrame:
    """(id) of ``queries`` (id, chat_id, hashes) of which any hash lies within ``bits`` of any stored hash of the chat."""
    return image_distances(queries, stored, itself).filter(F.col("distance") <= bits).select("id")


def required_frames(nq: Column, ns: Column, min_frames: int = MIN_FRAMES, min_ratio: float = MIN_RATIO) -> Column:
    return F.greatest(F.lit(min_frames), F.ceil(F.least(nq, ns) * F.lit(min_ratio)).cast("int"))


def _near_frames(bits: int, min_frames: int, min_ratio: float, itself: bool):
    def compare(q, s) -> Iterator[tuple]:
        h, at = _lists(q, "hashes")
        g, to = _lists(s, "hashes")
        h, g = h.view("u8"), g.view("u8")
        qi, si, nq, ns = q.column("q_id").to_numpy(), s.column("s_id").to_numpy(), np.diff(at), np.diff(to)
        lo = 0
        while lo < len(nq):
            # as many whole queries as one step holds, one at least
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max(1, STEP // len(g)), "right")) - 1)
            near = np.bitwise_count(h[at[lo] : at[hi], None] ^ g[None, :]) <= bits
            frames = np.logical_or.reduceat(near, to[:-1], axis=1)
            found = np.add.reduceat(frames, at[lo:hi] - at[lo], axis=0, dtype=np.int64)
            small = np.minimum(nq[lo:hi, None], ns[None, :])
            required = np.maximum(min_frames, np.ceil(small * min_ratio)).astype(np.int64)
            ok = (found >= required) & (small >= required)
            if not itself:
                ok &= qi[lo:hi, None] != si[None, :]
            a, b = np.nonzero(ok)
            yield qi[lo + a], si[b], found[a, b], required[a, b], small[a, b]
            lo = hi

    return compare


def video_matches(queries: DataFrame, stored: DataFrame, bits: int = VIDEO_BITS, min_frames: int = MIN_FRAMES, min_ratio: float = MIN_RATIO, itself: bool = True) -> DataFrame:
    """(q_id, s_id, matched_frames, matched_ratio, reported_frames, reported_ratio) of pairs that pass the rule.

    Both sides have (id, chat_id, hash_version, frames). matched_frames counts query frames with at least one stored
    frame within ``bits``; the rule asks for max(min_frames, ceil(min_ratio * smaller size)). A search that stops when
    the rule is met reports exactly the required number, given as reported_*. Empty frames match nothing; ``itself``
    false leaves out the query's own id. Rows that repeat are one.
    """
    side = lambda d, name: d.select(F.col("id").cast("bigint").alias(name), "chat_id", "hash_version", F.filter(F.transform("frames", lambda f: f["hash"]), lambda h: h.isNotNull()).alias("hashes")).filter(F.size("hashes") > 0).distinct()
    q, s = cells(side(queries, "q_id"), side(stored, "s_id"), ["chat_id", "hash_version"])
    met = _in_cells(q, s, _near_frames(bits, min_frames, min_ratio, itself), "q_id BIGINT, s_id BIGINT, matched BIGINT, required BIGINT, small BIGINT")
    return met.selectExpr("q_id", "s_id", "cast(matched as int) as matched_frames", "matched / small as matched_ratio", "cast(required as int) as reported_frames", "required / small as reported_ratio")


def first_match(matches: DataFrame) -> DataFrame:
    """(q_id, s_id): of each query the stored record that stands first."""
    return matches.groupBy("q_id").agg(F.min("s_id").alias("s_id"))


def _best_vectors(k: int, itself: bool):
    def compare(q, s) -> Iterator[tuple]:
        s = s.sort_by([("ban_id", "ascending"), ("frame_index", "ascending"), ("frame_id", "ascending")]).combine_chunks()
        sides = []
        for t in (q, s):
            flat, at = _lists(t, "vector")
            sides.append((flat.astype(np.float64), at, np.diff(at)))
        (x, xa, xn), (y, ya, yn) = sides
        ban, index, frame = (s.column(c).to_numpy() for c in ("ban_id", "frame_index", "frame_id"))
        ids = q.column("query_id").to_numpy()
        own = None if itself else q.column("own_ban").to_numpy()
        for size in np.intersect1d(xn, yn):
            i, j = np.flatnonzero(xn == size), np.flatnonzero(yn == size)
            a, b = (m[p[rows][:, None] + np.arange(size)] for m, p, rows in ((x, xa, i), (y, ya, j)))
            a, b = (m / np.sqrt((m * m).sum(1, keepdims=True)) for m in (a, b))
            for lo in range(0, len(i), max(1, STEP // len(j))):
                at = i[lo : lo + max(1, STEP // len(j))]
                score = np.round(a[lo : lo + len(at)] @ b.T, 6)
                if not itself:
                    score[own[at, None] == ban[j][None, :]] = -2
                if len(j) > k:  # of each query the k best, ties to the first
                    kth = np.partition(score, len(j) - k, axis=1)[:, len(j) - k, None]
                    tie = score == kth
                    r, c = np.nonzero(((score > kth) | (tie & (np.cumsum(tie, axis=1) <= k - (score > kth).sum(1, keepdims=True)))) & (score >= -1.5))
                else:
                    r, c = np.nonzero(score >= -1.5)
                yield ids[at[r]], ban[j[c]], index[j[c]], frame[j[c]], score[r, c]

    return compare


def vector_top_k(queries: DataFrame, stored: DataFrame, k: int = TOP_K, itself: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, ban_id, frame_index, frame_id, score): the ``k`` stored vectors of the chat with the highest cosine.

    ``queries`` (query_id, chat_id, model_name, model_revision, vector), ``stored`` as of ``sources.artifacts``. Scores
    are rounded to 6 decimals, ties go to the smaller ban, frame, id. Exact; fewer than ``k`` where the chat has fewer.
    Zero vectors and those with a null or NaN match nothing. With ``itself`` false queries have own_ban, which is left
    out. ``within`` names further columns of both sides that must be equal.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    tenant = ["chat_id", "model_name", "model_revision", *within]
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    q = queries.select("query_id", *tenant, *([] if itself else ["own_ban"]), "vector").filter(fine)
    s = stored.select("ban_id", F.coalesce("frame_index", F.lit(0)).cast("int").alias("frame_index"), "frame_id", *tenant, "vector").filter(fine)
    met = _in_cells(*cells(q, s, tenant), _best_vectors(k, itself), "query_id BIGINT, ban_id BIGINT, frame_index INT, frame_id BIGINT, score DOUBLE")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ban_id", "frame_index", "frame_id")
    met = met.dropDuplicates(["query_id", "frame_id"]) if within else met
    return met.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def static_vote(hits: DataFrame, score: float = VECTOR_SCORE) -> DataFrame:
    """(item_id, blocked): whether any hit of an item of one frame reaches ``score``."""
    return hits.groupBy("item_id").agg((F.max("score") >= score).alias("blocked"))


def frame_vote(hits: DataFrame, checked: DataFrame, score: float = VECTOR_SCORE, min_frames: int = MIN_FRAMES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(item_id, ban_id, frames): bans that enough of an item's frames hit.

    ``hits`` (item_id, frame, ban_id, score) are the top k of each frame, taken before the threshold; ``checked``
    (item_id, checked_frames). A frame votes once for a ban; the ratio is to the item's own frames.
    """
    votes = hits.filter(F.col("score") >= score).groupBy("item_id", "ban_id").agg(F.count_distinct("frame").alias("frames"))
    return votes.join(checked, "item_id").filter((F.col("frames") >= min_frames) & (F.col("frames") / F.col("checked_frames") >= min_ratio)).select("item_id", "ban_id", "frames")


def cascade(items: DataFrame, tiers: list[tuple[str, DataFrame | Callable[[DataFrame], DataFrame]]], errors: DataFrame | None = None) -> DataFrame:
    """(id, status, matched_by): the first tier that has an item decides; later tiers see only what is left.

    ``tiers`` are (name, ids) in order, or (name, function) where the function is given the items that are left and gives
    the ids it has; ``errors`` (id, tier) are items whose check fails in a tier, which ends their cascade unless an
    earlier tier has them. status is blocked, error or clean. Each tier is computed once and then cut.
    """
    left, out = items.select("id").distinct(), []
    for name, tier in tiers:
        ids = tier(items.join(left, "id", "left_semi")) if callable(tier) else tier
        seen = ids.select("id", F.lit("blocked").alias("status"), F.lit(0).alias("rank"))
        if errors is not None:
            seen = seen.unionByName(errors.filter(F.col("tier") == name).select("id", F.lit("error").alias("status"), F.lit(1).alias("rank")))
        verdict = seen.groupBy("id").agg(F.min_by("status", "rank").alias("status"))
        step = cut(left.join(verdict, "id", "left"))
        out.append(step.filter("status is not null").select("id", "status", F.lit(name).alias("matched_by")))
        left = step.filter("status is null").select("id")
    out.append(left.select("id", F.lit("clean").alias("status"), F.lit(None).cast("string").alias("matched_by")))
    d = out[0]
    for more in out[1:]:
        d = d.unionByName(more)
    return d
