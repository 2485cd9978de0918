"""Mixing sources to target weights (problem 8).

Method: min-cost flow for overlapping sources. Documents with one text are one item that belongs to every source it
occurs in; items are aggregated by this membership pattern. Token capacity is routed from patterns to source quotas, and
using a pattern for the second, third ... time costs more each time. Documents are then selected in a seeded order.

All patterns are routed, however many there are (at most 2 ** sources, and no more than texts): the driver holds numbers
of their memberships in arrays, and moves the tokens of all patterns from source to source at once.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from siftlane.session import cut

#: Items of one range of the seeded order, within which sizes are summed one by one.
RANGE = 4000
#: Patterns with the most items whose use is broadcast to the items; that of the others meets them in a shuffle.
PATTERNS = 20_000
#: Unused items of one source and size class (powers of two) looked at in the first round of filling what rounding left of
#: a quota; each further round looks at so many times as many, until nothing that has uses left fits.
SPARE, MORE = 64, 4


def _part(room: np.ndarray, push: int) -> np.ndarray:
    """``push`` put into ``room``, from its start on."""
    return np.clip(push - (np.cumsum(room) - room), 0, room)


class Flow:
    """Tokens from patterns to sources; ``pattern`` and ``source`` have an entry for each membership, sorted by pattern.

    A token costs as much as its pattern has been used up before, whichever way it takes; so all that can be routed at
    the first use is routed first, then all at the second. A step moves what it can of all patterns along a shortest path
    of sources, so the number of steps depends on the number of sources, not of patterns.
    """

    def __init__(self, pattern: np.ndarray, source: np.ndarray, size: np.ndarray, repeats: np.ndarray) -> None:
        self.pattern, self.source, self.size = pattern, source, size
        self.at = [np.flatnonzero(source == k) for k in range(len(repeats))]
        self.starts = np.flatnonzero(np.diff(pattern, prepend=-1))
        self.most = np.maximum.reduceat(repeats[source], self.starts)
        self.cap = size[pattern] * repeats[source]
        self.flow = np.zeros(len(pattern), np.int64)

    def _new(self, k: int, supply: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of source ``k``, and what each can take of its pattern's supply."""
        e = self.at[k]
        return e, np.minimum(supply[self.pattern[e]], self.cap[e] - self.flow[e])

    def _moved(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of sources ``a`` and ``b`` in one pattern, and what can be moved from one to the other."""
        x, y = self.at[a], self.at[b]
        at = np.searchsorted(self.pattern[y], self.pattern[x])
        both = np.isin(self.pattern[x], self.pattern[y], assume_unique=True)
        x, y = x[both], y[at[both]]
        return x, y, np.minimum(self.flow[x], self.cap[y] - self.flow[y])

    def reached(self, supply: np.ndarray, lack: np.ndarray | None = None) -> tuple[dict[int, int | None], int | None]:
        """The sources that supply reaches, each with the one before it; only up to the first that lacks tokens, if given."""
        via = {k: None for k in range(len(self.at)) if self._new(k, supply)[1].any()}
        queue = deque(via)
        while queue:
            a = queue.popleft()
            if lack is not None and lack[a]:
                return via, a
            for b in range(len(self.at)):
                if b not in via and self._moved(a, b)[2].any():
                    via[b] = a
                    queue.append(b)
        return via, None

    def route(self, quota: np.ndarray) -> np.ndarray:
        """What each source lacks when as much as possible is routed at the least cost."""
        self.flow[:], lack = 0, quota.copy()
        for use in range(self.most.max()):
            supply = np.where(self.most > use, self.size, 0)
            while (found := self.reached(supply, lack))[1] is not None:
                via, end = found
                path = [end]
                while via[path[-1]] is not None:
                    path.append(via[path[-1]])
                steps = list(zip(path[1:], path, strict=False))  # from the end on, so each leaves room for the one before
                push = min(lack[end], self._new(path[-1], supply)[1].sum(), *(self._moved(a, b)[2].sum() for a, b in steps))
                for a, b in steps:
                    x, y, room = self._moved(a, b)
                    n = _part(room, push)
                    self.flow[x] -= n
                    self.flow[y] += n
                e, room = self._new(path[-1], supply)
                n = _part(room, push)
                self.flow[e] += n
                supply[self.pattern[e]] -= n
                lack[end] -= push
        return lack


def _routed(net: Flow, share: list[float], total: int | None) -> np.ndarray:
    """Tokens by entry of ``net``. Without ``total`` as many as all shares can be met with.

    That number is found by cuts: while a quota cannot be met, the sources cut off bound it by their capacity.
    """
    most = net.size * net.most
    want = int(most.sum()) if total is None else total
    while True:
        lack = net.route(np.array([int(w * want) for w in share], np.int64))
        if total is not None or not lack.any():
            return net.flow
        via, _ = net.reached(most - np.add.reduceat(net.flow, net.starts))
        short = np.array([k not in via for k in range(len(share))])
        if not (weight := sum(w for w, s in zip(share, short, strict=True) if s)):
            return net.flow
        # capacity of the cut towards these sources
        into = np.add.reduceat(np.where(short[net.source], net.cap, 0), net.starts)
        want = min(want - 1, int(np.minimum(into, most).sum() / weight))


def routed(patterns: list[tuple[tuple[str, ...], int]], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[tuple[int, str], int]:
    """Tokens by (pattern, source); see _routed."""
    names = sorted(share)
    entries = [(p, names.index(s)) for p, (members, _) in enumerate(patterns) for s in members]
    pattern, source = np.array(entries, np.int64).T
    net = Flow(pattern, source, np.array([n for _, n in patterns], np.int64), np.array([repeats[s] for s in names], np.int64))
    flow = _routed(net, [share[s] for s in names], total)
    return {(p, names[k]): int(f) for (p, k), f in zip(entries, flow, strict=True) if f}


_PLAN = "pattern STRING, tokens BIGINT, used BIGINT, spans ARRAY<STRUCT<source: STRING, a: BIGINT, z: BIGINT>>"


def mix(docs: DataFrame, target: DataFrame, key: str = "doc_id", source: str = "source", text_hash: str = "text_hash", size: str = "n_tokens", total: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, uses): the documents chosen, each with the number of times it is used.

    ``target`` (source, target_share, max_repeats) is a table of settings; shares are scaled to sum 1 over the sources
    that have any tokens. Documents without tokens, or of a null source or one without a share, are never chosen; one
    with several rows counts once. Documents with equal texts are one item: it stands for each of its sources by that
    source's smallest id, at most max_repeats times for this source, and in all no more often than the largest
    max_repeats among its sources. The total is ``total`` tokens, or as many as all shares can be met with; each
    source then gets its share less what no document of it that has uses left could fill.
    """
    settings = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in target.collect() if r["source"] is not None and r["target_share"] and (r["max_repeats"] or 0) > 0}
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text_hash).alias("t"), F.col(size).cast("bigint").alias("n"))
    d = d.filter((F.col("n") > 0) & F.col("source").isin(list(settings)))
    # copies are combined before they are shuffled; an item has one entry a source
    one = d.groupBy("t", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    items = one.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.max("n").alias("n"))
    items = cut(items.withColumn("pattern", F.array_join(F.col("members.source"), "\x1f")))
    sums = items.groupBy("pattern").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("items"))
    found = sums.orderBy("pattern").toArrow().combine_chunks()  # a row a pattern
    members = pc.split_pattern(found["pattern"], "\x1f").combine_chunks()
    flat = members.flatten()
    there = sorted(flat.unique().to_pylist())
    weight = sum(settings[s][0] for s in there)
    pattern, source = np.repeat(np.arange(len(members)), pc.list_value_length(members)), pc.index_in(flat, pa.array(there, pa.string())).to_numpy()
    flow, used = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if there:
        net = Flow(pattern, source, found["tokens"].to_numpy(), np.array([settings[s][1] for s in there], np.int64))
        flow = _routed(net, [settings[s][0] / weight for s in there], total)
        used = np.add.reduceat(flow, net.starts)
    # where in its pattern each source's tokens lie
    ends = np.cumsum(flow) - np.repeat(np.cumsum(used) - used, pc.list_value_length(members))
    some = flow > 0
    spans = pa.StructArray.from_arrays([flat.filter(pa.array(some)), pa.array((ends - flow)[some]), pa.array(ends[some])], ["source", "a", "z"])
    offsets = np.append(0, np.cumsum(np.bincount(pattern[some], minlength=len(members))))
    uses_of = pa.table({"pattern": found["pattern"], "tokens": found["tokens"], "used": pa.array(used), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)})
    by_items = np.argsort(-found["items"].to_numpy(), kind="stable")
    spark = docs.sparkSession
    plans = [F.broadcast(spark.createDataFrame(uses_of.take(by_items[:PATTERNS]), StructType.fromDDL(_PLAN)))]
    if len(by_items) > PATTERNS:
        plans.append(spark.createDataFrame(uses_of.take(by_items[PATTERNS:]), StructType.fromDDL(_PLAN)))
    # the seeded order of a pattern's items, and where each begins: sums of ranges, then sums within a range
    bits = max(1, ceil(log2(max(2, int(found["items"].to_numpy().sum()) / RANGE))))
    order = F.xxhash64("t", F.lit(seed))
    placed = items.withColumns({"u": order, "range": F.shiftrightunsigned(order, 64 - bits)})
    sums = placed.groupBy("pattern", "range").agg(F.sum("n").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("pattern").orderBy("range")) - F.col("in_range")
    inside = F.sum("n").over(Window.partitionBy("pattern", "range").orderBy("u", "t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = placed.withColumn("inside", inside).join(sums.withColumn("before", before).drop("in_range"), ["pattern", "range"])
    placed = reduce(DataFrame.unionByName, [placed.join(plan, "pattern") for plan in plans])
    # an item is used wherever it lies, moved on by whole passes over the pattern, within what one source uses
    at = F.col("before") + F.col("inside")
    passes = F.floor((F.col("used") - at - F.col("n")) / F.col("tokens")).cast("int") + 1
    placed = cut(placed.withColumns({"at": at, "passes": F.greatest(passes, F.lit(0))}).select("t", "members", "n", "spans", "at", "tokens", "passes"))
    uses = placed.filter("passes > 0").select("t", "members", "n", "spans", "at", "tokens", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    uses = uses.select("t", "members", "n", "spans", (F.col("at") + F.col("pass") * F.col("tokens")).alias("at"))
    # an item across two spans has none
    span = F.get(F.filter("spans", lambda s: (s["a"] <= F.col("at")) & (F.col("at") + F.col("n") <= s["z"])), 0)["source"]
    uses = cut(uses.select("t", "members", "n", span.alias("s")).filter("s is not null"))
    quota = {s: int(flow[source == k].sum()) for k, s in enumerate(there)}
    had = {r["s"]: r["n"] for r in uses.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    uses = uses.unionByName(_filled(placed, uses, {s: q - had.get(s, 0) for s, q in quota.items() if q > had.get(s, 0)}, {s: r for s, (_, r) in settings.items()}))
    uses = uses.select(F.filter("members", lambda m: m["source"] == F.col("s"))[0].alias("m"), "n")
    return uses.groupBy("m.doc_id", "m.source").agg(F.max("n").alias("n_tokens"), F.count(F.lit(1)).alias("uses"))


def _filled(items: DataFrame, uses: DataFrame, short: dict[str, int], repeats: dict[str, int]) -> DataFrame:
    """(t, members, n, s): further uses that fill what each source is ``short`` of, never beyond it.

    What is missing is less than the items at the ends of a source's spans. It is filled in rounds with items that have
    uses left, largest first; a round looks at a number of items of each size class, the next one at more of those that
    still have uses left and fit, until there are none. So the driver holds no more rows than a multiple of the uses it
    adds, and what still lacks is less than any item of the source that has uses left.
    """
    spark = items.sparkSession
    short = dict(short)
    none = spark.createDataFrame([], items.select("t", "members", "n", F.lit("").alias("s")).schema)
    if not short:
        return none
    table_of = lambda of: F.create_map(*(F.lit(x) for s, k in of.items() for x in (s, k)))
    most = table_of(repeats)
    free = items.select("t", "n", F.array_max(F.transform("members", lambda m: F.element_at(most, m["source"]))).alias("in_all"), F.explode("members.source").alias("s"))
    free = free.filter(F.col("n") <= F.coalesce(F.element_at(table_of(short), F.col("s")), F.lit(0)))
    # an item may be used so often for one source, and so often in all
    here, there = uses.groupBy("t", "s").agg(F.count(F.lit(1)).alias("here")), uses.groupBy("t").agg(F.count(F.lit(1)).alias("there"))
    free = free.join(here, ["t", "s"], "left").join(there, "t", "left").withColumns({"left": F.element_at(most, F.col("s")) - F.coalesce("here", F.lit(0)), "in_all": F.col("in_all") - F.coalesce("there", F.lit(0))}).filter("left > 0 and in_all > 0 and t is not null")
    free = cut(free.select("t", "n", "s", "left", "in_all"))
    w = Window.partitionBy("s", F.floor(F.log2("n"))).orderBy(F.desc("n"), F.xxhash64("t"), "t")
    given, in_all, limit = {}, {}, SPARE
    while lacking := {s: k for s, k in short.items() if k > 0}:
        open_ = free.filter(F.col("n") <= F.coalesce(F.element_at(table_of(lacking), F.col("s")), F.lit(0)))
        if given:
            # what earlier rounds used up; a row an item they chose
            gone = [(t, s, k) for (t, s), k in given.items()]
            own = F.broadcast(spark.createDataFrame(gone, "t STRING, s STRING, _own INT"))
            all_ = F.broadcast(spark.createDataFrame(list(in_all.items()), "t STRING, _all INT"))
            open_ = open_.join(own, ["t", "s"], "left").join(all_, "t", "left").filter("left > coalesce(_own, 0) and in_all > coalesce(_all, 0)")
        seen = open_.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit).select("t", "n", "s", "left", "in_all").collect()
        if not seen:
            break
        for r in sorted(seen, key=lambda r: (-r["n"], r["t"], r["s"])):
            t, s = r["t"], r["s"]
            k = min(short[s] // r["n"], r["left"] - given.get((t, s), 0), r["in_all"] - in_all.get(t, 0))
            if k > 0:
                short[s] -= k * r["n"]
                given[t, s] = given.get((t, s), 0) + k
                in_all[t] = in_all.get(t, 0) + k
        limit *= MORE
    if not given:
        return none
    picked = F.broadcast(spark.createDataFrame([(t, s, k) for (t, s), k in given.items()], "t STRING, s STRING, k INT"))
    return items.join(picked, "t").select("t", "members", "n", "s", F.explode(F.sequence(F.lit(1), "k"))).drop("col")


def shares(chosen: DataFrame, target: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, documents, most_uses): what each source reached; 0 where none was chosen."""
    by = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    all_ = by.agg(F.sum("tokens").alias("all_tokens"))
    d = target.join(by, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
    return d.join(F.broadcast(all_)).select("source", "target_share", "max_repeats", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"), "documents", "most_uses")
