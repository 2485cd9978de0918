"""Repeated consecutive events in sequences (problem 4).

Method: per entity the events become a string of code points, one per canonical event; a regular expression with a
backreference finds its repetitions, whose spans are mapped back to index and time.

A canonical event is a class of hashes: hashes of neighbouring events that differ by at most ``bits`` bits are of one
class, and so is what they are linked with. Near neighbours therefore always have one symbol. The converse does not hold,
as a class may drift: a span is cut once more where two neighbours in it are further apart. Events without a hash have a
symbol the expression does not repeat. A string covers one block of an entity's index range, so that an entity of any
length is never gathered in one task; runs that touch across blocks are joined by their ends afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import cut

#: Index range of a block; one string has at most so many symbols.
BLOCK = 4096
#: Symbols of a block are code points from here on; there are enough for blocks of up to a million events.
FIRST = 0x10000

_REPEATED = re.compile("([^\0])\\1*|\0")
_RUN = "entity BIGINT, block BIGINT, n_blocks BIGINT, edge BOOLEAN, first_index INT, last_index INT, n BIGINT, first_millis INT, last_millis INT, head BIGINT, tail BIGINT"


def _canonical(owner: np.ndarray, h: np.ndarray, has: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The symbol of each event: its class's place among those of its block, from 1 on; 0 without a hash."""
    order = np.lexsort((h, ~has, owner))
    fresh = np.append(True, (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1]) | (has[order][1:] != has[order][:-1]))
    node = np.empty(len(h), np.int64)
    node[order] = np.cumsum(fresh) - 1
    label = np.arange(int(fresh.sum()))
    a, b = node[:-1][same[1:]], node[1:][same[1:]]
    while True:  # the smaller label spreads along links and then jumps to that label's own
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        label = label[label]
    classes = label[node]
    first = np.zeros(len(label), np.int64)
    first[node[order][fresh]] = owner[order][fresh]
    below = np.searchsorted(first, owner)  # nodes of earlier blocks; nodes stand in the order of blocks
    return np.where(has, classes - below + 1, 0)


def _pieces(start: int, end: int, apart: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the pieces of a span, cut before events that are not near the one before them."""
    at = apart[np.searchsorted(apart, start, "right") : np.searchsorted(apart, end)].tolist() if end - start > 1 else []
    return [(a, z - 1) for a, z in zip([start, *at], [*at, end], strict=True)]


def _cut(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            frames = batch.column("frames")
            flat = frames.flatten()
            sizes = np.diff(frames.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            index, millis, hashes = (flat.field(k) for k in range(3))
            idx = index.to_numpy()
            has = hashes.is_valid().to_numpy(zero_copy_only=False)
            h = hashes.fill_null(0).to_numpy().view("u8")
            timed = millis.is_valid().to_numpy(zero_copy_only=False)
            ms = millis.fill_null(0).to_numpy().astype("i8")
            same = np.zeros(len(idx), bool)
            same[1:] = (owner[1:] == owner[:-1]) & has[1:] & has[:-1] & (np.bitwise_count(h[1:] ^ h[:-1]) <= bits)
            symbols = _canonical(owner, h, has, same)
            text = np.where(symbols > 0, symbols + FIRST, 0).astype("<u4").tobytes().decode("utf-32-le")
            apart = np.flatnonzero(~same)
            out: list[tuple] = []
            entity, block, n_blocks = (batch.column(k).to_pylist() for k in ("entity", "block", "n_blocks"))
            start = 0
            for k, size in enumerate(sizes):
                end = start + size
                spans = ((m.start(), m.end()) for m in _REPEATED.finditer(text, start, end))
                for a, z in (x for span in spans for x in _pieces(*span, apart)):
                    edge = n_blocks[k] > 1 and (a == start or z == end - 1)
                    if z > a or edge:
                        times = ms[a : z + 1][timed[a : z + 1]]
                        low, high = (int(times.min()), int(times.max())) if len(times) else (None, None)
                        out.append((entity[k], block[k], n_blocks[k], edge, int(idx[a]), int(idx[z]), z - a + 1, low, high, int(h[a : a + 1].view("i8")[0]) if has[a] else None, int(h[z : z + 1].view("i8")[0]) if has[z] else None))
                start = end
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(11)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in _RUN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def runs(events: DataFrame, entity: str, index: str, millis: str, hash_: str, bits: int = 4, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(entity, first_index, last_index, n_events, first_millis, last_millis, duration_millis): runs of ``least`` or more.

    Events stand in the order of ``index``; a missing index does not end a run, an event without a hash does. Equal rows
    are one event; of different rows with one (entity, index) the one with the smallest hash, then position, stands
    (a missing hash or position comes last). Rows without entity or index are left out. The duration spans the known
    positions of a run and is null if it has none. Other columns of ``events`` are ignored. ``least`` must be 2 or more.
    """
    d = events.select(F.col(entity).cast("bigint").alias("entity"), F.col(index).cast("int").alias("i"), F.col(millis).cast("int").alias("ms"), F.col(hash_).cast("bigint").alias("h"))
    d = d.filter(F.col("entity").isNotNull() & F.col("i").isNotNull())
    late = F.struct(F.col("h").isNull(), "h", F.col("ms").isNull(), "ms")
    one = F.struct("i", F.col("best.ms"), F.col("best.h"))
    # one partial aggregation removes copies before anything is gathered; a block then has one event an index
    d = d.groupBy("entity", "i").agg(F.min(F.struct(late.alias("o"), "ms", "h")).alias("best"))
    blocks = d.groupBy("entity", F.floor(F.col("i") / block).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("frames"))
    heads = blocks.groupBy("entity").agg(F.count(F.lit(1)).alias("n_blocks"))
    counted = blocks.join(heads, "entity").select("entity", "block", "n_blocks", F.col("frames").cast("array<struct<i:int,ms:int,h:bigint>>").alias("frames"))
    cut_ = cut(counted.mapInArrow(_cut(bits), _RUN))
    inner = cut_.filter(~F.col("edge"))
    # the ends of blocks, joined where the tail of one continues in the head of the next
    w = Window.partitionBy("entity").orderBy("first_index")
    edges = cut_.filter("edge")
    joins = (F.lag("block").over(w) < F.col("block")) & (F.bit_count(F.lag("tail").over(w).bitwiseXOR(F.col("head"))) <= bits)
    joined = (
        edges.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        .withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "session")
        .agg(F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"), F.sum("n").alias("n"), F.min("first_millis").alias("first_millis"), F.max("last_millis").alias("last_millis"))
    )
    names = ["entity", "first_index", "last_index", F.col("n").alias("n_events"), "first_millis", "last_millis", (F.col("last_millis") - F.col("first_millis")).alias("duration_millis")]
    return inner.select("entity", "first_index", "last_index", "n", "first_millis", "last_millis").unionByName(joined.drop("session")).filter(F.col("n") >= least).select(*names)
