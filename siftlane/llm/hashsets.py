"""Near-duplicate sets of 64-bit hashes (problem 5), and the pieces other operators share.

Two sets are similar if their share, (elements of a near some element of b + elements of b near some of a) / (both
sizes), reaches ``cover``; near means at most ``bits`` different bits.

Method: token-combination prefixes. An element is cut into bits + 1 pieces, its tokens; near elements have a token in
common. If a pair is similar, one side has at least the share ``cover`` of its elements near the other, so any prefix of
it that weighs more than the rest, 1 - cover, holds a near element. Prefixes take the least frequent elements first. A
token that few rows have is a key by itself; a frequent one is extended by the tokens of the bits outside it, again
bits + 1 pieces, so combinations of two and three tokens are indexed there. Rows that share a key meet in one task, where
their elements are compared at once, so only pairs with a near element leave it; these are verified over all elements. A
near pair shares many keys and leaves only one of them: that of the lowest token it has in common at each level. A key that
even at the last level has more than BLOCK rows is split into blocks, which meet block by block.

Memory: keys come sorted, so a task holds about ROWS rows and one key, which has at most HEAVY rows, and compares CELLS
pairs of elements at once, however many rows its partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.operators.skew import heavy_keys, lookup
from siftlane.session import cut

#: Buckets of the frequency sketch that orders prefixes: its size is fixed, whatever the input.
SKETCH = 1 << 16
#: A token that more rows have is extended by further tokens, up to LEVELS tokens in a combination.
FREQUENT, LEVELS = 32, 3
#: Tokens in buckets with more rows than this may be hot: they are counted before they are shuffled, the others within
#: the partition that joins them.
HEAVY = 200_000
#: Rows of a key, or of a class, that meet in one task; more are split into blocks of about so many.
BLOCK = 4096
#: Rows that a task holds of a partition, and of the pairs it found, and pairs of elements that it compares at once.
ROWS, CELLS = 1 << 18, 1 << 20


def pieces(width: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of ``n`` disjoint pieces that make up ``width`` bits."""
    at = [round(width * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(g: np.ndarray, h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for p, (low, size) in enumerate(pieces(64, bits + 1)):
        token = (h >> np.uint64(low)) & np.uint64((1 << size) - 1)
        yield (_mix(_mix(g ^ np.uint64(p + 1)) ^ token) % np.uint64(SKETCH)).astype(np.int64)


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each element, element, and number of the row it belongs to."""
    elems = batch.column("elems")
    sizes = np.diff(elems.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    return batch.column("g").to_numpy().view("u8")[row], elems.flatten().to_numpy().view("u8"), row


def _count(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            g, h, _ = _flat(batch)
            for b in _buckets(g, h, bits):
                total += np.bincount(b, minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def _prefixes(bits: int, cover: float, sketch, heavy: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            g, h, row = _flat(batch)
            heat = sum(sketch.value[b] for b in _buckets(g, h, bits))
            order = np.lexsort((h, heat, row))
            g, h, row = g[order], h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            weight = np.diff(np.append(at, len(h)))
            sizes = np.bincount(row, minlength=batch.num_rows)
            starts = np.append(0, np.cumsum(sizes))[:-1]
            before = at - starts[row[at]]  # weight of the elements before this one in its row
            rest = np.floor((1 - cover) * sizes[row[at]] + 1e-9)
            hot = sum((sketch.value[b] > heavy).astype(np.int32) << p for p, b in enumerate(_buckets(g[at], h[at], bits)))
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view("i8")), pa.array(batch.column("id").to_numpy()[row[at]]), pa.array(h[at].view("i8")), pa.array(before <= rest), pa.array(weight), pa.array(hot)], ["g", "id", "e", "x", "w", "hot"])

    return run


def elements(rows: DataFrame, bits: int, cover: float) -> tuple[DataFrame, bool]:
    """(g, id, e, x, w, hot): the distinct elements of ``rows`` (g, id, elems), whether each is in the prefix, its weight.

    Bit p of ``hot`` is set if the element's token p may be one that very many rows have; the second value tells
    whether any is.
    """
    counted = rows.mapInArrow(_count(bits), "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    sketch = np.zeros(SKETCH, np.int64)
    for bucket, n in counted.collect():  # at most SKETCH rows
        sketch[bucket] = n
    out = rows.mapInArrow(_prefixes(bits, cover, rows.sparkSession.sparkContext.broadcast(sketch), HEAVY), "g BIGINT, id BIGINT, e BIGINT, x BOOLEAN, w BIGINT, hot INT")
    return out, bool((sketch > HEAVY).any())


def tokens(seed: str, value: str, width: int, bits: int) -> str:
    """SQL of an array of (key, p, rest): the tokens of a value of at most ``width`` bits, and its bits outside each token."""
    out = []
    for p, (low, size) in enumerate(pieces(width, bits + 1)):
        token = f"shiftrightunsigned({value}, {low}) & {(1 << size) - 1}L"
        high = f"shiftleft(shiftrightunsigned({value}, {low + size}), {low})" if low + size < 64 else "0L"
        out.append(f"named_struct('key', xxhash64({seed}, {p}, {token}), 'p', {p}, 'rest', {high} | {value} & {(1 << low) - 1}L)")
    return f"array({', '.join(out)})"


def _rests(value: np.ndarray, p: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The bits of each value outside its token p."""
    out = np.zeros_like(value)
    for k, (low, size) in enumerate(pieces(width, bits + 1)):
        at = p == k
        v = value[at]
        high = (v >> np.uint64(low + size)) << np.uint64(low) if low + size < 64 else np.zeros_like(v)
        out[at] = high | v & np.uint64((1 << low) - 1)
    return out


def _first(d: np.ndarray, path: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Whether the tokens of ``path`` are the lowest that elements with the difference ``d`` have in common at each level."""
    out, width = np.ones(len(d), bool), 64
    for k in range(level - 1, -1, -1):
        p = path // (bits + 1) ** k % (bits + 1)
        for q, (low, size) in enumerate(pieces(width, bits + 1)):
            out &= (p <= q) | ((d >> np.uint64(low)) & np.uint64((1 << size) - 1) != 0)
        if k:
            d, width = _rests(d, p, width, bits), width - min(size for _, size in pieces(width, bits + 1))
    return out


def _near(e: np.ndarray, x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, i, j) of near elements i and j in the rows of ``e``, one of them in a prefix; each pair once, CELLS at once."""
    n, m = e.shape
    if m * m <= CELLS >> 6:  # with more rows, those in a prefix are few
        across = CELLS // (m * m)
        for lo in range(0, n, across):
            at = slice(lo, lo + across)
            near = np.bitwise_count(e[at, :, None] ^ e[at, None, :]) <= bits
            near &= (x[at, :, None] | x[at, None, :]) & np.triu(np.ones((m, m), bool), 1)
            run, i, j = np.nonzero(near)
            yield run + lo, i, j
        return
    for run in range(n):
        own = np.flatnonzero(x[run])
        for lo in range(0, len(own), step := max(1, CELLS // m)):
            i = own[lo : lo + step]
            near = np.bitwise_count(e[run, i, None] ^ e[run, None, :]) <= bits
            near &= ~x[run] | (i[:, None] < np.arange(m))
            at, j = np.nonzero(near)
            yield np.full(len(j), run), i[at], j


def _pairs_of(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, e: np.ndarray, px: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """(a, b), a < b, in rows: near elements of different ids, one of them in a prefix, within runs of sorted rows."""
    for m in np.unique(sizes):
        first = starts[sizes == m]
        for lo in range(0, len(first), step := max(1, ROWS // int(m))):
            at = first[lo : lo + step, None] + np.arange(m)
            for run, i, j in _near(e[at], px[at] & 1 == 1, bits):
                i, j = at[run, i], at[run, j]
                keep = (ids[i] != ids[j]) & _first(e[i] ^ e[j], px[i] >> 1, level, bits)
                a, b = ids[i[keep]], ids[j[keep]]
                yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _once(pairs: list[np.ndarray]) -> np.ndarray:
    p = np.concatenate(pairs)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return p[np.append(True, (p[1:] != p[:-1]).any(1))] if len(p) else p


def _whole_keys(batches: Iterator) -> Iterator:
    """Tables of whole keys, of about ROWS rows or a single longer key, from batches sorted by key."""
    import pyarrow as pa

    parts, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        at = int(np.searchsorted(key, key[-1]))  # where the last key begins, which may go on
        if n + at >= ROWS and (at or last != key[0]):
            yield pa.Table.from_batches([*parts, batch.slice(0, at)])
            parts, n, batch = [], 0, batch.slice(at)
        parts.append(batch)
        n, last = n + batch.num_rows, key[-1]
    if parts:
        yield pa.Table.from_batches(parts)


_MET = "a BIGINT, b BIGINT, key BIGINT, id BIGINT, e BIGINT, px INT, v BIGINT, nx BIGINT, n BIGINT"


def _meet(bits: int, width: int, level: int, limit: int):
    """For rows sorted by key: the near pairs of keys with at most ``limit`` rows; the rows of the others, with what is left of v.

    Keys without a prefix element, or of a single row, end here.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in _MET.split(", ")]
        types = [pa.int32() if c == "px" else pa.int64() for c in names]

        def batch_of(size: int, **own: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

        def pairs_of(parts: list[np.ndarray]):
            p = _once(parts)
            return batch_of(len(p), a=p[:, 0], b=p[:, 1])

        found, held = [], 0
        for table in _whole_keys(batches):
            key, ids, px = (table.column(c).to_numpy() for c in ("key", "id", "px"))
            e, v = (table.column(c).to_numpy().view("u8") for c in ("e", "v" if "v" in table.column_names else "e"))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            nx = np.add.reduceat((px & 1).astype(np.int64), starts)
            alive = (sizes > 1) & (nx > 0)
            small = alive & (sizes <= limit)
            for pairs in _pairs_of(starts[small], sizes[small], ids, e, px, level, bits):
                found.append(pairs)
                held += len(pairs)
                if held >= ROWS:
                    yield pairs_of(found)
                    found, held = [], 0
            more = np.repeat(alive & ~small, sizes)
            if m := int(more.sum()):
                left = _rests(v[more], (px[more] >> 1) % (bits + 1), width, bits)
                yield batch_of(m, key=key[more], id=ids[more], e=e[more].view("i8"), px=px[more], v=left.view("i8"), nx=np.repeat(nx, sizes)[more], n=np.repeat(sizes, sizes)[more])
        if held:
            yield pairs_of(found)

    return run


def _split(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) of keys with very many rows: blocks of prefix elements meet blocks of all elements, each in its own place."""
    p = rows.filter("px & 1 = 1").selectExpr("key", "id as a", "e as ea", f"cast(pmod(xxhash64(id), ceil(nx / {BLOCK})) as int) as i", f"explode(sequence(0, cast(ceil(n / {BLOCK}) as int) - 1)) as j")
    q = rows.selectExpr("key", "id as b", "e as eb", f"explode(sequence(0, cast(ceil(nx / {BLOCK}) as int) - 1)) as i", f"cast(pmod(xxhash64(id), ceil(n / {BLOCK})) as int) as j")
    met = p.join(q, ["key", "i", "j"]).filter(f"a <> b and bit_count(ea ^ eb) <= {bits}")
    return met.selectExpr("least(a, b) as a", "greatest(a, b) as b")


def _hot_rows(at: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(few, many) of rows whose key may be hot, told apart by counts made before anything is shuffled; many has n and nx."""
    counts = cut(at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("px").bitwiseAND(1)).alias("nx")))
    seen = lookup(at, counts, "key", cut(heavy_keys(counts, "key")), "inner").filter("n > 1 and nx > 0")
    return seen.filter(F.col("n") <= limit).drop("n", "nx"), seen.filter(F.col("n") > limit)


def near_elements(elems: DataFrame, any_hot: bool, bits: int) -> DataFrame:
    """(a, b), a < b, each once: rows of which one has a prefix element near some element of the other.

    Level by level: the rows of keys that at most FREQUENT rows have, or of the last level, meet; the others go on with
    one more token.
    """
    at = elems.select("id", "e", "x", "hot", F.explode(F.expr(tokens("g", "e", 64, bits))).alias("t"))
    # px: the tokens so far, a digit each, and whether the element is in the prefix
    at = at.selectExpr("t.key as key", "id", "e", "t.p * 2 + cast(x as int) as px", *(["shiftright(hot, t.p) & 1 = 1 as hot"] if any_hot else []))
    width, found = 64, []
    for level in range(1, LEVELS + 1):
        limit = BLOCK if level == LEVELS else FREQUENT
        many = None
        if any_hot:
            at = cut(at)
            few, many = _hot_rows(at.filter("hot").drop("hot"), limit)
            at = at.filter("not hot").drop("hot").unionByName(few)
        met = cut(at.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, width, level, limit), _MET))
        found.append(met.filter("a is not null").select("a", "b"))
        more = met.filter("a is null").select("key", "id", "e", "px", "v", "nx", "n")
        if many is not None:
            left = f"get({tokens('0', 'e' if level == 1 else 'v', width, bits)}, shiftright(px, 1) % {bits + 1}).rest"
            more = more.unionByName(many.selectExpr("key", "id", "e", "px", f"{left} as v", "nx", "n"))
        if level == LEVELS:
            found.append(_split(more, bits))
            break
        width -= min(size for _, size in pieces(width, bits + 1))
        # a key has no more rows than the one it extends
        deeper = more.selectExpr("id", "e", "px", f"explode({tokens('key', 'v', width, bits)}) as t", "v", f"n > {HEAVY} as hot")
        at = deeper.selectExpr("t.key as key", "id", "e", f"(shiftright(px, 1) * {bits + 1} + t.p) * 2 + (px & 1) as px", "v", *(["hot"] if any_hot else []))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def near_counts(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, bits: int) -> np.ndarray:
    """Elements near the other side, of both sides together, for pairs whose elements lie one after another."""
    out = np.zeros(len(na), np.int64)
    sa, sb = np.append(0, np.cumsum(na))[:-1], np.append(0, np.cumsum(nb))[:-1]
    shapes = na.astype(np.int64) << 32 | nb
    order = np.argsort(shapes, kind="stable")
    ends = np.flatnonzero(np.diff(shapes[order], append=-1))
    start = 0
    for end in ends + 1:
        ka, kb = int(na[order[start]]), int(nb[order[start]])
        step = max(1, CELLS // max(1, ka * kb))
        for lo in range(start, end, step):
            at = order[lo : min(end, lo + step)]
            y = b[sb[at][:, None] + np.arange(kb)]
            hit = np.zeros((len(at), kb), bool)
            for i in range(0, ka, part := max(1, CELLS // max(1, kb * len(at)))):
                near = np.bitwise_count(a[sa[at][:, None] + np.arange(i, min(ka, i + part))][:, :, None] ^ y[:, None, :]) <= bits
                out[at] += near.any(2).sum(1)
                hit |= near.any(1)
            out[at] += hit.sum(1)
        start = end
    return out


def _verify(bits: int, cover: float):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ea, eb = batch.column("ea"), batch.column("eb")
            na, nb = np.diff(ea.offsets.to_numpy()), np.diff(eb.offsets.to_numpy())
            both = near_counts(ea.flatten().to_numpy().view("u8"), na, eb.flatten().to_numpy().view("u8"), nb, bits)
            yield batch.filter(both / (na + nb) >= cover).select(["a", "b"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, bits: int, cover: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose rows' elements (id, elems) have a share of at least ``cover``."""
    a = rows.select(F.col("id").alias("a"), F.col("elems").alias("ea"))
    b = rows.select(F.col("id").alias("b"), F.col("elems").alias("eb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ea", "eb").mapInArrow(_verify(bits, cover), "a BIGINT, b BIGINT")


def similar_sets(rows: DataFrame, group: list[str], key: str = "id", hashes: str = "hashes", bits: int = 4, cover: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links): rows of one group with a share of ``cover`` or more.

    members (id, rep): every row with at least one hash, and the smallest id of its class; rows of one class have the
    same hashes (in any order) in the same group. links (a, b), a < b: the pairs of similar classes, by rep, each once.
    Null and empty arrays, and rows with a null group or id, are in no class; null hashes are ignored. Rows that repeat
    are one. Other columns are ignored.
    """
    d = rows.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(*group).alias("g"), F.array_sort(F.filter(F.col(hashes), lambda h: h.isNotNull())).alias("elems"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(group)))
    d = d.filter((F.size("elems") > 0) & F.col("id").isNotNull())
    for k in range(len(group)):
        d = d.filter(F.col(f"_{k}").isNotNull())
    d = cut(d.dropDuplicates(["id"]).select("id", "g", "elems"))
    reps = cut(d.groupBy("g", "elems").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    same = reps.filter("n > 1").select("g", "elems", F.col("id").alias("rep"))
    # rows that are their own class need no join
    members = cut(d.join(same, ["g", "elems"], "left").select("id", F.coalesce("rep", "id").alias("rep")))
    rows_ = reps.select("id", "g", "elems")
    links = cut(verified(near_elements(*elements(rows_, bits, cover), bits), rows_, bits, cover))
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of similar rows, those within a class included. Its size is that of the result asked for.

    The rows of a class with many are put into blocks, and classes meet block by block.
    """
    blocks = f"cast(ceil(n / {BLOCK}) as int)"
    several = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").selectExpr("rep", f"{blocks} as k"))
    sized = members.join(several, "rep", "left").selectExpr("rep", "id", "coalesce(k, 0) as k", "cast(pmod(xxhash64(id), coalesce(k, 1)) as int) as i")
    # of a class only blocks i <= j meet; within a block each pair once
    own, other = sized.filter("k > 0").selectExpr("rep", "id as x", "i", "explode(sequence(i, k - 1)) as j"), sized.filter("k > 0").selectExpr("rep", "id as y", "explode(sequence(0, i)) as i", "i as j")
    within = own.join(other, ["rep", "i", "j"]).filter("i < j or x < y").select("x", "y")
    for side, name in (("a", "x"), ("b", "y")):
        links = links.join(several.withColumnRenamed("rep", side), side, "left").withColumn("i", F.expr("explode(sequence(0, coalesce(k, 1) - 1))")).drop("k")
        links = links.join(sized.selectExpr(f"rep as {side}", f"id as {name}", "i"), [side, "i"]).drop("i")
    across = links.select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
