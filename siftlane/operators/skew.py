"""Joins that a hot key cannot stall: lookups by broadcast, and many-to-many joins split into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.session import cut

#: At most so many keys are heavy, whatever the input: a key is heavy if it holds more than 1/HEAVY of all rows.
HEAVY = 1000
#: A key with no more rows than this is never heavy.
LEAST = 5000


def heavy_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The keys of pre-aggregated ``counts`` (key, n) that hold more than 1/HEAVY of all rows: fewer than HEAVY rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) > max(LEAST, total // HEAVY)).select(key)


def lookup(rows: DataFrame, target: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with ``target`` (one row a key) on ``key``.

    ``heavy`` has fewer than HEAVY keys (see heavy_keys), so it and the targets it selects can be broadcast: rows of a
    hot key are never shuffled. Rows with a null key are kept by ``left``, with nulls.
    """
    h = F.broadcast(heavy)
    hot = rows.join(h, key, "left_semi").join(F.broadcast(target.join(h, key, "left_semi")), key, how)
    cold = rows.join(h, key, "left_anti").join(target.join(h, key, "left_anti"), key, how)
    return hot.unionByName(cold)


def in_blocks(left: DataFrame, right: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns _i and _j: joined on ``key``, _i and _j they give the same rows as on ``key`` alone.

    The rows of a key that either side has more than ``rows`` times are put into blocks by a hash of the row, and each
    block meets each block of the other side in a place of its own, so a task gets about ``rows`` of a key from a side.
    Rows are counted before they are shuffled.
    """
    n = F.count(F.lit(1))
    counts = left.groupBy(key).agg(n.alias("_l")).join(right.groupBy(key).agg(n.alias("_r")), key)
    big = cut(counts.filter(f"_l > {rows} or _r > {rows}").selectExpr(key, f"cast(ceil(_l / {rows}) as int) as _a", f"cast(ceil(_r / {rows}) as int) as _b"))
    if big.isEmpty():
        return tuple(d.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for d in (left, right))

    def side(d: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        place = f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in d.columns)}), coalesce({mine}, 1)) as int) as {own}"
        return d.join(big, key, "left").selectExpr(*(f"`{c}`" for c in d.columns), place, f"explode(sequence(0, coalesce({theirs}, 1) - 1)) as {other}")

    return side(left, "_i", "_a", "_j", "_b"), side(right, "_j", "_b", "_i", "_a")
