"""Deduplicating new batches against all history (problem 2).

Method: a persistent table from chunks to records. A record's content is cut into chunks; a batch's chunks are joined
with the table, the bytes two records share are summed pair by pair, the covered share of both decides, and the chunks of
what is accepted are appended. The table is bucketed by chunk, so a batch costs a shuffle of its own chunks and one scan
of the narrow table, bucket by bucket; it is the only thing kept, and contents of earlier batches are never read again.

Chunk boundaries: content-defined boundaries from a rolling hash move with every flipped bit of a 32-byte signature and
miss cases (see README), so contents are cut where a pigeonhole argument holds instead:
- images: seven pieces of the hash at each position; at most 6 flipped bits leave one of them.
- videos: five pieces of each frame's hash; at most 4 flipped bits leave one of them.
- texts: three pieces by length; at most two edits leave one of them, moved by at most two characters.
So every pair of near hashes meets, and the shared totals are exact: 8 bytes for each hash of either side that is near one
of the other (images: one at the same position).

A chunk that many records have is extended by a further piece of the hash, up to LEVELS pieces. Which chunks these are is
told by a sketch of fixed size that counts all chunks ever seen; when one of its counts passes the limit, stored rows are
extended once and later rows at once. At the last level, rows of a chunk are split into blocks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane import files
from siftlane.llm.hashsets import pieces, tokens
from siftlane.session import cut, shared_folder, written

IMAGE, VIDEO, TEXT = 0, 1, 2
#: Bits in which near hashes may differ, the share of bytes that must be covered, edits of a text.
BITS, COVER, EDITS = {IMAGE: 6, VIDEO: 4}, {IMAGE: 0.75, VIDEO: 0.6}, 2
#: Characters at the start of a file id that name its kind and tell little; they never make a piece by themselves.
LEAD = 4
INDEX, PROBE = 1, 2
#: Pairs that one task goes through in order.
SETTLE = 200_000
#: Counts of the sketch, rows beyond which a count is hot, pieces in a chunk at most.
SKETCH, FREQUENT, LEVELS = 1 << 16, 20_000, 3
#: Parts of the table that are merged into one of the next size; batches after which the driver's memory is cleaned.
MERGE, CLEAN = 8, 2

_RECORD = "rid", "kind", "grp", "g", "seq", "elems", "txt"
_CHUNK = "key BIGINT, rid BIGINT, kind TINYINT, batch INT, role TINYINT, e BIGINT, slot BIGINT, w BIGINT, n BIGINT, level TINYINT, path INT, txt STRING"
_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]


def _hashes(text: Column, last_part: bool) -> Column:
    """The 64-bit hashes of a signature as bit patterns; blanks, leading zeros, empty and unreadable pieces mean nothing."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), r"\|")
    if last_part:
        parts = F.transform(parts, lambda p: F.element_at(F.split(p, ":"), -1))
    as_number = lambda p: F.regexp_replace(p, "^0+(?=.)", "").try_cast("decimal(38,0)")
    two63, two64 = F.expr("9223372036854775808BD"), F.expr("18446744073709551616BD")
    pattern = lambda v: F.when(v < 0, None).when(v < two63, v.cast("decimal(20,0)").cast("bigint")).when(v < two64, (v - two64).cast("decimal(20,0)").cast("bigint"))
    return F.filter(F.transform(parts, lambda p: pattern(as_number(p))), lambda h: h.isNotNull())


def records(images: DataFrame | None = None, videos: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Rows of the three tables in one form: rid = 3 * id + kind, the group they are compared in, order, content.

    Rows without a signature or file id are left out, as are signatures without a hash. Equal rows are one record; so is
    an id that repeats. A null batch comes after all others. Other columns are ignored.
    """
    out: list[DataFrame] = []

    def add(rows: DataFrame, kind: int, group: list[Column], elems: Column, txt: Column) -> None:
        seq = F.struct(F.coalesce(F.col("batch_no"), F.lit(2**31 - 1)).cast("int").alias("batch"), F.col("id").cast("bigint").alias("id"))
        d = rows.select((F.col("id") * 3 + kind).cast("bigint").alias("rid"), F.lit(kind).alias("kind"), F.concat_ws("|", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("?")) for c in group)).alias("grp"), seq.alias("seq"), elems.alias("elems"), txt.alias("txt"))
        out.append(d.dropDuplicates(["rid"]))

    none, nothing = F.lit(None).cast("string"), F.array().cast("array<bigint>")
    if images is not None:
        h = images.withColumn("_h", _hashes(F.col("hash_signature"), False)).filter(F.size("_h") > 0)
        add(h, IMAGE, [F.col("chat_id"), F.col("hash_version"), F.size("_h")], F.col("_h"), none)
    if videos is not None:
        h = videos.withColumn("_h", _hashes(F.col("hash_signature"), True)).filter(F.size("_h") > 0)
        add(h, VIDEO, [F.col("chat_id"), F.col("hash_version")], F.array_sort("_h"), none)
    if texts is not None:
        add(texts.filter(F.col("file_unique_id").isNotNull()), TEXT, [F.col("chat_id")], nothing, F.regexp_replace("file_unique_id", r"^\s+|\s+$", ""))
    d = out[0]
    for more in out[1:]:
        d = d.unionByName(more)
    return d.withColumn("g", F.xxhash64("grp")).select(*_RECORD)


def _text_chunks(rec: DataFrame) -> DataFrame:
    """``rec`` with key and role: the three pieces of txt to be found, and those of other lengths to look up."""
    looks = []
    for delta in range(-EDITS, EDITS + 1):  # length of this text less that of the other
        for k in range(3):
            for shift in range(-k, k + 1):
                # edits before the piece move it by ``shift``, those after it by the rest; k before and EDITS - k after
                if abs(shift - delta) <= EDITS - k:
                    looks.append(f"struct({delta} as delta, {k} as k, {shift} as shift, {PROBE if delta or shift else INDEX | PROBE} as role)")
    d = rec.selectExpr("*", f"inline(array({', '.join(looks)}))").selectExpr("*", "length(txt) - delta as other").filter("other >= 0")
    d = d.selectExpr("*", f"cast(if(other >= {LEAD + 3}, {LEAD} + floor((other - {LEAD}) / 3), floor(other / 3)) as int) as n0").selectExpr("*", "cast(floor((other - n0) / 2) as int) as n1")
    d = d.selectExpr("*", "case k when 0 then 0 when 1 then n0 else n0 + n1 end + shift as start", "case k when 0 then n0 when 1 then n1 else other - n0 - n1 end as m")
    return d.filter("start >= 0 and start + m <= length(txt)").selectExpr("*", "xxhash64(g, other, k, substr(txt, start + 1, m)) as key")


def chunks(rec: DataFrame) -> DataFrame:
    """The chunks of records, of one piece each: slot is what a hash counts as (its position, or itself), w how often."""
    base = "rid", "kind", "seq.batch as batch", "cast(size(elems) as bigint) as n"
    # a video's hashes are sorted, so equal ones stand together: the places where another begins give how often each occurs
    starts = f"if(kind = {VIDEO}, filter(sequence(0, size(elems) - 1), i -> i = 0 or elems[i] <> elems[i - 1]), array()) as starts"
    at = "transform(elems, (e, i) -> struct(e as e, cast(i as bigint) as slot, 1L as w, xxhash64(g, i) as seed))"
    own = "transform(starts, (s, i) -> struct(elems[s] as e, elems[s] as slot, cast(coalesce(get(starts, i + 1), size(elems)) - s as bigint) as w, g as seed))"
    d = rec.filter(f"kind <> {TEXT}").selectExpr(*base, "g", "elems", starts).selectExpr("rid", "kind", "batch", "n", f"inline(if(kind = {IMAGE}, {at}, {own}))")
    d = d.selectExpr("*", f"explode(if(kind = {IMAGE}, {tokens('seed', 'e', 64, BITS[IMAGE])}, {tokens('seed', 'e', 64, BITS[VIDEO])})) as c")
    out = d.selectExpr("c.key", "rid", "kind", "batch", f"{INDEX | PROBE} as role", "e", "slot", "w", "n", "1 as level", "c.p as path", "cast(null as string) as txt")
    txt = _text_chunks(rec.filter(f"kind = {TEXT}").selectExpr(*base, "g", "txt"))
    txt = txt.selectExpr("key", "rid", "kind", "batch", "role", "0L as e", "0L as slot", "0L as w", "0L as n", f"{LEVELS} as level", "0 as path", "txt")
    return _typed(out.unionByName(txt))


def _typed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*("cast({0} as {1}) as {0}".format(*c.split()) for c in _CHUNK.split(", ")))


def _bucket(key: str = "key") -> Column:
    return F.pmod(F.col(key), F.lit(SKETCH)).cast("int")


def _longer(rows: DataFrame) -> DataFrame:
    """``rows``, of fewer than LEVELS pieces, with each one more piece of the bits outside those they have."""
    out = None
    for kind, bits in BITS.items():
        value, width = "e", 64
        for level in range(1, LEVELS):
            left = f"get({tokens('0', value, width, bits)}, shiftright(path, {4 * (level - 1)}) & 15).rest"
            width -= min(size for _, size in pieces(width, bits + 1))
            d = rows.filter((F.col("kind") == kind) & (F.col("level") == level)).withColumn("_left", F.expr(left))
            d = d.withColumn("c", F.explode(F.expr(tokens("key", "_left", width, bits))))
            d = d.withColumns({"key": F.col("c.key"), "path": F.col("path").bitwiseOR(F.shiftleft("c.p", 4 * level)), "level": F.col("level") + 1})
            out = _typed(d) if out is None else out.unionByName(_typed(d))
            value = left
    return out


def _covered(near: DataFrame) -> DataFrame:
    """(new, old, at_new, at_old, shared, size) of pairs whose covered share decides for a match, in bytes of both sides."""
    d = near.groupBy("new", "old", "kind", "at_new", "at_old", "size").agg(F.expr("collect_set(struct(ns, nw))").alias("a"), F.expr("collect_set(struct(os, ow))").alias("b"))
    total = "aggregate({0}, 0L, (s, x) -> s + x.{1})"
    d = d.selectExpr("*", f"8 * ({total.format('a', 'nw')} + {total.format('b', 'ow')}) as shared")
    enough = f"kind = {TEXT} or shared / size >= if(kind = {IMAGE}, {COVER[IMAGE]}D, {COVER[VIDEO]}D)"
    return d.filter(enough).select("new", "old", "at_new", "at_old", "shared", "size")


# pairs of rows n, o are near by the rule of their kind; what is kept of them
_NEAR = f"if(n.kind = {TEXT}, levenshtein(n.txt, o.txt, {EDITS}) >= 0, bit_count(n.e ^ o.e) <= if(n.kind = {IMAGE}, {BITS[IMAGE]}, {BITS[VIDEO]}))"
_PAIR = "n.rid as new", "o.rid as old", "n.kind as kind", "n.batch as at_new", "o.batch as at_old", "8 * (n.n + o.n) as size", "n.slot as ns", "n.w as nw", "o.slot as os", "o.w as ow"


def _settled(batches: Iterator) -> Iterator:
    """The records taken out, from all pairs of one task, each record after all earlier ones."""
    import pyarrow as pa

    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    gone: set[int] = set()
    order = np.lexsort((table.column("id").to_numpy(), table.column("batch").to_numpy()))
    new, old = table.column("new").to_numpy(), table.column("old").to_numpy()
    for k in order:
        if old[k] not in gone:
            gone.add(int(new[k]))
    yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], ["rid"])


def _in_order(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(rid): records that an accepted earlier one matches, from all matching pairs (new, old, batch, id) of one batch.

    batch and id are the place of the new record; ``keep`` writes what is used several times. Records without an earlier
    match are accepted and take their later matches out, in rounds; once at most SETTLE pairs are left, which is counted,
    one task goes through them in order.
    """
    pairs = keep(pairs)
    out: DataFrame | None = None
    while pairs.count() > SETTLE:
        roots = pairs.select(F.col("old").alias("rid")).join(pairs.select(F.col("new").alias("rid")), "rid", "left_anti").distinct()
        gone = keep(pairs.join(roots.withColumnRenamed("rid", "old"), "old", "left_semi").select(F.col("new").alias("rid")).distinct())
        out = gone if out is None else out.unionByName(gone)
        pairs = keep(pairs.join(gone.withColumnRenamed("rid", "new"), "new", "left_anti").join(gone.withColumnRenamed("rid", "old"), "old", "left_anti"))
    rest = pairs.select("new", "old", "batch", "id").coalesce(1).mapInArrow(_settled, "rid BIGINT")
    return rest if out is None else out.unionByName(rest)


class History:
    """What has been accepted: a table of chunks in ``folder``, bucketed by chunk, appended batch by batch.

    Its parts in force stand in a manifest, so a part that a failed batch left behind is not read, and is replaced when
    the batch is given again. ``buckets`` is fixed with the first batch: as many tasks join a batch, each of which holds the
    batch's chunks of one bucket in memory, so it is chosen by the size of batches, not by that of the history.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, frequent: int = FREQUENT) -> None:
        self.spark, self.frequent, self.tag, self.taken = spark, frequent, uuid.uuid4().hex, 0
        self.folder = folder or f"{shared_folder(spark)}/history-{self.tag}"
        kept = json.loads(files.current(spark, f"{self.folder}/manifest") or "{}")
        self.parts: list[tuple[str, int]] = [(p, size) for p, size in kept.get("parts", [])]
        self.buckets = kept.get("buckets") or buckets or max(6, spark.sparkContext.defaultParallelism)
        # by number of pieces and bucket of the sketch: rows counted, and whether the rows there have been extended
        self.counts, self.hot = np.zeros((LEVELS + 1, SKETCH), np.int64), np.zeros((LEVELS + 1, SKETCH), bool)
        for level, bucket in kept.get("hot", []):
            self.hot[level, bucket] = True
        for name in ("chunks", "staged"):
            spark.sql(f"CREATE TABLE {self._name(name)} ({_CHUNK}, part STRING) USING parquet PARTITIONED BY (part) CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        if self.parts:  # the sketch of what is stored
            spark.catalog.recoverPartitions(self._name("chunks"))
            self._count(self._stored(None))

    def _name(self, table: str) -> str:
        return f"siftlane_{table}_{self.tag}"

    def _write(self, rows: DataFrame, table: str, part: str, more: bool = False) -> None:
        """Writes one part of a table; what an earlier attempt left of it is removed before, unless ``more`` is added."""
        if not more:
            files.delete(self.spark, f"{self.folder}/{table}/part={part}")
        rows.select(*_NAMES, F.lit(part).alias("part")).write.insertInto(self._name(table))
        self.spark.catalog.refreshTable(self._name(table))

    def _keep(self, rows: DataFrame) -> DataFrame:
        """``rows`` written for the time of one batch."""
        return written(rows, f"{self.folder}/work")

    def _read(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.table(self._name(table)).filter(F.col("part").isin(parts)).drop("part")

    def _stored(self, without: str | None) -> DataFrame:
        return self._read("chunks", [p for p, _ in self.parts if p != without])

    def _publish(self) -> None:
        files.publish(self.spark, f"{self.folder}/manifest", json.dumps({"buckets": self.buckets, "parts": self.parts, "hot": np.argwhere(self.hot).tolist()}))

    def _count(self, rows: DataFrame) -> None:
        for level, bucket, n in rows.groupBy("level", _bucket().alias("bucket")).count().collect():  # at most LEVELS * SKETCH rows
            self.counts[level, bucket] += n

    def _marked(self, rows: DataFrame, which: np.ndarray, hot: bool) -> DataFrame:
        """The rows whose chunk is at the places ``which`` of the sketch, with ``salts``, or those whose is not."""
        level, at = np.nonzero(which)
        salts = np.maximum(1, -(-self.counts[level, at] // self.frequent))
        table = F.broadcast(self.spark.createDataFrame(list(zip(level.tolist(), at.tolist(), salts.tolist(), strict=True)), "level TINYINT, bucket INT, salts INT"))  # at most LEVELS * SKETCH rows
        d = rows.withColumn("bucket", _bucket())
        return d.join(table, ["level", "bucket"]) if hot else d.join(table, ["level", "bucket"], "left_anti").drop("bucket")

    def _extend(self, part: str) -> None:
        """Counts the chunks of a staged batch and extends those that have become too frequent, stored or new.

        Level by level: rows of the batch at all places that are hot, stored rows at places that have become so, and rows
        that were stored for the level before at places that had been hot. A place once hot stays so.
        """
        fresh, added, hot = self._read("staged", [part]), None, self.hot.copy()
        self._count(fresh)
        open_ = lambda d: d.filter(F.col("kind") != TEXT)
        for level in range(1, LEVELS):
            before, turned, now = (np.zeros_like(hot) for _ in range(3))
            before[level] = hot[level]
            now[level] = hot[level] | (self.counts[level] > self.frequent)
            turned[level] = now[level] & ~before[level]
            if not now.any():
                break
            hot |= now
            longer = self._keep(_longer(self._marked(open_(fresh), now, True).select(*_NAMES)))
            self._write(longer.repartition(self.buckets, "key"), "staged", part, True)
            self._count(longer)
            old = [self._marked(open_(self._stored(part)), turned, True).select(*_NAMES)] if turned.any() and self.parts else []
            old += [self._marked(open_(added), before, True).select(*_NAMES)] if added is not None and before.any() else []
            added = None
            if old:
                added = self._keep(_longer(old[0] if len(old) == 1 else old[0].unionByName(old[1])))
                name = f"longer-{uuid.uuid4().hex}"
                self._write(added.repartition(self.buckets, "key"), "chunks", name)
                self.parts.append((name, 0))
                self._count(added)
            fresh = longer
        hot[LEVELS] |= self.counts[LEVELS] > self.frequent  # their rows meet in blocks, and are not extended
        self.hot = hot

    def _near(self, new: DataFrame, old: DataFrame, order: str = "true") -> DataFrame:
        """Pairs of rows n, o with one chunk and near contents; frequent chunks meet at the last level only, in blocks."""
        new, old = new.filter(f"role & {PROBE} > 0"), old.filter(f"role & {INDEX} > 0")
        near = F.expr(f"{order} and {_NEAR}")
        cold = self._marked(new, self.hot, False) if self.hot.any() else new
        # the batch is the side that is held in memory, the table streams by
        found = cold.alias("n").hint("shuffle_hash").join(old.alias("o"), F.expr("n.key = o.key")).filter(near).selectExpr(*_PAIR)
        if self.hot[LEVELS].any():
            top = np.zeros_like(self.hot)
            top[LEVELS] = self.hot[LEVELS]
            last = lambda d: self._marked(d, top, True)
            a = last(new).selectExpr("*", "explode(sequence(0, salts - 1)) as salt")
            b = last(old).selectExpr("*", "cast(pmod(xxhash64(rid, slot), salts) as int) as salt")
            found = found.unionByName(a.alias("n").join(b.alias("o"), F.expr("n.key = o.key and n.salt = o.salt")).filter(near).selectExpr(*_PAIR))
        return found

    def accept(self, batch: DataFrame, part: str) -> None:
        """Compares the records of ``batch`` with all accepted before, then with each other; what is new is appended.

        A part is put into force last; a batch that failed is given again under its name and replaces what it left
        behind. Copies with equal content count as one, so a content that a third of a batch has is compared once.
        """
        least = F.min(F.struct("seq", "rid", "kind")).alias("r")
        first = batch.groupBy("g", "elems", "txt").agg(least).select("g", "elems", "txt", "r.*")
        self._write(chunks(first).repartition(self.buckets, "key"), "staged", part)
        self._extend(part)
        left = staged = self._read("staged", [part])
        if any(p != part for p, _ in self.parts):
            seen = self._keep(_covered(self._near(staged, self._stored(part))).select(F.col("new").alias("rid")))
            left = staged.join(seen, "rid", "left_anti")
        pairs = _covered(self._near(left, left, "n.rid < o.rid"))
        # the one with the later place in (batch, id) repeats the other; of one kind, ids are in the order of rids
        later = "struct(at_new, new) > struct(at_old, old)"
        turned = pairs.selectExpr(f"if({later}, new, old) as new", f"if({later}, old, new) as old", "greatest(at_new, at_old) as batch", f"if({later}, new, old) as id")
        accepted = left.join(_in_order(turned, self._keep), "rid", "left_anti")
        # rows that are only looked up need not be kept
        self._write(accepted.filter(f"role & {INDEX} > 0"), "chunks", part)
        self.parts = [x for x in self.parts if x[0] != part] + [(part, 1)]
        self._merge()
        self._publish()
        files.delete(self.spark, f"{self.folder}/staged/part={part}")
        files.delete(self.spark, f"{self.folder}/work")
        self.taken += 1
        if self.taken % CLEAN == 0:  # shuffles, broadcasts and classes of finished batches are let go on driver and executors
            self.spark.sparkContext._jvm.System.gc()

    def _merge(self) -> None:
        """Parts of one size are merged when there are MERGE of them, so a table of k parts has about log k left."""
        size = self.parts[-1][1]
        same = [p for p in self.parts if p[1] == size]
        while len(same) >= MERGE:
            name = f"{same[-1][0]}-merged-{size}"
            self._write(self._read("chunks", [p for p, _ in same]).repartition(self.buckets, "key"), "chunks", name)
            self.parts = [p for p in self.parts if p not in same] + [(name, size + 1)]
            self._publish()
            for p, _ in same:
                files.delete(self.spark, f"{self.folder}/chunks/part={p}")
            self.spark.catalog.refreshTable(self._name("chunks"))
            size += 1
            same = [p for p in self.parts if p[1] == size]

    def accepted(self) -> DataFrame:
        """(rid) of all that has been accepted."""
        return self._stored(None).select("rid").distinct()

    def forget(self, keep: bool = True) -> None:
        """Takes the tables out of the session; with ``keep`` false also removes the folder."""
        for name in ("chunks", "staged"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
        if not keep:
            files.delete(self.spark, self.folder)


def repeats(rec: DataFrame, **options: int) -> DataFrame:
    """(kind, id): every record that matches an accepted earlier one of its group, in the order (batch, id).

    Batches are accepted one after the other, each against the table of all before it. ``options`` go to ``History``.
    """
    spark = rec.sparkSession
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    rec.withColumn("batch", F.col("seq.batch")).write.partitionBy("batch").parquet(folder)
    rec = spark.read.schema(rec.withColumn("batch", F.col("seq.batch")).schema).parquet(folder)
    numbers = sorted(r[0] for r in rec.select("batch").distinct().collect())  # one row a batch
    history = History(spark, **options)
    for k, number in enumerate(numbers):
        history.accept(rec.filter(F.col("batch") == number).drop("batch"), f"batch-{k:06d}")
    out = cut(rec.select("rid").join(history.accepted(), "rid", "left_anti")) if numbers else rec.select("rid")
    history.forget(keep=False)
    files.delete(spark, folder) if numbers else None
    return out.select(F.pmod("rid", F.lit(3)).cast("int").alias("kind"), F.floor((F.col("rid") - F.pmod("rid", F.lit(3))) / 3).alias("id"))
