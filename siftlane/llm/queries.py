"""Queries of the problems on training data over the test tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane.llm.hashsets import similar_pairs, similar_sets
from siftlane.llm.history import records, repeats
from siftlane.llm.lookalikes import look_classes, same_look
from siftlane.llm.mixing import mix, shares
from siftlane.llm.packing import pack
from siftlane.llm.runs import runs
from siftlane.llm.tokens import token_count
from siftlane.llm.vectors import most_similar
from siftlane.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = most_similar(table(spark, d, "stored_vector_frame"), table(spark, d, "vector_ban"))
    return near.select(F.least("q", "n").alias("frame_id_a"), F.greatest("q", "n").alias("frame_id_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = ("blocked_image", "blocked_video_like", "vector_ban")
    found = repeats(records(*(table(spark, d, t) for t in names)))
    return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1).alias("src"), F.col("id").alias("row_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = runs(table(spark, d, "blocked_video_like_frame_hash"), "video_like_id", "frame_index", "position_millis", "hash")
    return r.select(F.col("entity").alias("video_like_id"), F.col("first_index").alias("first_frame_index"), F.col("last_index").alias("last_frame_index"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs(table(spark, d, "blocked_video_like_frame_hash"), "video_like_id", "frame_index", "position_millis", "hash")
    return r.select(F.col("entity").alias("video_like_id"), "first_index", "last_index", "n_events", F.col("duration_millis").cast("bigint").alias("duration_millis"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = similar_sets(table(spark, d, "stored_image_hash"), ["chat_id"])
    return similar_pairs(members, links).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    members, links = similar_sets(table(spark, d, "stored_image_hash"), ["chat_id"])
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_hash"), token_count(spark)("text").alias("n_tokens"))
    return cut(docs.dropDuplicates(["doc_id"]))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d).select("doc_id", "n_tokens"), table(spark, d, "token_container"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    bins = p7_containers(spark, d).filter("bin_id is not null").groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n"))
    used = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("tokens"))
    return used.join(table(spark, d, "token_container"), "container").select("container", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p8_mix(spark, d), table(spark, d, "mix_target"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(container, docs, lost, overfull, split_short): what must hold of the bins of a kind, counted; all but docs are 0."""
    sizes = _sizes(spark, d).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"))
    kinds = table(spark, d, "token_container")
    b = cut(pack(sizes.withColumnRenamed("n", "n_tokens"), kinds))
    docs = b.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("first_token").alias("starts"))
    seen = docs.join(sizes, "doc_id").join(kinds, "container").groupBy("container").agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("packed") != F.col("n")) | (F.col("starts") != F.col("pieces"))).alias("lost"), F.count_if((F.col("n") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("split_short"))
    bins = b.filter("bin_id is not null").groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("filled")).join(kinds, "container")
    return seen.join(bins.groupBy("container").agg(F.count_if(F.col("filled") > F.col("capacity_tokens")).alias("overfull")), "container").select("container", "docs", "lost", "overfull", "split_short")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(source, overused, misplaced, near_target): what must hold of each source of the mix.

    overused and misplaced count its documents used too often or of another source, and are 0; near_target tells whether
    its tokens miss the target share by no more than its largest document; shares are those of the sources that have any.
    """
    sizes, target = _sizes(spark, d), table(spark, d, "mix_target")
    m = cut(mix(sizes, target))
    of = sizes.select("doc_id", F.col("source").alias("own"))
    used = m.join(of, "doc_id").join(target, "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("overused"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("misplaced"))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    reached = shares(m, target).join(largest, "source", "left")
    whole = Window.partitionBy(F.lit(0))  # a row a source
    there = F.coalesce(F.col("largest") > 0, F.lit(False))
    goal = F.col("target_share") / F.sum(F.when(there, F.col("target_share"))).over(whole) * F.sum("tokens").over(whole)
    near = ~there | (F.abs(F.col("tokens") - goal) <= F.col("largest"))
    return reached.withColumn("near_target", near).join(used, "source", "left").select("source", F.coalesce("overused", F.lit(0)).alias("overused"), F.coalesce("misplaced", F.lit(0)).alias("misplaced"), "near_target")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"), "look")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p4_runs": p4_runs, "p5_found": p5_found, "p5_classes": p5_classes, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_invariants": p8_invariants, "p9_found": p9_found, "p9_classes": p9_classes}

_RUNS = """WITH f AS (SELECT video_like_id, frame_index, position_millis, hash, row_number() OVER (PARTITION BY video_like_id, frame_index ORDER BY hash NULLS LAST, position_millis NULLS LAST) AS nth
  FROM (SELECT DISTINCT * FROM blocked_video_like_frame_hash) WHERE video_like_id IS NOT NULL AND frame_index IS NOT NULL),
g AS (SELECT *, CASE WHEN bit_count(xor(hash, lag(hash) OVER w)) <= 4 THEN 0 ELSE 1 END AS fresh FROM f WHERE nth = 1 WINDOW w AS (PARTITION BY video_like_id ORDER BY frame_index)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY video_like_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT video_like_id, min(frame_index) AS a, max(frame_index) AS z, count(*) AS n, max(position_millis) - min(position_millis) AS dur FROM s GROUP BY video_like_id, run HAVING count(*) > 1)
"""

_SETS = """WITH r AS (SELECT DISTINCT id, chat_id, list_filter(hashes, lambda h: h IS NOT NULL) AS hs FROM stored_image_hash WHERE id IS NOT NULL AND chat_id IS NOT NULL),
e AS (SELECT id, chat_id, len(hs) AS n, unnest(hs) AS h, unnest(range(len(hs))) AS k FROM r),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(DISTINCT a.k) + count(DISTINCT b.k) AS near, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.chat_id = b.chat_id AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4 GROUP BY 1, 2)
"""
_CLASSES = """WITH r AS (SELECT DISTINCT id, chat_id, list_sort(list_filter(hashes, lambda h: h IS NOT NULL)) AS hs FROM stored_image_hash WHERE id IS NOT NULL AND chat_id IS NOT NULL),
c AS (SELECT *, min(id) OVER (PARTITION BY chat_id, hs) AS class_id FROM r WHERE len(hs) > 0),
e AS (SELECT id, chat_id, len(hs) AS n, unnest(hs) AS h, unnest(range(len(hs))) AS k FROM c WHERE id = class_id),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(DISTINCT a.k) + count(DISTINCT b.k) AS near, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.chat_id = b.chat_id AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4 GROUP BY 1, 2),
l AS (SELECT unnest([id_a, id_b]) AS class_id, count(*) AS n_links FROM m WHERE near / n >= 0.6 GROUP BY 1)
"""
_NEIGHBOURS = """WITH b AS (SELECT DISTINCT ON (id) id AS ban, chat_id, model_name, model_revision, vector_dim FROM vector_ban WHERE active),
f AS (SELECT DISTINCT ON (id) id, ban_id AS ban, vector FROM stored_vector_frame WHERE vector IS NOT NULL),
u AS (SELECT id, ban, chat_id, model_name, model_revision, list_transform(vector, lambda x: x::DOUBLE) AS v FROM f JOIN b USING (ban)
  WHERE len(vector) = vector_dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
w AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM u),
c AS (SELECT p.id AS q, o.id AS n, round(list_inner_product(p.v, o.v) / (p.l * o.l), 6) AS cos FROM w p JOIN w o ON p.chat_id = o.chat_id AND p.model_name = o.model_name AND p.model_revision = o.model_revision AND p.ban <> o.ban),
t AS (SELECT q, n FROM c WHERE cos >= 0.8 QUALIFY row_number() OVER (PARTITION BY q ORDER BY cos DESC, n) <= 5)
"""

SQL = {
    "p1_found": _NEIGHBOURS + "SELECT DISTINCT least(q, n) AS frame_id_a, greatest(q, n) AS frame_id_b FROM t",
    "p5_found": _SETS + "SELECT id_a, id_b FROM m WHERE near / n >= 0.6",
    "p5_classes": _CLASSES + "SELECT id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l USING (class_id)",
    # what must hold, whatever the bins and the choice
    "p7_invariants": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS split_short FROM token_container",
    "p8_invariants": "SELECT source, 0::BIGINT AS overused, 0::BIGINT AS misplaced, true AS near_target FROM mix_target",
    "p4_found": _RUNS + "SELECT video_like_id, a AS first_frame_index, z AS last_frame_index FROM r",
    "p4_runs": _RUNS + "SELECT video_like_id, a AS first_index, z AS last_index, n AS n_events, dur::BIGINT AS duration_millis FROM r",
}
