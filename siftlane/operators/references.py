"""References to records that do not exist, are deleted, or arrive only later.

Method: a skew-aware split. References are pre-aggregated by key and period (map-side combine), with the earliest and
latest time of use. Keys that hold more than 1/1000 of all references are fewer than 1000 and are checked by broadcast;
the others go through a shuffled join. The two are united and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.ids import uuid_key
from siftlane.operators.skew import heavy_keys, lookup
from siftlane.session import cut
from siftlane.sources.outbox import ban_created


def references(rows: DataFrame, src: str, ref: Column, kind: str, row_key: Column) -> DataFrame:
    """(src, kind, row_key, ref, at) of rows with a reference; a null or empty reference is none.

    Equal rows are one record: a row_key with the same reference and time counts once in ``orphan_rows``.
    """
    key = F.when(ref.cast("string") != "", F.concat(F.lit(f"{kind}:"), ref.cast("string")))
    d = rows.select(F.lit(src).alias("src"), row_key.cast("string").alias("row_key"), key.alias("ref"), F.col("created_at").cast("timestamp_ntz").alias("at"))
    return d.filter(F.col("ref").isNotNull())


def targets(rows: DataFrame, kind: str, key: Column) -> DataFrame:
    """One row (ref, spans) a target key; spans are the times in which it exists, from created_at up to deactivated_at.

    A key stands in one record; should it stand in several different ones, it exists whenever one of them does.
    """
    d = rows.select(
        F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("ref"),
        F.struct(F.col("created_at").cast("timestamp_ntz").alias("since"), F.col("deactivated_at").cast("timestamp_ntz").alias("until")).alias("span"),
    )
    return d.filter(F.col("ref").isNotNull()).groupBy("ref").agg(F.collect_set("span").alias("spans"))


def _alive(at: Column) -> Column:
    """Whether a span covers ``at``. A target without created_at always existed; a row without a time matches any target."""
    return F.exists("spans", lambda s: F.coalesce(s["since"] <= at, F.lit(True)) & F.coalesce(s["until"] > at, F.lit(True)))


def _groups(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs with grp, groups): grp is (src, period_ym, ref); a group has n, first_at, last_at."""
    period = F.when(F.col("at").isNotNull(), F.year("at") * 100 + F.month("at")).cast("int")
    refs = cut(refs.withColumn("grp", F.struct("src", period.alias("period_ym"), "ref")))
    return refs, cut(refs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).withColumn("ref", F.col("grp.ref")))


def _verdicts(groups: DataFrame, target: DataFrame) -> DataFrame:
    """Groups with n_orphans: 0 or n where the whole group is alike, null where its target arrives or goes in between."""
    heavy = cut(heavy_keys(groups.groupBy("ref").agg(F.sum("n").alias("n")), "ref"))
    seen = lookup(groups, target, "ref", heavy)
    since = lambda s, t: F.coalesce(s["since"] <= F.col(t), F.lit(True))
    until = lambda s, t: F.coalesce(s["until"] > F.col(t), F.lit(True))
    throughout = F.exists("spans", lambda s: since(s, "first_at") & until(s, "last_at"))
    never = F.col("spans").isNull() | ~F.exists("spans", lambda s: since(s, "last_at") & until(s, "first_at"))
    return cut(seen.withColumn("n_orphans", F.when(never, F.col("n")).when(throughout, F.lit(0)).cast("bigint")))


def _rows(refs: DataFrame, groups: DataFrame, bad: DataFrame) -> DataFrame:
    """The orphans among the rows of the groups ``bad``."""
    heavy = cut(heavy_keys(groups, "grp"))
    seen = lookup(refs, bad.select("grp", "spans", "n_orphans"), "grp", heavy, "inner")
    return seen.filter(F.col("n_orphans").isNotNull() | ~_alive(F.col("at"))).select("src", "grp.period_ym", "row_key")


def orphan_rows(refs: DataFrame, target: DataFrame) -> DataFrame:
    """(src, period_ym, row_key) of every reference whose target is missing, deleted or arrives later; each row once.

    Rows that repeat need not be removed before: they weigh in the groups, and orphans are made distinct at the end.

    A reference is an orphan if no target has its key, or none with it was created at or before the row's time and is
    not yet deactivated then. Rows without a time have a null period and are orphans only if the target is missing.
    """
    refs, groups = _groups(refs)
    verdicts = _verdicts(groups, target)
    return _rows(refs, groups, verdicts.filter(F.col("n_orphans").isNull() | (F.col("n_orphans") > 0))).distinct()


def orphan_report(refs: DataFrame, target: DataFrame) -> DataFrame:
    """(src, period_ym, n_references, n_orphans): counts by table and month, of rows as they come.

    Groups that are alike count as wholes; only those whose target arrives or goes within the month are read by row.
    """
    refs, groups = _groups(refs)
    verdicts = _verdicts(groups, target)
    whole = verdicts.select("grp.src", "grp.period_ym", F.col("n").alias("n_references"), F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
    late = _rows(refs, groups, verdicts.filter(F.col("n_orphans").isNull())).select("src", "period_ym", F.lit(0).alias("n_references"), F.lit(1).alias("n_orphans"))
    return whole.unionByName(late).groupBy("src", "period_ym").agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans"))


def ban_references(images: DataFrame, frames: DataFrame, log: DataFrame) -> DataFrame:
    """The references of the project: ban_uid of images and created-ban payloads, ban_id of vector frames."""
    return (
        references(images, "blocked_image", uuid_key("ban_uid"), "media_ban", F.col("id"))
        .unionByName(references(frames, "stored_vector_frame", F.col("ban_id"), "vector_ban", F.col("id")))
        .unionByName(references(ban_created(log), "ban_created_payload", uuid_key("ban.ban_uid"), "media_ban", F.col("delivery_id")))
    )


def ban_targets(media_ban: DataFrame, vector_ban: DataFrame) -> DataFrame:
    """What those references point to."""
    return targets(media_ban, "media_ban", uuid_key("ban_uid")).unionByName(targets(vector_ban, "vector_ban", F.col("id")))
