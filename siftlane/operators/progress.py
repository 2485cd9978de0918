"""Progress of consumers over the event log: checkpoints, staleness, backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.ids import position


def get_or_create(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """A checkpoint for each (consumer_id, index_name) of ``wanted``: the stored one, or (0, 0) and fresh."""
    d = wanted.select("consumer_id", "index_name").distinct().join(checkpoints, ["consumer_id", "index_name"], "left")
    zero = F.lit(0)
    return d.select("consumer_id", "index_name", F.coalesce("last_tx", zero).cast("decimal(20,0)").alias("last_tx"), F.coalesce("last_offset", zero).cast("bigint").alias("last_offset"), F.coalesce("stale", F.lit(False)).alias("stale"), "stale_reason")


def advance(checkpoints: DataFrame, applied: DataFrame) -> DataFrame:
    """Checkpoints moved on to the largest position of ``applied`` (consumer_id, index_name, tx, off).

    A checkpoint never moves back; one that is moved, or stays where it was, is fresh again. Others stay as they are.
    """
    top = applied.groupBy("consumer_id", "index_name").agg(F.max(F.struct(F.col("tx").cast("decimal(20,0)").alias("tx"), F.col("off").cast("bigint").alias("off"))).alias("_to"))
    d = checkpoints.join(top, ["consumer_id", "index_name"], "left")
    at = F.struct(F.col("last_tx").cast("decimal(20,0)").alias("tx"), F.col("last_offset").alias("off"))
    moves = F.coalesce(F.col("_to") >= at, F.lit(False))
    return d.withColumns({"last_tx": F.when(moves, F.col("_to.tx")).otherwise(F.col("last_tx")), "last_offset": F.when(moves, F.col("_to.off")).otherwise(F.col("last_offset")), "stale": F.when(moves, F.lit(False)).otherwise(F.col("stale")), "stale_reason": F.when(~moves, F.col("stale_reason"))}).drop("_to")


def mark_stale(checkpoints: DataFrame, which: Column, reason: str) -> DataFrame:
    """The checkpoints under ``which`` marked as stale; their position stays."""
    if not reason.strip():
        raise ValueError("a reason is required")
    return checkpoints.withColumns({"stale": F.col("stale") | which, "stale_reason": F.when(which, F.lit(reason)).otherwise(F.col("stale_reason"))})


def freshness(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(index_name, stale) of the wanted indexes in order; one without a checkpoint counts as fresh."""
    return get_or_create(checkpoints, wanted).select("index_name", "stale").orderBy("index_name")


def of_indexes(checkpoints: DataFrame, consumer: str, names: list[str]) -> DataFrame:
    """The checkpoints of a consumer whose index is among ``names``; the condition reaches the scan."""
    return checkpoints.filter((F.col("consumer_id") == consumer) & F.col("index_name").isin(names))


def require_fresh(checkpoints: DataFrame, consumer: str, names: list[str]) -> None:
    """Raises an error that says how many of the indexes are stale, if any is."""
    if n := of_indexes(checkpoints, consumer, names).agg(F.count_if("stale")).first()[0]:
        raise RuntimeError(f"{n} stale indexes of {consumer}")


def is_ready(checkpoints: DataFrame, wanted: DataFrame) -> bool:
    return freshness(checkpoints, wanted).filter("stale").isEmpty()


def backlog(log: DataFrame, tx: int, offset: int, now: Column) -> DataFrame:
    """(pending, oldest_seconds): number of log rows after a position and the age of the oldest, null if there is none."""
    cursor = F.struct(F.lit(tx).cast("decimal(20,0)").alias("tx"), F.lit(offset).cast("bigint").alias("off"))
    after = log.filter(position() > cursor)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.min(F.col("created_at").cast("timestamp")))) / 1e6
    return after.agg(F.count(F.lit(1)).alias("pending"), age.alias("oldest_seconds"))


def histogram(rows: DataFrame, value: Column, labels: list[str], bounds: list[float]) -> DataFrame:
    """(labels, count, sum, le_*): cumulative buckets of ``value`` by ``labels``, null values left out of the buckets."""
    buckets = [F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*labels).agg(F.count(value).alias("n"), F.sum(value).alias("total"), *buckets)
