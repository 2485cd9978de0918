from pyspark.sql import functions as F

from siftlane.operators.skew import heavy_keys, in_blocks, lookup


def rows(spark, n, hot, name):
    """A third of the rows have the key 0."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % hot).alias("key"), F.col("id").alias(name))


def test_blocks_give_the_join_without_them(spark):
    left, right = rows(spark, 300, 40, "a"), rows(spark, 200, 50, "b")
    want = sorted(map(tuple, left.join(right, "key").select("key", "a", "b").collect()))
    p, q = in_blocks(left, right, "key", 9)
    met = p.join(q, ["key", "_i", "_j"])
    assert sorted(map(tuple, met.select("key", "a", "b").collect())) == want
    # no cell of the hot key holds many more rows than a block of either side
    cells = met.filter("key = 0").groupBy("_i", "_j").agg(F.count_distinct("a").alias("l"), F.count_distinct("b").alias("r")).collect()
    assert len(cells) > 50 and max(max(c.l, c.r) for c in cells) <= 27


def test_blocks_of_few_rows_and_none(spark):
    left, right = rows(spark, 30, 40, "a"), rows(spark, 20, 50, "b")
    p, q = in_blocks(left, right, "key", 1000)
    assert p.filter("_i > 0 or _j > 0").count() == 0 and p.join(q, ["key", "_i", "_j"]).count() == left.join(right, "key").count()
    p, q = in_blocks(left.limit(0), right, "key", 2)
    assert p.join(q, ["key", "_i", "_j"]).count() == 0


def test_lookup_of_heavy_keys(spark):
    d, target = rows(spark, 30_000, 97, "a"), spark.range(60).select(F.col("id").alias("key"), F.lit("t").alias("t"))
    heavy = heavy_keys(d.groupBy("key").count().withColumnRenamed("count", "n"), "key")
    assert [r.key for r in heavy.collect()] == [0]
    for how in ("left", "inner"):
        assert sorted(map(str, lookup(d, target, "key", heavy, how).select("key", "a", "t").collect())) == sorted(map(str, d.join(target, "key", how).select("key", "a", "t").collect()))
