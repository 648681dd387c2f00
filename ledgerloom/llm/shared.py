"""What the operators share: tables in the shared folder, connected components, bounded look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import drop_path, fresh_path, map_arrow, shared_dir
from ledgerloom.session import written as stored

__all__ = ["BROADCAST_KEYS", "ROW_KEY", "bounded_sample", "components", "drop_ids", "drop_path", "fresh_path", "keep_ids", "keyed", "map_arrow", "shared_dir", "stored"]

#: A side of at most this many 8-byte keys may be broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000

#: A column that tells rows apart whatever their ids: unique and never null.
ROW_KEY = "_row_key"


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW_KEY``, stored so that every read sees the same keys; a frame that has the column is kept."""
    return df if ROW_KEY in df.columns else stored(df.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; broadcasts ``ids`` only when its counted size is bounded."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``, null keys included; broadcasts as ``keep_ids`` does."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, key, "left_anti")


def bounded_sample(rows: DataFrame, by: str, each: int, chars: int) -> DataFrame:
    """At most ``each`` rows of (id, text, ``by``) for every value of ``by``, those with the lowest hash of their id.

    Ids are chosen first, without their texts. Where a chosen id has several rows, rows are chosen among theirs (equal
    ones are one), so an id of many rows does not bring them all. Texts are cut to ``chars`` characters.
    """
    order = Window.partitionBy(by).orderBy(F.xxhash64("id"), "id")
    ids = rows.groupBy(by, "id").agg(F.count("*").alias("_n")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each)
    ids = stored(ids.select("id", by, "_n"), "chosen")
    # by id first, which reaches the scan of the texts, then by both
    pairs = ids.where("id is not null")
    known = keep_ids(rows, pairs.select("id").distinct(), "id").join(F.broadcast(pairs.select("id", by)) if pairs.count() <= BROADCAST_KEYS else pairs.select("id", by), ["id", by], "left_semi").select(*rows.columns)
    if ids.where("id is null").limit(1).count():
        known = known.union(rows.where("id is null"))
    if ids.where("_n > 1").limit(1).count():
        known = known.withColumn("_row", F.xxhash64("id", "text", by))
        order = Window.partitionBy(by).orderBy(F.xxhash64("id"), "id", "_row")
        keys = known.select(by, "id", "_row").distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each)
        known = keep_ids(known, stored(keys.select("_row"), "rows"), "_row").withColumn("text", F.substring("text", 1, chars))
        known = known.groupBy("_row").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first(by).alias(by)).drop("_row")
    return known.withColumn("text", F.substring("text", 1, chars))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list, root the smallest node of its component.

    Alternates large-star and small-star steps until the edge set is a set of stars; each step is a
    pre-aggregated minimum per node joined back, so a hub is split by the skew join instead of sorted in
    one task. Every round is written to the shared folder; the folder of the round before is dropped.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = fresh_path(spark, "edges")
    now.write.parquet(path)
    now = spark.read.parquet(path)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = fresh_path(spark, "edges")
        small.write.parquet(after)
        now = spark.read.parquet(after)
        drop_path(spark, path)
        path = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
