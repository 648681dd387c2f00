"""Folding an event stream: the latest state of every key, and edges that are announced once.

Events are (key, ts, seq, epoch, kind, value). ``state`` replaces the key's state, ``attack`` names who attacks and
``clear`` ends that, ``connection`` sets the connection. Of each the last by (ts, seq) holds, in whatever order events
arrive, so a fold is a grouped maximum: it is combined before it is shuffled, its state is one row a key, and the same
frame is a batch and a stream. Edges are the first attack and the first spread of a regime (``spread``, its ``value``)
in an epoch of a key; a later epoch announces them anew. Null keys are no key; unknown kinds change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sinks.upsert import UpsertTable

FOLDED = "key bigint, state string, attacker string, connection string, events bigint, last bigint"


def folded(events: DataFrame) -> DataFrame:
    """``FOLDED`` rows: every key with its latest state, attacker (null when cleared) and connection."""

    def last(*kinds: str) -> Column:
        own = F.col("kind").isin(*kinds)
        return F.max_by(F.when(F.col("kind") == "clear", None).otherwise(F.col("value")), F.when(own, F.struct("ts", "seq")))

    rows = events.where("key is not null")
    return rows.groupBy("key").agg(last("state").alias("state"), last("attack", "clear").alias("attacker"), last("connection").alias("connection"), F.count("*").alias("events"), F.max("seq").alias("last"))


def edges(events: DataFrame) -> DataFrame:
    """(key, epoch, edge): ``attack_detected`` and ``fraud_propagated:<regime>``, once for every epoch of a key."""
    edge = F.when(F.col("kind") == "attack", "attack_detected").when(F.col("kind") == "spread", F.concat(F.lit("fraud_propagated:"), F.coalesce("value", F.lit(""))))
    return events.where("key is not null").select("key", "epoch", edge.alias("edge")).where("edge is not null").dropDuplicates(["key", "epoch", "edge"])


def folded_to(stream: DataFrame, table: UpsertTable, checkpoint: str) -> DataFrame:
    """Fold all that a stream holds now into ``table`` (of ``FOLDED`` rows by key) and read it.

    Each micro-batch upserts the keys that it changed, under its own id; a replayed one changes nothing.
    """
    folded(stream).writeStream.outputMode("update").foreachBatch(table.sink()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()
