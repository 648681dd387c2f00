"""A federation replayed from its log: rounds closed, detected, aggregated and versioned; provenance, weights, counters.

The log is one table, a row for each event, ordered by a unique ``seq``:

- ``submit``: ``member`` sends ``v`` (and its measured ``recall`` and ``silo_recall``) for ``round``; of several the last
  before the round closes counts, later ones and vectors that are not finite or not of ``dim`` components do not.
- ``close``: ``round`` is aggregated, if it has ``least`` members or more; only the first close of a round counts.
- ``promote`` and ``rollback``: ``version`` becomes the promoted one, or its parent does. Events that name a version
  which does not exist yet change nothing.

Version 0 is the genesis; every aggregated round makes the next version, a change added to the version that was
promoted at that time. Who was promoted depends on parents, and parents on who was promoted: changes of the registry
form a forest, since a rollback points to the change before its version was made, and so do versions and their parents.
Both are walked by pointer doubling, so a chain of n takes log2 n joins, and no task holds the log.

Defined results: rows without ``seq``, submissions without round or member, and other kinds are nothing; an empty log
leaves the genesis alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import is_valid_vector
from ledgerloom.operators import robust
from ledgerloom.session import written


def running(rows: DataFrame, order: str, parts: int | None = None, **totals: tuple[Column, str]) -> DataFrame:
    """``rows`` with running values before each row by ``order``: name=(expression, "sum" or "last").

    A sum adds up, a last one keeps what is not null. Rows are ranges of ``order``; a task runs over its range and takes
    what the ranges before it come to from a table with a row for each range. Nothing comes before the first row: null.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(totals)
    held = rows.withColumns({f"_{n}": e for n, (e, _) in totals.items()}).repartitionByRange(parts, order)
    held = written(held.withColumn("_part", F.spark_partition_id()), "ranges")
    whole = {n: F.sum(f"_{n}") if kind == "sum" else F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))) for n, (_, kind) in totals.items()}
    ranges = held.groupBy("_part").agg(*(c.alias(f"_{n}") for n, c in whole.items()))
    pick = lambda n: F.sum(f"_{n}") if totals[n][1] == "sum" else F.last(f"_{n}", ignorenulls=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("_part", *(pick(n).over(before).alias(f"_before_{n}") for n in names))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(F.broadcast(ranges), "_part").withColumns({n: pick(n).over(inside) for n in names})

    def joined(n: str) -> Column:
        if totals[n][1] == "last":
            return F.coalesce(n, f"_before_{n}")
        return F.when(F.col(n).isNull(), F.col(f"_before_{n}")).otherwise(F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)))

    return out.withColumns({n: joined(n) for n in names}).drop("_part", *(f"_{n}" for n in names), *(f"_before_{n}" for n in names))


def accepted(log: DataFrame, dim: int) -> DataFrame:
    """(round, member, v, recall, silo_recall): what counts of each member when its round closes."""
    closes = log.where("kind = 'close' and seq is not null and round is not null").groupBy("round").agg(F.min("seq").alias("closed"))
    sent = log.where((F.col("kind") == "submit") & F.col("seq").isNotNull() & F.col("member").isNotNull() & is_valid_vector(F.col("v"), dim)).join(closes, "round").where("seq < closed")
    best = sent.groupBy("round", "member").agg(F.max_by(F.struct("v", "recall", "silo_recall"), "seq").alias("_last"), F.max("closed").alias("closed"))
    return best.select("round", "member", "closed", "_last.*")


def versions(log: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """(version, round, closed) of every aggregated round; versions count from 1 in the order of closing."""
    full = held.groupBy("round").agg(F.first("closed").alias("closed"), F.count("*").alias("members")).where(F.col("members") >= least)
    placed = running(full, "closed", place=(F.lit(1), "sum"))
    return placed.select((F.coalesce("place", F.lit(0)) + 1).cast("bigint").alias("version"), "round", "closed")


def doubled(rows: DataFrame, key: str, pointer: str, value: str, add) -> DataFrame:
    """(key, value) of a forest: ``value`` combined along the path from each node to its root by pointer doubling.

    ``add(own, above)`` combines a value with that of the node its pointer reaches. Every step is written; a chain of n
    nodes takes log2 n of them. Pointers must lead to a root (a null pointer or one to no node).
    """
    now = written(rows.select(key, pointer, value), "forest")
    while now.where(F.col(pointer).isNotNull()).limit(1).count():
        above = now.select(F.col(key).alias("_key"), F.col(pointer).alias("_pointer"), F.col(value).alias("_value"))
        met = now.join(above, F.col(pointer) == F.col("_key"), "left")
        combined = F.when(F.col("_key").isNull(), F.col(value)).otherwise(add(F.col(value), F.col("_value")))
        now = written(met.select(key, F.col("_pointer").alias(pointer), combined.alias(value)), "forest")
    return now.select(key, value)


def lineage(log: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((version, parent), (seq, active)): parents of versions, and what is promoted after each change of the registry."""
    asked = log.where("kind in ('promote', 'rollback') and seq is not null").select("seq", "kind", "version")
    known = made.select("version", F.col("closed").alias("born")).union(log.sparkSession.range(1).select(F.lit(0).cast("bigint"), F.lit(-(2**62)).cast("bigint")))
    changes = written(asked.join(known, "version").where("born < seq"), "changes")
    # the change before each version was made
    axis = changes.select("seq", F.col("seq").alias("mark"), F.lit(None).cast("bigint").alias("made")).union(made.select("closed", F.lit(None).cast("bigint"), "version"))
    seen = running(axis, "seq", change=(F.col("mark"), "last")).where("made is not null").select(F.col("made").alias("version"), "change")
    seen = written(seen, "seen")
    # a promotion is its version; a rollback is what was promoted before its version was made, by the genesis 0
    back = changes.join(seen.withColumnRenamed("change", "points"), "version", "left")
    forest = back.select("seq", F.when(F.col("kind") == "rollback", F.col("points")).alias("points"), F.when(F.col("kind") == "promote", F.col("version")).alias("active"))
    active = doubled(forest, "seq", "points", "active", lambda own, above: F.coalesce(own, above)).select("seq", F.coalesce("active", F.lit(0)).cast("bigint").alias("active"))
    active = written(active, "active")
    parents = seen.join(active.select(F.col("seq").alias("change"), "active"), "change", "left")
    return parents.select("version", F.coalesce("active", F.lit(0)).cast("bigint").alias("parent")), active


class Replay:
    """What a log comes to; each table is written once and read by the views."""

    def __init__(self, log: DataFrame, dim: int, least: int = 3, byzantine: int = 1, factor: float = 10.0, trim: float = 0.2):
        self.dim = dim
        self.held = written(accepted(log, dim), "accepted")
        self.made = written(versions(log, self.held, least), "versions")
        parents, self.active = lineage(log, self.made)
        self.made = written(self.made.join(parents, "version"), "lineage")
        rounds = self.held.join(self.made.select("round", "version"), "round")
        gate = robust.outlier_gate(rounds.select("round", "member", "v"), byzantine, factor, ["round"]).select("round", "member", "rejected")
        self.members = written(rounds.join(gate, ["round", "member"]), "members")
        kept = self.members.where("not rejected").select("round", "member", "v")
        change = robust.trimmed_mean(kept, None, ["round"], trim)
        pairs = F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda p: p["value"])  # dim components
        self.changes = written(change.groupBy("round").agg(pairs.alias("change")), "round_changes")

    def provenance(self) -> DataFrame:
        """(round, version, parent, contributors, rejected, recall, silo_recall): who made what of every round.

        A contributor without a recall counts as 0; the siloed mean is of those that sent one, null where none did.
        """
        good = ~F.col("rejected")
        found = self.members.groupBy("round").agg(
            F.sort_array(F.collect_list(F.when(good, F.col("member")))).alias("contributors"),
            F.sort_array(F.collect_list(F.when(F.col("rejected"), F.col("member")))).alias("refused"),
            F.round(F.coalesce(F.avg(F.when(good, F.coalesce("recall", F.lit(0.0)))), F.lit(0.0)), 4).alias("recall"),
            F.round(F.avg(F.when(good, F.col("silo_recall"))), 4).alias("silo_recall"),
        )
        return self.made.join(found, "round").select("round", "version", "parent", "contributors", F.col("refused").alias("rejected"), "recall", "silo_recall")

    def weights(self, start: list[float] | None = None) -> DataFrame:
        """(version, v): the genesis (``start`` or zeros) and all changes on the way from it to each version, added up."""
        base = F.array(*(F.lit(float(x)) for x in (start or [0.0] * self.dim)))
        steps = self.made.join(self.changes, "round").select("version", F.when(F.col("parent") > 0, F.col("parent")).alias("parent"), "change")
        sums = doubled(steps, "version", "parent", "change", lambda own, above: F.zip_with(own, above, lambda a, b: a + b))
        genesis = sums.sparkSession.range(1).select(F.col("id").alias("version"), base.alias("v"))
        return genesis.union(sums.select("version", F.zip_with("change", base, lambda a, b: a + b)))

    def depths(self) -> DataFrame:
        """(version, depth): how many rounds lead from the genesis to each version."""
        steps = self.made.select("version", F.when(F.col("parent") > 0, F.col("parent")).alias("parent"), F.lit(1).cast("bigint").alias("depth"))
        return doubled(steps, "version", "parent", "depth", lambda own, above: own + above)

    def statuses(self, log: DataFrame) -> DataFrame:
        """(version, parent, status): promoted, rolledback (where that was the last to happen to it) or canary."""
        rolled = log.where("kind = 'rollback'").join(self.active.select("seq"), "seq", "left_semi").select("seq", "version", F.lit("rolledback").alias("status"))
        happened = rolled.union(self.active.select("seq", "active", F.lit("canary")))
        last = happened.groupBy("version").agg(F.max_by("status", "seq").alias("status"))
        now = self.active.agg(F.coalesce(F.max_by("active", "seq"), F.lit(0)).alias("now"))  # one row
        genesis = log.sparkSession.range(1).select(F.col("id").alias("version"), F.lit(None).cast("bigint").alias("parent"))
        rows = genesis.union(self.made.select("version", "parent")).join(last, "version", "left").crossJoin(F.broadcast(now))
        return rows.select("version", "parent", F.when(F.col("version") == F.col("now"), "promoted").otherwise(F.coalesce("status", F.lit("canary"))).alias("status"))

    def counters(self, at_risk: float, average_loss: float, hours: float, threshold: float) -> DataFrame:
        """(round, version, victims, siloed_victims, lost, prevented, hours_to_detect): running totals after every round.

        A round adds ``at_risk`` times what its members' mean recall misses, beside what their siloed mean misses. A mean
        that equals the threshold reaches it, whatever the order in which recalls were added up.
        """
        means = self.members.groupBy("round").agg(F.avg(F.coalesce("recall", F.lit(0.0))).alias("fed"), F.avg(F.coalesce("silo_recall", F.lit(0.0))).alias("silo"))
        rows = self.made.select("round", "version").join(means, "round")
        missed = {n: F.lit(float(at_risk)) * (1 - F.col(n)) for n in ("fed", "silo")}
        rows = running(rows, "version", fed_before=(missed["fed"], "sum"), silo_before=(missed["silo"], "sum"))
        total = {n: F.floor(F.round(F.coalesce(f"{n}_before", F.lit(0.0)) + missed[n], 6)).cast("bigint") for n in missed}
        return rows.select(
            "round", "version", total["fed"].alias("victims"), total["silo"].alias("siloed_victims"), (total["fed"] * average_loss).alias("lost"),
            (F.greatest(F.lit(0), total["silo"] - total["fed"]) * average_loss).alias("prevented"),
            F.when(F.round("fed", 12) >= threshold, F.lit(float(hours)) * F.col("version")).otherwise(F.lit(101.0)).alias("hours_to_detect"),
        )

    def member_views(self) -> DataFrame:
        """(member, rounds, last_round, recall, silo_recall, poisoned): latest metrics, and who the last round refused."""
        last = self.made.agg(F.max_by("round", "version").alias("last"))  # one row
        latest = self.members.join(self.made.select("round", "closed"), ["round", "closed"]).groupBy("member").agg(
            F.count("*").alias("rounds"), F.max_by(F.struct("round", "recall", "silo_recall", "rejected"), "closed").alias("_now")
        )
        rows = latest.crossJoin(F.broadcast(last))
        poisoned = (F.col("_now.round") == F.col("last")) & F.col("_now.rejected")
        return rows.select("member", "rounds", F.col("_now.round").alias("last_round"), F.col("_now.recall").alias("recall"), F.col("_now.silo_recall").alias("silo_recall"), poisoned.alias("poisoned"))
