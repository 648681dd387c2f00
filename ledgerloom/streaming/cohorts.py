"""Secure-aggregation cohorts: opened, filled by their members, and closed by an event or by event time.

Events are (cohort, ts, seq, kind, member, planned, v). ``open`` names the planned members, ``submit`` sends a member's
(masked) vector, ``close`` ends the cohort; without one it ends ``timeout`` after its first event. The first open or
submission decides the plan, by (ts, seq): a cohort that is filled before it is opened is one of its first member alone.
Of several submissions of a planned member the last until the end counts; who is not planned is not heard; later events
change nothing, and a cohort that nobody opened or filled gives nothing. A closed cohort gives its survivors, the planned members that dropped out, and the sum of what the survivors sent, from which
``unmasked`` takes the masks that the absent members left.

The stream and the batch replay give the same rows. The stream holds a cohort until the watermark has passed its end,
so late rows within the watermark's delay count wherever they arrive. Its state is one vector a planned member, and
those of the last delay; afterwards a mark for another ``timeout``, so that stragglers open nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import masks
from ledgerloom.session import ship_package

EVENT = "cohort string, ts timestamp, seq bigint, kind string, member string, planned array<string>, v array<double>"
CLOSED = "cohort string, opened bigint, closed bigint, reason string, survivors array<string>, dropped array<string>, total array<double>"
_STATE = "opened bigint, planned array<string>, plan_at array<bigint>, ended bigint, done boolean, members array<string>, at array<bigint>, seq array<bigint>, v array<array<double>>"


class _Cohort:
    """What is known of one cohort; times are microseconds."""

    def __init__(self, held: tuple | None):
        self.opened, self.planned, self.plan_at, self.ended, self.done, *rows = held or (None, None, None, None, False, [], [], [], [])
        self.sent = [list(x) for x in zip(*rows, strict=True)]  # (member, at, seq, v)

    def add(self, frame: pd.DataFrame) -> None:
        for kind, at, seq, member, planned, v in zip(*(frame[c] for c in ("kind", "at", "seq", "member", "planned", "v")), strict=True):
            self.opened = at if self.opened is None else min(self.opened, at)
            if kind == "close":
                self.ended = at if self.ended is None else min(self.ended, at)
            elif kind == "open" and planned is not None:
                self.plan([str(m) for m in planned], at, seq)
            elif kind == "submit" and member is not None and v is not None:
                self.plan([str(member)], at, seq)
                self.sent.append([str(member), at, seq, [float(x) for x in v]])

    def plan(self, planned: list[str], at: int, seq: int) -> None:
        if self.plan_at is None or [at, seq] < list(self.plan_at):
            self.planned, self.plan_at = planned, [at, seq]

    def end(self, timeout: int) -> int:
        return min(self.opened + timeout, self.ended if self.ended is not None else self.opened + timeout)

    def settle(self, settled: int, timeout: int) -> None:
        """Keep of each member the last submission up to ``settled``, before which no event can come any more."""
        end, best, open_ = self.end(timeout), {}, []
        known = self.plan_at is not None and self.plan_at[0] <= settled
        for row in self.sent:
            if known and row[0] not in self.planned:
                continue
            if row[1] > min(end, settled):
                if row[1] <= end:
                    open_.append(row)
            elif row[0] not in best or best[row[0]][1:3] < row[1:3]:
                best[row[0]] = row
        self.sent = [*best.values(), *open_]

    def row(self, cohort: str, timeout: int) -> dict | None:
        end = self.end(timeout)
        self.settle(end, timeout)
        if self.plan_at is None or self.plan_at[0] > end:
            return None
        kept = {m: v for m, _, _, v in self.sent}
        total = [sum(x) for x in zip(*(kept[m] for m in sorted(kept)), strict=True)] if kept else None
        return {"cohort": cohort, "opened": self.opened, "closed": end, "reason": "closed" if end == self.ended else "timeout", "survivors": sorted(kept), "dropped": sorted(set(self.planned) - set(kept)), "total": total}

    def state(self) -> tuple:
        plan_at = None if self.plan_at is None else list(self.plan_at)
        return (self.opened, self.planned, plan_at, self.ended, bool(self.done), *(list(x) for x in (zip(*self.sent, strict=True) if self.sent else ([], [], [], []))))


def cohorts(events: DataFrame, timeout_seconds: float, delay: str) -> DataFrame:
    """``CLOSED`` rows of a stream of ``EVENT`` rows, each once the watermark (``delay`` behind) has passed its end."""
    timeout = int(timeout_seconds * 1e6)
    ship_package(events.sparkSession)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        one = _Cohort(state.get if state.exists else None)
        if state.hasTimedOut and one.done:
            state.remove()
            return
        settled = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            if not one.done:
                one.add(frame[frame["at"] > settled])  # the engine's own filter is a batch behind
        if one.opened is None:
            return
        if not one.done and (state.hasTimedOut or one.end(timeout) <= settled):
            row = one.row(key[0], timeout)
            one.done, one.sent = True, []
            if row is not None:
                yield pd.DataFrame([row])
        elif not one.done:
            one.settle(settled, timeout)
        state.update(one.state())
        due = one.end(timeout) + (timeout if one.done else 0)
        state.setTimeoutTimestamp(max(-(-due // 1000), settled // 1000 + 1))

    rows = events.withWatermark("ts", delay).where("cohort is not null and ts is not null").withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("cohort").applyInPandasWithState(advance, CLOSED, _STATE, "append", "EventTimeTimeout")


def replayed(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """``CLOSED`` rows of all cohorts of a table of ``EVENT`` rows."""
    rows = events.where("cohort is not null and ts is not null").withColumn("at", F.unix_micros("ts"))
    ends = rows.groupBy("cohort").agg(F.min("at").alias("opened"), F.min(F.when(F.col("kind") == "close", F.col("at"))).alias("ended"))
    limit = F.col("opened") + int(timeout_seconds * 1e6)
    ends = ends.select("cohort", "opened", F.least("ended", limit).alias("closed"), F.when(F.col("ended") <= limit, "closed").otherwise("timeout").alias("reason"))
    held = rows.join(ends, "cohort").where("at <= closed")
    turn = F.struct("at", "seq")
    sent = (F.col("kind") == "submit") & F.col("member").isNotNull() & F.col("v").isNotNull()
    opens = (F.col("kind") == "open") & F.col("planned").isNotNull()
    plans = held.where(sent | opens).groupBy("cohort").agg(F.min_by(F.when(opens, F.array_distinct("planned")).otherwise(F.array("member")), turn).alias("planned"))
    last = held.where(sent).groupBy("cohort", "member").agg(F.max_by("v", turn).alias("v")).join(plans, "cohort").where("array_contains(planned, member)")
    sums = last.select("cohort", F.posexplode("v").alias("dim", "x")).groupBy("cohort", "dim").agg(F.sum("x").alias("x"))
    total = sums.groupBy("cohort").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("total"))
    members = last.groupBy("cohort").agg(F.sort_array(F.collect_list("member")).alias("survivors"))  # planned members only
    found = ends.join(plans, "cohort").join(members, "cohort", "left").join(total, "cohort", "left")
    survivors = F.coalesce("survivors", F.array().cast("array<string>"))
    return found.select("cohort", "opened", "closed", "reason", survivors.alias("survivors"), F.sort_array(F.array_except("planned", survivors)).alias("dropped"), "total")


def unmasked(closed: DataFrame, master: str) -> DataFrame:
    """(cohort, survivors, total): ``CLOSED`` rows less the masks against members that dropped out."""
    rows = closed.where("total is not null and size(dropped) > 0")
    ends = rows.select("cohort", F.explode("survivors").alias("member"), F.transform(F.array_repeat(F.lit(0.0), F.size("total")), lambda x: x).alias("v"), "dropped")
    peers = F.transform("dropped", lambda d: F.struct(d.alias("peer"), F.concat_ws(":", "cohort", masks.pair_seed(master, F.col("member"), d)).alias("seed")))
    left = masks.secure_sum(masks.masked(ends.withColumn("peers", peers), ["cohort"]), ["cohort"])
    vector = left.groupBy("cohort").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda p: p["value"]).alias("left"))
    out = closed.join(vector, "cohort", "left")
    return out.select("cohort", "survivors", F.when(F.col("left").isNull(), F.col("total")).otherwise(F.zip_with("total", "left", lambda a, b: a - b)).alias("total"))
