"""Federation rounds, rate limits and velocity as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND = "round bigint, members bigint, value array<double>"
_ROUND_STATE = "closed boolean, members array<string>, updates array<array<double>>"


def round_barrier(submissions: DataFrame, min_updates: int = 3) -> DataFrame:
    """(round, members, value): the mean update of a round, once ``min_updates`` distinct members have sent one.

    ``submissions`` streams (round, member, arrival, v). A member's later update replaces its earlier one until
    the round closes; updates for a closed round are dropped. State holds a round's updates, fewer than
    ``min_updates`` members by nature, and only a mark once it is closed.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        closed, members, updates = state.get if state.exists else (False, [], [])
        held = dict(zip(members, updates, strict=True))
        rows = pd.concat(list(frames)).sort_values(["arrival", "member"], kind="stable")
        for row in rows.itertuples() if not closed else ():
            held[str(row.member)] = [float(x) for x in row.v]
            if len(held) >= min_updates:
                mean = [sum(x) / len(held) for x in zip(*held.values(), strict=True)]
                yield pd.DataFrame({"round": [key[0]], "members": [len(held)], "value": [mean]})
                closed, held = True, {}
                break
        state.update((bool(closed), list(held), list(held.values())))

    return submissions.groupBy("round").applyInPandasWithState(advance, ROUND, _ROUND_STATE, "append", "NoTimeout")


def token_bucket(requests: DataFrame, capacity: float = 8.0, per_second: float = 1.0) -> DataFrame:
    """(client, at, allowed) for each request: a client has ``capacity`` tokens that refill steadily."""

    def spend(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        allowed = []
        for at in rows["at"].astype(float):
            tokens = min(capacity, tokens + (max(0.0, at - last) * per_second if last is not None else 0.0))
            last = at if last is None else max(last, at)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), last))
        yield pd.DataFrame({"client": key[0], "at": rows["at"].astype(float), "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(spend, "client string, at double, allowed boolean", "tokens double, last double", "append", "NoTimeout")


def velocity(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, n, total) for every window, late rows kept while the watermark allows."""
    rows = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", window).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that a stream holds now into Parquet files at ``path`` and read them."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
