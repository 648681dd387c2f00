"""Secure sums by pairwise masks: every two members of a round add and subtract the same pseudo-random vector.

The masks of a pair come from a seed both know; the member that sorts first adds it, the other subtracts it, so
the sum over all members is the sum of their updates. When members drop out, the masks that the others hold
against them are taken off the sum.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.robust import MAX_PAIRWISE, exploded
from ledgerloom.session import map_arrow

#: Half the masks' range, bytes of a seed.
SCALE = 1e6
SEED_BYTES = 32
_INNER, _OUTER = (bytes(x ^ pad for x in range(256)) for pad in (0x36, 0x5C))


def uniforms(seed: bytes, n: int) -> np.ndarray:
    """``n`` numbers in [0, 1): HMAC-SHA256 of a counter, eight little-endian bytes for each."""
    key = (seed if len(seed) <= 64 else hashlib.sha256(seed).digest()).ljust(64, b"\0")
    inner, outer = hashlib.sha256(key.translate(_INNER)), hashlib.sha256(key.translate(_OUTER))  # the key's blocks are hashed once
    blocks = []
    for k in range(-(-n // 4)):
        first, last = inner.copy(), outer.copy()
        first.update(struct.pack(">Q", k))
        last.update(first.digest())
        blocks.append(last.digest())
    return np.frombuffer(b"".join(blocks), "<u8")[:n].astype(np.float64) / 2.0**64


def mask(seed: bytes, n: int) -> np.ndarray:
    """The mask of a pair, centred on 0; a seed of another length is hashed first."""
    if n <= 0:
        raise ValueError("a mask needs a component")
    return (uniforms(seed if len(seed) == SEED_BYTES else hashlib.sha256(seed).digest(), n) * 2 - 1) * SCALE


def pair_seed(master: str, a: Column, b: Column) -> Column:
    """The hex seed of a pair, whichever way round it is named."""
    return F.sha2(F.concat_ws("|", F.lit(master), F.least(a, b).cast("string"), F.greatest(a, b).cast("string")), 256)


def pairs(members: DataFrame, by: list[str], master: str) -> DataFrame:
    """(by..., a, b, seed) of every ordered pair of a cohort; a cohort has at most ``MAX_PAIRWISE`` members (checked)."""
    n = members.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if n > MAX_PAIRWISE:
        raise ValueError(f"{n} members; masks take at most {MAX_PAIRWISE} in a cohort")
    left, right = (members.select(*by, F.col("member").alias(c)) for c in ("a", "b"))
    return left.join(right, by).where("a <> b").withColumn("seed", F.concat_ws(":", *(F.col(c).cast("string") for c in by), pair_seed(master, F.col("a"), F.col("b"))))


def masked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., member, v, peers array<struct<peer, seed>>) with the signed masks of the peers added to v."""
    names = [*by, "member", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for member, v, peers in zip(*(batch.column(c).to_pylist() for c in ("member", "v", "peers")), strict=True):
                total = np.array(v, float)
                for p in peers or ():
                    total += (1 if member < p["peer"] else -1) * mask(p["seed"].encode(), len(v))
                out.append(total.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.float64()))], names=names)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names[:-1])
    return map_arrow(rows.select(*names, "peers"), run, f"{kinds}, v array<double>")


def _peers(found: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct(F.col(other).alias("peer"), "seed")))  # at most MAX_PAIRWISE
    return found.groupBy(*by, F.col(own).alias("member")).agg(held.alias("peers"))


def masked_updates(updates: DataFrame, by: list[str], master: str, arrived: str = "true") -> DataFrame:
    """(by..., member, v): what every member of a cohort sends, masked against all its peers.

    Only members for which ``arrived`` holds are masked and returned; their peers are all members.
    """
    came = updates.where(arrived).select(*by, "member", "v")
    met = pairs(updates, by, master).join(came.select(*by, F.col("member").alias("a")), [*by, "a"], "left_semi")
    return masked(came.join(_peers(met, by, "a", "b"), [*by, "member"], "left"), by)


def secure_sum(sent: DataFrame, by: list[str]) -> DataFrame:
    """(by..., dim, value): the sum of what was sent."""
    return exploded(sent).groupBy(*by, "dim").agg(F.sum("value").alias("value"))


def repaired_sum(received: DataFrame, planned: DataFrame, by: list[str], master: str) -> DataFrame:
    """The sum of the received updates when other planned members have dropped out."""
    present = received.select(*by, "member")
    gone = planned.select(*by, "member").join(present, [*by, "member"], "left_anti")
    left = pairs(planned, by, master).join(present.withColumnRenamed("member", "a"), [*by, "a"], "left_semi").join(gone.withColumnRenamed("member", "b"), [*by, "b"], "left_semi")
    none = F.transform("v", lambda x: F.lit(0.0))
    held = masked(received.select(*by, "member", none.alias("v")).join(_peers(left, by, "a", "b"), [*by, "member"], "left"), by)
    return secure_sum(received.select(*by, "member", "v").union(held.select(*by, "member", F.transform("v", lambda x: -x))), by)


def secure_aggregate(updates: DataFrame, by: list[str], master: str) -> DataFrame:
    """(by..., dim, value): the mean of a cohort's updates, seen by the sum of masked ones only."""
    n = updates.groupBy(*by).agg(F.count("*").alias("_n"))
    return secure_sum(masked_updates(updates, by, master), by).join(n, by).select(*by, "dim", (F.col("value") / F.col("_n")).alias("value"))
