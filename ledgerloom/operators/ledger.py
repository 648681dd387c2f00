"""Append-only logs: canonical records, Merkle trees, proofs of inclusion and consistency, latest-state views.

A leaf hashes a zero byte and the record's canonical JSON, an inner node a one byte and the bytes of its two
children; an odd last node is paired with itself. Hashes are lower-case hex.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks, nulls kept; fields are integers, booleans, texts or structs of them."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def leaves(rows: DataFrame, seq: str, payload: Column) -> DataFrame:
    """(seq, h): the hash of each record."""
    return rows.select(F.col(seq).cast("bigint").alias("seq"), F.sha2(F.concat(F.unhex(F.lit("00")), payload.cast("binary")), 256).alias("h"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``seq``, their place by ``order`` from 0 without gaps: ranks inside ranges, after the ranges' counts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return held.join(F.broadcast(before), "_part").withColumn("seq", (place + F.col("_before")).cast("bigint")).drop("_part", "_before")


def level(nodes: DataFrame) -> DataFrame:
    """(seq, h) of the level above."""
    pair = nodes.groupBy(F.floor(F.col("seq") / 2).cast("bigint").alias("seq")).agg(F.min_by("h", "seq").alias("left"), F.max_by("h", "seq").alias("right"))
    return pair.select("seq", F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("left"), F.unhex("right")), 256).alias("h"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels from the leaves (numbered from 0 without gaps) to the root, each written to the shared folder."""
    out = [written(nodes, "leaves")]
    n = out[0].count()
    while n > 1:
        out.append(written(level(out[-1]), "level"))
        n = (n + 1) // 2
    return out


def root(nodes: DataFrame) -> str | None:
    top = levels(nodes)[-1].first()
    return top["h"] if top else None


def inclusion_proof(tree: list[DataFrame], seq: int) -> list[str]:
    """The hash beside each node from the leaf up, its own where it is an odd last one: one point look-up a level."""
    proof = []
    for nodes in tree[:-1]:
        row = nodes.where(F.col("seq") == (seq ^ 1)).first() or nodes.where(F.col("seq") == seq).first()
        proof.append(row["h"])
        seq //= 2
    return proof


def verify_inclusion(leaf: str, seq: int, proof: list[str], top: str) -> bool:
    for beside in proof:
        left, right = (leaf, beside) if seq % 2 == 0 else (beside, leaf)
        leaf = hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()
        seq //= 2
    return leaf == top


def _blocks(start: int, end: int) -> list[tuple[int, int]]:
    """(level, seq) of the largest whole subtrees that lie side by side from leaf ``start`` to before ``end``."""
    found = []
    while start < end:
        level = min((start & -start).bit_length() - 1 if start else end.bit_length(), (end - start).bit_length() - 1)
        found.append((level, start >> level))
        start += 1 << level
    return found


def consistency_proof(tree: list[DataFrame], first: int, second: int) -> dict[tuple[int, int], str]:
    """Hashes by (level, seq) that show that the log of ``first`` records begins the log of ``second``.

    They are those of the whole subtrees that make up the first ``first`` leaves, and of those from there to ``second``:
    2 log2 n at most, looked up on the stored levels of the tree, which may have grown beyond ``second``.
    """
    if not 0 < first <= second:
        raise ValueError("a proof needs 0 < first <= second")
    asked: dict[int, list[int]] = {}
    for level, seq in _blocks(0, first) + _blocks(first, second):
        asked.setdefault(level, []).append(seq)
    if max(asked) >= len(tree):
        raise ValueError(f"the log has fewer than {second} records")
    found = {(k, r["seq"]): r["h"] for k, seqs in asked.items() for r in tree[k].where(F.col("seq").isin(seqs)).collect()}  # a row for each block
    if len(found) < sum(map(len, asked.values())):
        raise ValueError(f"the log has fewer than {second} records")
    return found


def root_of(size: int, known: dict[tuple[int, int], str]) -> str:
    """The root over ``size`` leaves from hashes of whole subtrees; a missing one is a ``KeyError``."""

    def node(level: int, seq: int) -> str:
        whole = (seq + 1) << level <= size
        if whole and ((level, seq) in known or not level):
            return known[level, seq]
        left = node(level - 1, 2 * seq)
        right = node(level - 1, 2 * seq + 1) if (2 * seq + 1) << (level - 1) < size else left  # an odd last one
        return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()

    return node((size - 1).bit_length(), 0)


def verify_consistency(proof: dict[tuple[int, int], str], first: int, second: int, first_root: str, second_root: str) -> bool:
    """Whether the proof's hashes, and no others, give both roots: the later log holds the earlier one's subtrees."""
    if not 0 < first <= second:
        return False
    old, more = _blocks(0, first), _blocks(first, second)
    if set(proof) != {*old, *more}:
        return False
    return root_of(first, {k: proof[k] for k in old}) == first_root and root_of(second, proof) == second_root


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The row of the greatest ``at`` for each key; a map-side maximum, no window."""
    others = [c for c in rows.columns if c not in (key, at)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("_row"))
    return best.select(key, "_row.*")


def registry(log: DataFrame) -> DataFrame:
    """(model, parent, canary_since, status) replayed from a log of (seq, kind, model, parent).

    ``aggregate`` registers a model, the first entry of its name counts; ``promote`` makes it the only active one;
    ``rollback`` of a model makes its parent active. The entry of the last promotion or rollback decides.
    """
    made = log.where("kind = 'aggregate'").groupBy("model").agg(F.min_by("parent", "seq").alias("parent"), F.min("seq").alias("canary_since"))
    turns = log.where("kind in ('promote', 'rollback')").join(made.select("model", F.col("parent").alias("_parent")), "model")
    target = F.when(F.col("kind") == "promote", F.col("model")).otherwise(F.col("_parent"))
    active = turns.agg(F.max_by(target, "seq").alias("active"))  # one row
    ever = log.where("kind = 'promote'").groupBy("model").agg(F.max("seq").alias("_promoted"))
    status = F.when(F.col("model") == F.col("active"), "active").when(F.col("_promoted").isNotNull(), "retired").otherwise("canary")
    return made.join(ever, "model", "left").crossJoin(F.broadcast(active)).select("model", "parent", "canary_since", status.alias("status"))
