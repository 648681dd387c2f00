"""Near-duplicate vectors by lattice hashing on E8.

Each of ``tables`` random projections takes the unit vector to 8 dimensions, scaled, and decodes it to the
nearest E8 lattice point. A vector is filed under that cell and under the neighbouring cells whose centres
are next nearest, so two near vectors meet although a cell wall parts them. Vectors that share a cell are
compared exactly, by cosine in double precision; no pair below ``threshold`` is linked.

Equal vectors with equal labels are one row from the start. Cells with one vector go no further; the members
of a cell are compared in blocks, pairs of blocks of a large cell in tasks of their own, and a pair that meets
in several cells counts in the first only. A task returns for each vector its number of links and a
spanning forest of the links, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without
a label, have no links and are their own component; vectors of different lengths do not link. Rows with a
null id take part and get the smallest id of their component, null where it has none; rows of one id are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import components, map_arrow, stored
from ledgerloom.llm.wordhash import mix

BLOCK = 1024
SLICE = 2048


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 - 2 * (bits >> k & 1) for k in range(8)]) / 2
        if (signs < 0).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


ROOTS = _roots()


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) % 2)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 together with D8 shifted by one half."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cell_keys(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(n, tables * (1 + probes)) signed 64-bit cell hashes of unit vectors."""
    n, d = unit.shape
    rng = np.random.default_rng([seed, d])
    slots = rng.integers(1, 2**63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.int64)
    with np.errstate(over="ignore"):
        base = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
        for t in range(tables):
            basis = rng.standard_normal((d, 8)) if d < 8 else np.linalg.qr(rng.standard_normal((d, 8)))[0]
            x = unit @ basis * scale
            home = decode_e8(x)
            nearest = np.argsort(-((x - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
            cells = np.concatenate([home[:, None], home[:, None] + ROOTS[nearest]], axis=1)
            whole = np.rint(cells * 2).astype(np.int64).view(np.uint64)
            out[:, t] = mix((whole * slots[:8]).sum(2, dtype=np.uint64) + base[:, None] + slots[8] * np.uint64(t + 1)).view(np.int64)
    return out.reshape(n, -1)


def _links(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, keys: np.ndarray, block: np.ndarray, key: int, pair: tuple[int, int], threshold: float):
    """Link counts by row and forest edges of one cell, or one pair of its blocks."""
    left, right = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    counts = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        a, b = np.nonzero(unit[rows] @ unit[right].T >= threshold - 1e-9)
        a, b = rows[a], right[b]
        keep = a < b if pair[0] == pair[1] else a >= 0
        a, b = a[keep], b[keep]
        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[exact], b[exact]
        for part in range(0, len(a), 4096):
            i, j = a[part : part + 4096], b[part : part + 4096]
            # the pair counts only in the smallest cell that both are filed under
            shared = keys[i][:, :, None] == keys[j][:, None, :]
            first = np.where(shared.any(2), keys[i], np.iinfo(np.int64).max).min(1)
            i, j = i[first == key], j[first == key]
            np.add.at(counts, i, sizes[j])
            np.add.at(counts, j, sizes[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = top(x), top(y)
                if p != q:
                    parent[p] = q
                    edges.append((ids[x], ids[y]))
    return counts, edges


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = 4, probes: int = 3, scale: float = 4.5, seed: int = 17) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("bigint").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    good = rows.where(usable).withColumn("print", F.xxhash64("v"))
    # a class is equal vectors of a label; a 128-bit print stands for the vector in joins
    good = good.withColumn("print2", F.xxhash64("label", F.lit(7), "v"))
    classes = good.groupBy("label", "print", "print2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # ids may be null or repeated

    def file_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
                values = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for d in np.unique(lengths):
                    own = np.flatnonzero(lengths == d)
                    v = values[(ends[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)
                    unit = v / np.abs(v).max(1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    keys = cell_keys(unit, part.column(1).to_numpy()[own], tables, probes, scale, seed)
                    ids = part.column(0).to_numpy()[own]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["rep", "keys"])

    filed = stored(map_arrow(classes.select("rep", "label", "v"), file_cells, "rep bigint, keys array<bigint>"), "cells")
    cells = filed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    counts = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = cells.join(counts, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    shared = shared.select("rep", "key", "block", other).select("rep", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = shared.join(classes.select("rep", "size", "v").join(filed, "rep"), "rep")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "block", "rep", "size", "v", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def judge(table: pa.Table) -> pa.RecordBatch:
            ids, sizes, block = (table.column(c).to_numpy() for c in ("rep", "size", "block"))
            v = table.column("v").combine_chunks()
            lengths = np.diff(v.offsets.to_numpy()[: len(v) + 1])
            keys = np.array(table.column("keys").to_pylist(), np.int64)
            key, pair = table.column("key")[0].as_py(), (table.column("lo")[0].as_py(), table.column("hi")[0].as_py())
            links, edges = np.zeros(len(ids), np.int64), []
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                x = np.array(v.take(pa.array(own)).to_pylist(), np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links[own], more = _links(ids[own], sizes[own], x, keys[own], block[own], key, pair, threshold)
                edges += more
            some = np.flatnonzero(links)
            a = np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(some) + [int(e[1]) for e in edges], pa.int64())
            n = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

        def groups() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                k = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
                starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]]) if len(k) else np.array([0])
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    now = tuple(k[x])
                    if held and now != last:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(x, y - x))
                    last = now
            if held:
                yield pa.Table.from_batches(held)

        for group in groups():
            if group.num_rows > 1:
                waiting.append(judge(group))
                if len(waiting) >= 512:
                    yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if sum(w.num_rows for w in waiting) else waiting[0]
                    waiting = []
        yield from (w for w in waiting if w.num_rows)

    found = stored(map_arrow(full, compare, "a bigint, b bigint, n bigint"), "links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    roots = roots.join(classes.select(F.col("rep").alias("node"), "least"), "node")
    least = roots.groupBy("root").agg(F.min("least").alias("lowest"))
    roots = stored(roots.join(least, "root").select("node", "lowest"), "roots")
    named = classes.select("label", "print", "print2", "rep", "size", "least").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id")
    named = named.select("label", "print", "print2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), own)
    linked = good.select("id", "label", "print", "print2").join(named, ["label", "print", "print2"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
