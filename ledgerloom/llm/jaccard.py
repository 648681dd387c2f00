"""N-gram Jaccard self-join by count-vector R-trees.

A document's set is its distinct word shingles. Its tokens (shingle hashes) are hashed into ``FINE`` groups and the
counts by group are a point. Of two sets, the sum over groups of the smaller count bounds the overlap, so an
R-tree over points (folded to ``GROUPS`` coordinates for its boxes) prunes whole boxes: a pair of boxes whose summed
coordinate minima stay under the overlap that the threshold asks of their smallest sizes has no link. Pairs of
points that survive meet the same bound on all ``FINE`` groups, sets of more than ``LONG`` tokens once more on ``WIDE``
groups, and are then verified on the whole texts.

One tree over everything would be one task, so there is a tree for each shard, and shards follow from a rule
that loses no pair: under any fixed order of tokens, two sets with J >= t share ``k`` tokens among the first
``n - ceil(t n) + k`` of each, and their sizes are of one class or of two that follow each other. ``k`` is 1 and one more for
each ``SHARED`` tokens; a set that has fewer tokens in shards of several components goes to no tree. Each such token with
two such classes is a shard; shards of the same sets are one. The order puts frequent tokens last and is by hash otherwise. Frequencies are estimated over all documents, by a count
sketch of fixed size that tasks fill and that is added up; they steer cost only, never the result.

Equal sets are one row from the start (128 bits of sums of their token hashes). Then a leader round: every set is
verified against the shard-mates that lead most of its shards, which joins families of copies without comparing all
their pairs; with other leaders it is repeated while shards of several components are large and a good part of what it
verifies is linked. It may pass over any pair, since what it leaves apart the trees still compare. Then trees are
built for the shards that still hold several components, boxes of one component are not descended into, and only
pairs across components are verified; links inside a component cannot change it. A pair that meets in several
shards is taken in the first only, as far as the ``EARLIER`` first shards of both sets tell. Shards of more than
``BLOCK`` sets are dealt to tasks by pairs of blocks.

Defined results: null and empty texts have an empty set (n_shingles 0) and are their own component; fewer
than five words are one shingle; rows with a null id take part and get the smallest non-null id of their
component, null where it has none; repeated rows are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BROADCAST_KEYS, ROW_KEY, components, keyed, map_arrow, stored
from ledgerloom.llm.wordhash import mix, shingle_sets

GROUPS = 128
FINE = 512
WIDE = 4096
LONG = 1500
LEAF = 32
BLOCK = 4096
SLICE = 512
EARLIER = 4
#: Box pairs, and pairs of points, looked at in one step: some 8 MB of coordinates.
BOXES = 16
STEP = 4096
#: The count sketch: rows of 2**16 signed counters. A token is frequent in this many distinct sets at least.
SKETCH = 3
FREQUENT_LEAST = 6
#: Prefixes are longer by a token for each so many, and sets that link share as many more.
SHARED = 64
ROUNDS = 6
CLASSES = 512
#: Another round of leaders where shards of several components hold this many pairs for each of their rows.
CROWDED = 1024


_COMPRESS = zstandard.ZstdCompressor(level=1, write_checksum=False)
_DECOMPRESS = zstandard.ZstdDecompressor()


def _prefix(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many of a set's first tokens must be looked at; exact in integers, threshold in hundredths."""
    return n - (threshold * n + 99) // 100 + 1 + n // SHARED


def least_shared(n: Column, threshold: int) -> Column:
    """How many of its first tokens a set shares with any set that it links to: the smaller one's own number."""
    return F.floor(F.floor((threshold * n + 99) / 100) / SHARED) + 1


def _set_ids(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set: mixed sums of its tokens, mixed in two ways, and of its size."""
    out = []
    for salt in (1, 0x5851F42D4C957F2D):
        with np.errstate(over="ignore"):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(salt)), dtype=np.uint64)])
            out.append(mix(running[first[1:]] - running[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _slots(tokens: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each token in one row of the sketch."""
    return ((tokens >> np.uint64(16 * row)) & np.uint64(0xFFFF)).astype(np.int64), ((tokens >> np.uint64(63 - row)) & np.uint64(1)).astype(np.float64) * 2 - 1


def frequent_from(sketch: np.ndarray) -> float:
    """The count from which a token is frequent: as low as the sketch can tell it from chance.

    That is the middle counter, which grows as the root of the tokens. A share of the sets would let ever more sets meet in
    one token that still counts as rare, and what is shuffled would grow faster than the input.
    """
    return max(FREQUENT_LEAST, float(np.median(np.abs(sketch))))


def token_sketch(df: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The count sketch of the tokens of all distinct sets (as each task sees them), and their number."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, sets = np.zeros((SKETCH, 1 << 16)), set(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                tokens, first = shingle_sets(batch.column(0).slice(at, SLICE), size)
                n = np.diff(first)
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(_set_ids(tokens, first)[0].tolist()):
                    if n[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                sets += int(fresh.sum())
                tokens = tokens[np.repeat(fresh, n)]
                for row in range(SKETCH):
                    slot, sign = _slots(tokens, row)
                    counts[row] += np.bincount(slot, sign, minlength=1 << 16)
        if sets:
            parts = counts.reshape(-1, 1 << 12)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "sets": pa.array([sets] * len(parts), pa.int64()), "counts": [p.tobytes() for p in parts]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for part, sets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(part, [0, 0.0])
                held[0], held[1] = held[0] + sets, held[1] + np.frombuffer(counts)
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "sets": pa.array([v[0] for v in total.values()], pa.int64()), "counts": [v[1].tobytes() for v in total.values()]})

    schema = "part int, sets bigint, counts binary"
    filled = map_arrow(df.select("text"), fill, schema)
    rows = sorted(map_arrow(filled.repartition("part"), add, schema).collect())  # 48 rows of 32 KB
    whole = np.concatenate([np.frombuffer(r.counts) for r in rows]) if rows else np.zeros(SKETCH << 16)
    return whole.reshape(SKETCH, 1 << 16), rows[0].sets if rows else 0


def profiles(df: DataFrame, size: int, threshold: int, held) -> DataFrame:
    """(doc_id, row key, n, h1, h2, tokens, common, fine, wide) of every row (doc_id, text, row key).

    ``tokens`` and ``common`` are the rare and the frequent tokens to be looked at; they and the points are null where
    the task has emitted the set before, and ``wide`` is null for sets that are not long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held.value
        least = frequent_from(sketch)
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                tokens, first = shingle_sets(part.column(1), size)
                n = np.diff(first)
                h1, h2 = _set_ids(tokens, first)
                late = np.ones(len(tokens), bool)
                for row in range(SKETCH):
                    slot, sign = _slots(tokens, row)
                    late &= sketch[row][slot] * sign >= least
                short = (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)
                take = _prefix(n, threshold)
                rare: list = [None] * len(n)
                common: list = [None] * len(n)
                fine: list = [None] * len(n)
                wide: list = [None] * len(n)
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if n[i] and key not in seen:
                        seen.add(key)
                        a, b = first[i], first[i + 1]
                        rare[i] = short[a:b][~late[a:b]][: take[i]]
                        common[i] = short[a:b][late[a:b]][: take[i] - len(rare[i])]
                        fine[i] = _pack(np.bincount((tokens[a:b] % np.uint64(FINE)).astype(np.int64), minlength=FINE))
                        if n[i] > LONG:
                            wide[i] = _pack(np.bincount((tokens[a:b] % np.uint64(WIDE)).astype(np.int64), minlength=WIDE))
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), _lists(rare), _lists(common), pa.array(fine, pa.binary()), pa.array(wide, pa.binary())],
                    names=["doc_id", ROW_KEY, "n", "h1", "h2", "tokens", "common", "fine", "wide"],
                )

    kind = df.schema[0].dataType.simpleString()
    return map_arrow(df, run, f"doc_id {kind}, {ROW_KEY} bigint, n bigint, h1 bigint, h2 bigint, tokens array<int>, common array<int>, fine binary, wide binary")


def _lists(arrays: list) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in arrays], out=ends[1:])
    flat = np.concatenate([np.empty(0, np.int32), *(x for x in arrays if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _pack(counts: np.ndarray) -> bytes:
    """Counts in half a byte each where all are small, else in one, two or four bytes, entropy-coded."""
    top = counts.max()
    raw = (counts[0::2] | counts[1::2] << 4).astype(np.uint8) if top < 16 else counts.astype("<u1" if top < 2**8 else "<u2" if top < 2**16 else "<u4")
    return _COMPRESS.compress(raw.tobytes())


def _points(column: pa.ChunkedArray | pa.Array, groups: int = FINE) -> np.ndarray:
    """The packed points of a column as a matrix."""
    cells = [_DECOMPRESS.decompress(x) for x in column.to_pylist()]
    out = np.empty((len(cells), groups), np.int32)
    length = np.array([len(x) for x in cells])
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        raw = b"".join([cells[i] for i in own]) if len(own) < len(cells) else b"".join(cells)
        if 2 * size == groups:
            packed = np.frombuffer(raw, np.uint8).reshape(len(own), size)
            both = np.empty((len(own), groups), np.int32)
            both[:, 0::2], both[:, 1::2] = packed & 15, packed >> 4
            out[own] = both
        else:
            out[own] = np.frombuffer(raw, f"<u{size // groups}").reshape(len(own), groups)
    return out


def fold(points: np.ndarray) -> np.ndarray:
    """Points of ``FINE`` groups as points of ``GROUPS`` groups."""
    return points.reshape(len(points), FINE // GROUPS, GROUPS).sum(1)


def _possible(bound: np.ndarray, least: np.ndarray, threshold: int) -> np.ndarray:
    """Whether an overlap of at most ``bound`` can reach the threshold when sizes sum to at least ``least``."""
    return (100 + threshold) * bound >= threshold * least


class Tree:
    """An R-tree over points packed bottom-up; ``levels[0]`` are leaves of ``LEAF`` points."""

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray):
        # sort by size, then tile by the coordinates that vary most
        spread = np.argsort(points.var(0))[::-1][:2]
        tile = np.argsort(np.argsort(n, kind="stable"), kind="stable") // max(1, LEAF * 4)
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], tile))
        points, n, comp = points[self.order], n[self.order], comp[self.order]
        self.levels = [(points, n, n, comp, comp)]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            high, low_n, high_n, low_c, high_c = self.levels[-1]
            cut = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut), np.minimum.reduceat(low_c, cut), np.maximum.reduceat(high_c, cut)))

    def pairs(self, threshold: int, level: int | None = None, a: np.ndarray | None = None, b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (as places in the input) that no bound rules out and that are not of one component, a few at a time."""
        if level is None:
            level, a, b = len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64)
        high, low_n, high_n, low_c, high_c = self.levels[level - 1]
        for at in range(0, len(a), BOXES):
            i = (a[at : at + BOXES, None] * LEAF + np.arange(LEAF))[:, :, None]
            j = (b[at : at + BOXES, None] * LEAF + np.arange(LEAF))[:, None, :]
            i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
            keep = (i < len(high)) & (j < len(high)) & ((i <= j) if level > 1 else (i < j))
            i, j = i[keep], j[keep]
            keep = (100 * high_n[i] >= threshold * low_n[j]) & (100 * high_n[j] >= threshold * low_n[i])
            keep &= (np.minimum(low_c[i], low_c[j]) < np.maximum(high_c[i], high_c[j]))
            i, j = i[keep], j[keep]
            keep = _possible(np.minimum(high[i], high[j]).sum(1), low_n[i] + low_n[j], threshold)
            i, j = i[keep], j[keep]
            if level > 1:
                yield from self.pairs(threshold, level - 1, i, j)
            elif len(i):
                yield self.order[i], self.order[j]


def _leaf_pairs(start: np.ndarray, size: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside each short run of rows, a leaf each, for which ``wanted`` holds."""
    last = np.repeat(start + size, size)
    rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    for step in range(1, int(size.max()) if len(size) else 0):
        keep = rows + step < last
        rows, last = rows[keep], last[keep]
        apart = wanted(rows, rows + step)
        yield rows[apart], rows[apart] + step


def tree_pairs(shards: DataFrame, threshold: int) -> DataFrame:
    """(a, b) pairs of sets of different components that share a shard and pass its R-tree; distinct.

    Rows (x1, x2, lo, hi, block, key, comp, n, fine, earlier) arrive sorted by shard. Shards of at most one leaf are
    compared many at a time.
    """

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("x1", "x2", "lo", "hi")], axis=1)
        key, n, comp, block = (rows.column(c).to_numpy() for c in ("key", "n", "comp", "block"))
        split = shard[:, 2] != shard[:, 3]
        fine = _points(rows.column("fine"))
        # the first shards of each set; what is at or after the row's own does not count, and no two sets share the filler
        lists = rows.column("earlier").combine_chunks()
        ends = lists.offsets.to_numpy()
        earlier = np.full((len(key), EARLIER), -1, np.int64)
        owner = np.repeat(np.arange(len(key)), np.diff(ends))
        earlier[owner, np.arange(len(owner)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))] = lists.flatten().to_numpy()
        valid = np.arange(EARLIER)[None, :] < np.diff(ends)[:, None]
        valid &= earlier < shard[:, :1]

        def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (comp[i] != comp[j]) & (~split[i] | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = [(i[:0], j[:0])]
            for at in range(0, len(i), STEP):
                x, y = i[at : at + STEP], j[at : at + STEP]
                keep = _possible(np.minimum(fine[x], fine[y]).sum(1), n[x] + n[y], threshold)
                x, y = x[keep], y[keep]
                met = ((earlier[x][:, :, None] == earlier[y][:, None, :]) & valid[x][:, :, None] & valid[y][:, None, :]).any((1, 2))
                out.append((x[~met], y[~met]))
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            start = np.concatenate([[0], np.flatnonzero((shard[1:] != shard[:-1]).any(1)) + 1])
            size = np.diff(np.append(start, len(shard)))
            small = size <= LEAF
            for i, j in _leaf_pairs(start[small], size[small], wanted):
                yield kept(i, j)
            for a, m in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
                for i, j in Tree(fold(fine[a : a + m]), n[a : a + m], comp[a : a + m]).pairs(threshold):
                    apart = wanted(i + a, j + a)
                    yield kept(i[apart] + a, j[apart] + a)

        ready, waiting = [], 0
        for i, j in found():
            if len(i):
                ready.append((np.minimum(key[i], key[j]), np.maximum(key[i], key[j])))
                waiting += len(i)
            if waiting > 65_536:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)], names=["a", "b"])
                ready, waiting = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole shards at a time: a batch is cut where its last shard begins
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            begins = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            if held and tuple(ids[0]) != tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in range(4)):
                begins = np.concatenate([[0], begins])
            if len(begins):
                cut = int(begins[-1])
                ready = held + ([batch.slice(0, cut)] if cut else [])
                if ready:
                    yield from pairs_of(pa.Table.from_batches(ready))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return map_arrow(shards, run, "a bigint, b bigint").distinct()


def _overlap_bounds(left: pa.Array, right: pa.Array, groups: int) -> np.ndarray:
    return np.minimum(_points(left, groups), _points(right, groups)).sum(1)


def bounded(pairs: DataFrame, sets: DataFrame, threshold: int, small: bool) -> DataFrame:
    """The pairs (a, b) that no count-vector bound rules out; ``small`` pairs are broadcast, and only their sets move."""
    held = F.broadcast(pairs) if small else pairs
    points = lambda s: [F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("fine").alias(f"p{s}"), F.col("wide").alias(f"w{s}")]
    left = sets.select(*points("a")).join(held, "a")
    right = sets.join(F.broadcast(pairs.select(F.col("b").alias("key")).distinct()), "key", "left_semi") if small else sets
    rows = left.join(right.select(*points("b")), "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b", "na", "nb", "pa", "pb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                least = part.column(2).to_numpy() + part.column(3).to_numpy()
                keep = _possible(_overlap_bounds(part.column(4), part.column(5), FINE), least, threshold)
                both = np.flatnonzero(keep & part.column(6).is_valid().to_numpy(zero_copy_only=False) & part.column(7).is_valid().to_numpy(zero_copy_only=False))
                for x in range(0, len(both), STEP * FINE // WIDE):
                    own = both[x : x + STEP * FINE // WIDE]
                    keep[own] = _possible(_overlap_bounds(part.column(6).take(pa.array(own)), part.column(7).take(pa.array(own)), WIDE), least[own], threshold)
                yield part.select([0, 1]).filter(pa.array(keep))

    return map_arrow(rows, run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int, small: bool) -> DataFrame:
    """The pairs (a, b) whose sets, computed from the whole texts, reach the threshold."""
    rows = texts.select(F.col("key").alias("b"), F.col("text").alias("tb")).join(F.broadcast(pairs) if small else pairs, "b")
    rows = rows.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                left, lf = shingle_sets(part.column(2), size)
                right, rf = shingle_sets(part.column(3), size)
                keep = []
                for k in range(part.num_rows):
                    x, y = left[lf[k] : lf[k + 1]], right[rf[k] : rf[k + 1]]
                    spot = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                    common = int((y[spot] == x).sum()) if len(y) else 0
                    keep.append(100 * common >= threshold * (len(x) + len(y) - common))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, run, "a bigint, b bigint")


def size_classes(threshold: int) -> list[int]:
    """Least sizes of classes such that sets that link are of one class or of two that follow each other; exact in integers."""
    out = [1]
    while out[-1] < 2**31:
        out.append(out[-1] * 100 // threshold + 1)
    if len(out) > CLASSES:
        raise ValueError("the threshold must be 0.95 at most")
    return out


def shards_of(sets: DataFrame) -> DataFrame:
    """(x1, x2, key, weight) of every set in every shard of several sets; ``weight`` is how many tokens are that shard.

    A key's remainder by ``CLASSES`` is its size class. A shard is a token and the sets of a class, one at least, and of
    the class above. It is named by two 64-bit sums over its members, so shards of the same sets are one. Rare tokens
    meet in one task each; frequent ones are counted before they are shuffled, and their join is split where it is skewed.
    """
    own = F.col("key") % CLASSES
    lower = F.explode(F.array(own, own - 1)).alias("low")
    names = {"sets": F.count("*"), "least": F.min(own), "x1": F.bit_xor(F.xxhash64("key")), "x2": F.bit_xor(F.xxhash64("key", F.lit(1)))}
    by_token, by_both = Window.partitionBy("token"), Window.partitionBy("token", "low")
    rare = sets.select(F.explode("tokens").alias("token"), "key").repartition("token").withColumn("sets", F.count("*").over(by_token)).where("sets > 1")
    rare = rare.select("token", "key", lower).withColumns({c: names[c].over(by_both) for c in ("sets", "least")}).where("sets > 1 and least = low")
    rare = rare.withColumns({c: names[c].over(by_both) for c in ("x1", "x2")})
    often = sets.select(F.explode("common").alias("token"), "key").select("token", "key", lower)
    often = often.join(often.groupBy("token", "low").agg(*(x.alias(c) for c, x in names.items())).where("sets > 1 and least = low"), ["token", "low"])
    both = rare.select("x1", "x2", "key").union(often.select("x1", "x2", "key"))
    return both.groupBy("x1", "x2", "key").agg(F.count("*").alias("weight"))


def _components(shards: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``shards`` with the component of each set."""
    if roots is None:
        return shards.withColumn("comp", F.col("key"))
    return shards.join(roots, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")


def _leading(shards: DataFrame, sets: DataFrame, order: Column, leaders: int, threshold: int) -> DataFrame:
    """(a, b): sets b and the ``leaders`` sets of other components that lead most of their shards.

    A pair goes on only where the sizes allow a link and the leader leads a twenty-fifth of the set's tokens: of a
    link's tokens far more come first in both.
    """
    ranges = shards.groupBy("x1", "x2").agg(F.min(F.struct(order.alias("o"), "key", "comp")).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rows = shards.join(ranges.select("x1", "x2", F.col("lead.key").alias("leader"), F.col("lead.comp").alias("other")), ["x1", "x2"]).where("comp <> other")
    votes = rows.groupBy("key", "leader").agg(F.sum("weight").alias("k"))
    sizes = sets.select("key", "n")
    votes = votes.join(sizes, "key").where("25 * k >= n").join(sizes.select(F.col("key").alias("leader"), F.col("n").alias("m")), "leader").where(f"100 * least(n, m) >= {threshold} * greatest(n, m)")
    best = Window.partitionBy("key").orderBy(F.desc("k"), "leader")
    votes = votes.withColumn("r", F.row_number().over(best)).where(F.col("r") <= leaders)
    return votes.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 75, leaders: int = 3) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links."""
    spark = df.sparkSession
    key = F.col(ROW_KEY).alias(ROW_KEY)
    docs = keyed(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([key] if ROW_KEY in df.columns else [])))
    held = spark.sparkContext.broadcast(token_sketch(docs, size)[0])  # of fixed size
    every = stored(profiles(docs.select("doc_id", "text", ROW_KEY), size, threshold, held), "profiles")
    # one row for each set: tasks emit a set's tokens once, different tasks may repeat it
    one = F.any_value(F.when(F.col("fine").isNotNull(), F.struct("n", "fine", "wide", "tokens", "common")), F.lit(True)).alias("one")
    sets = every.where("n > 0").groupBy("h1", "h2").agg(one, F.min("doc_id").alias("doc_id"), F.min(ROW_KEY).alias("row"))  # ids may be null
    of_size = F.size(F.filter(F.array(*(F.lit(x) for x in size_classes(threshold))), lambda x: x <= F.col("n"))) - 1
    sets = stored(sets.select("h1", "h2", "one.*", "doc_id", "row").withColumn("key", F.monotonically_increasing_id() * CLASSES + of_size), "sets")
    shards = stored(shards_of(sets), "shards")

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The links among stored candidates, and how many candidates the bounds left."""
        small = pairs.count() <= BROADCAST_KEYS
        near = stored(bounded(pairs, sets, threshold, small), "near")
        tried = near.count()
        needed = near.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(sets.select("key", F.col("row").alias(ROW_KEY)), "key")
        needed = stored(needed, "needed")
        small = tried <= BROADCAST_KEYS // 2
        texts = docs.join(F.broadcast(needed) if small else needed, ROW_KEY).select("key", "text")
        return stored(verified(near, texts, size, threshold, small), "links"), tried

    links, roots = None, None
    for turn in range(ROUNDS):
        order = F.col("key") if turn == 0 else F.xxhash64("key", F.lit(turn))
        new, tried = linked(stored(_leading(_components(shards, roots), sets, order, leaders, threshold), "pairs"))
        links = new if links is None else links.union(new)
        roots = components(links)
        # what is left for trees: the shards with several components
        kept = _components(shards, roots)
        several = kept.groupBy("x1", "x2").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("sets")).where("low < high")
        kept = stored(kept.join(several.select("x1", "x2", "sets"), ["x1", "x2"]), "several")
        rows, pairs = kept.agg(F.count("*"), F.sum((F.col("sets") - 1) / 2)).first()
        if (pairs or 0) <= CROWDED * rows or new.count() * 8 <= tried:
            break

    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    first = kept.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("x1")), 1, EARLIER).alias("earlier"), F.sum("weight").alias("shared"))  # a set has no more shards than tokens
    kept = kept.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    kept = kept.select("x1", "x2", "key", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    kept = kept.join(sets.select("key", "n", "fine").join(first, "key").where(F.col("shared") >= least_shared(F.col("n"), threshold)), "key")
    kept = kept.select("x1", "x2", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "comp", "n", "fine", F.filter("earlier", lambda x: x < F.col("x1")).alias("earlier"))
    shard = ["x1", "x2", "lo", "hi"]
    pairs = stored(tree_pairs(kept.repartition(*shard).sortWithinPartitions(*shard), threshold), "pairs")
    roots = components(links.union(linked(pairs)[0]))

    named = sets.select("key", "h1", "h2", "doc_id").join(roots, F.col("key") == F.col("node"), "left").select("h1", "h2", "doc_id", "root")
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    named = named.join(least, "root", "left").select("h1", "h2", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))
    out = every.select("doc_id", "n", "h1", "h2").where("n > 0").join(named, ["h1", "h2"]).select("doc_id", "n", "component_id")
    out = out.union(every.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
