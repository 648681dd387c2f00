"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, A-Z in lower case. A mask is a fixed set of positions in a window of
``SPAN`` words; the others are ignored, so a substituted word there leaves the hash alone. All masks of every
window of a document are joined with those of the benchmark items; around each hit the item is laid along
the document at the hit's offset and the aligned words are compared, growing the overlap both ways while
matches outweigh substitutions; where all equal words at the offset cover the item they count too, so that many
changes do not end an overlap. Items under ``LIGHT_BELOW`` words have lighter masks besides. Overlaps of one item at several offsets (insertions, deletions) add up. A
document is contaminated by an item when the matched words cover ``coverage`` of it or number ``run``.

The benchmark is the query side: its hashes are handed to the tasks in blocks of at most ``BLOCK_WORDS``
words, each block a pass over the documents, so what is broadcast is bounded whatever the benchmark's size,
and documents are never shuffled.

Defined results: null and empty texts match nothing; items shorter than ``SPAN`` words have the lighter
masks and a mask of all their words, if they have at least ``LEAST`` words; shorter ones are never matched. A copy
that keeps no four words of any mask is missed. Repeated rows are reported
each. Texts are scanned whole, a batch of documents at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import map_arrow
from ledgerloom.llm.wordhash import PUNCTUATION, window_hashes, word_hashes

#: Fixed masks: positions of a window of 11 words that count.
MASKS = ((0, 1, 2, 4, 7, 9, 10), (0, 2, 3, 5, 6, 8, 10), (0, 1, 3, 4, 6, 8, 9))
#: Fixed masks of four words for items under ``LIGHT_BELOW`` words, where heavier ones miss changed copies.
LIGHT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 3, 5), (0, 2, 4, 5), (0, 1, 4, 6), (0, 2, 5, 6), (0, 3, 4, 7), (0, 1, 5, 7), (0, 2, 4, 8), (0, 3, 6, 8))
LIGHT_BELOW = 48
SPAN = 11
LEAST = 5
SLICE = 256
#: Words compared at once.
ALIGNED = 2_000_000
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id {kind}, item_id {item}, matched int, item_words int, coverage double, first_word bigint, last_word bigint"


def _seeds(words: np.ndarray, first: np.ndarray, masks: tuple = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every masked window that stays inside its text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, places = [], []
    for k, mask in enumerate(masks):
        h = window_hashes(words, list(mask)) ^ np.uint64(k + 1)
        at = np.flatnonzero(text[: len(h)] == text[len(text) - len(h) :]) if len(h) else np.empty(0, np.int64)
        hashes.append(h[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


class Index:
    """Seeds of a block of benchmark items, sorted, with a bit table in front."""

    def __init__(self, ids: list, words: np.ndarray, first: np.ndarray):
        self.ids, self.words, self.first = ids, words, first
        hashes, places = _seeds(words, first)
        self.lengths = np.diff(first)
        short = np.flatnonzero((self.lengths >= LEAST) & (self.lengths < SPAN))
        self.short_sizes = sorted({int(self.lengths[i]) for i in short})
        extra = [window_hashes(words[first[i] : first[i + 1]], list(range(self.lengths[i])))[:1] for i in short]
        if extra:
            hashes, places = np.concatenate([hashes, *extra]), np.concatenate([places, first[short]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]
        self.item = np.searchsorted(first, self.places, side="right") - 1
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        # the lighter seeds of the shorter items, looked up one mask at a time
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        few = (self.lengths >= LEAST) & (self.lengths < LIGHT_BELOW)
        self.light = []
        for mask in LIGHT_MASKS:
            hashes, places = _seeds(words, first, (mask,))
            own = few[owner[places]]
            order = np.argsort(hashes[own], kind="stable")
            hashes, places = hashes[own][order], places[own][order]
            bits = np.zeros(1 << 22, bool)
            bits[(hashes >> np.uint64(42)).astype(np.int64)] = True
            self.light.append((mask, hashes, places, bits))

    def diagonals(self, words: np.ndarray, first: np.ndarray, places: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Distinct (text, item, offset) rows at which a text and an item share a seed, the given hits included."""
        pairs = [(places, self.places[entries])]
        for mask, hashes, spots, bits in self.light:
            if len(hashes):
                ours, at = _seeds(words, first, (mask,))
                likely = bits[(ours >> np.uint64(42)).astype(np.int64)]
                ours, at = ours[likely], at[likely]
                low, high = np.searchsorted(hashes, ours, "left"), np.searchsorted(hashes, ours, "right")
                n = high - low
                pairs.append((np.repeat(at, n), spots[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]))
        at, spot = (np.concatenate(x) for x in zip(*pairs, strict=True))
        text, item = np.searchsorted(first, at, side="right") - 1, np.searchsorted(self.first, spot, side="right") - 1
        return np.unique(np.stack([text, item, (at - first[text]) - (spot - self.first[item])], axis=1), axis=0)

    def aligned(self, words: np.ndarray, first: np.ndarray, rows: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        """(text, item, offset, first compared word of the item, equal words) where all equal words on the offset cover the item."""
        text, item, shift = rows.T
        low = np.maximum(0, -shift)
        size = np.minimum(self.lengths[item], np.diff(first)[text] - shift) - low
        ends = np.cumsum(size)
        cut = [0, *np.flatnonzero(np.diff(ends // ALIGNED)).tolist(), len(rows)]
        for a, b in zip(cut, cut[1:], strict=False):
            n = size[a:b]
            if not n.sum():
                continue
            begin = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(begin, n)
            same = words[np.repeat(first[text[a:b]] + shift[a:b] + low[a:b], n) + step] == self.words[np.repeat(self.first[item[a:b]] + low[a:b], n) + step]
            for k in np.flatnonzero(np.add.reduceat(same, begin, dtype=np.int64) >= coverage * self.lengths[item[a:b]]).tolist():
                yield int(text[a + k]), int(item[a + k]), int(shift[a + k]), int(low[a + k]), same[begin[k] : begin[k] + n[k]]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, index entry) of every seed of the texts that an item has too."""
        hashes, places = _seeds(words, first)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size in self.short_sizes:
            h = window_hashes(words, list(range(size)))
            at = np.flatnonzero(text[: len(h)] == text[len(text) - len(h) :]) if len(h) else np.empty(0, np.int64)
            hashes, places = np.concatenate([hashes, h[at]]), np.concatenate([places, at])
        likely = self.bits[(hashes >> np.uint64(42)).astype(np.int64)]
        hashes, places = hashes[likely], places[likely]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        return np.repeat(places, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def grow(same: np.ndarray, at: int, penalty: int = 2, give_up: int = 8) -> tuple[int, int]:
    """The best-scoring stretch of aligned words around ``at``: matches count 1, substitutions -penalty."""

    def reach(line: np.ndarray) -> int:
        score = np.cumsum(np.where(line, 1, -penalty))
        fallen = np.flatnonzero(np.maximum.accumulate(score) - score >= give_up) if len(score) else []
        score = score[: fallen[0]] if len(fallen) else score
        return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0

    return at - reach(same[:at][::-1]), at + reach(same[at:])


def overlaps(index: Index, words: np.ndarray, first: np.ndarray, coverage: float = 0.5) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, matched words, first word, last word) of every text and item with a verified overlap."""
    places, entries = index.hits(words, first)
    rows = index.diagonals(words, first, places, entries)
    if not len(rows):
        return
    item = index.item[entries]
    text = np.searchsorted(first, places, side="right") - 1
    inside = index.places[entries] - index.first[item]
    diagonal = (places - first[text]) - inside
    order = np.lexsort((inside, diagonal, item, text))
    # of hits that follow each other on a diagonal the first grows over the others, all their words being equal
    where = np.stack([text, item, diagonal, inside])[:, order]
    order = order[np.concatenate([[True], (where[:3, 1:] != where[:3, :-1]).any(0) | (where[3, 1:] > where[3, :-1] + 1)])[: len(order)]]
    found: dict[tuple[int, int], list] = {}
    covered: tuple = ()
    for k in order.tolist():
        t, i, d, q = int(text[k]), int(item[k]), int(diagonal[k]), int(inside[k])
        if covered[:3] == (t, i, d) and q < covered[3]:
            continue
        length, n = int(index.lengths[i]), int(first[t + 1] - first[t])
        low, high = max(0, -d), min(length, n - d)
        ours = words[first[t] + d + low : first[t] + d + high]
        same = ours == index.words[index.first[i] + low : index.first[i] + high]
        a, b = grow(same, q - low)
        covered = (t, i, d, max(b + low, q + 1))
        if b > a:
            kept = found.setdefault((t, i), [np.zeros(length, bool), n, 0])
            kept[0][low + a : low + b] |= same[a:b]
            kept[1], kept[2] = min(kept[1], d + low + a), max(kept[2], d + low + b)
    # a copy with many changes: no stretch is long, but the equal words of one offset cover the item
    for t, i, d, low, same in index.aligned(words, first, rows, coverage):
        kept = found.setdefault((t, i), [np.zeros(int(index.lengths[i]), bool), int(first[t + 1] - first[t]), 0])
        at = np.flatnonzero(same) + low
        kept[0][at] = True
        kept[1], kept[2] = min(kept[1], d + int(at[0])), max(kept[2], d + int(at[-1]) + 1)
    for (t, i), (matched, a, b) in found.items():
        yield t, i, int(matched.sum()), a, b


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = 0.5, run: int = 25) -> DataFrame:
    """A row for each contaminated document and item: matched words, coverage and the words' place."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    schema = SCHEMA.format(kind=rows.schema[0].dataType.simpleString(), item=items.schema[0].dataType.simpleString())
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # at most about BLOCK_WORDS words
        held = spark.sparkContext.broadcast(([r.item_id for r in mine], *word_hashes(pa.array([r.text for r in mine], pa.string()), PUNCTUATION)))
        part = map_arrow(rows, _scan(held, coverage, run), schema)
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("doc_id", id_col)


_state: dict = {}


def _scan(held, coverage: float, run: int):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("of") != name:  # built once a worker and block
            _state.update(of=name, index=Index(*held.value))
        index = _state["index"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words, first = word_hashes(part.column(1), PUNCTUATION)
                names = None
                rows = []
                for t, i, matched, a, b in overlaps(index, words, first, coverage):
                    share = matched / int(index.lengths[i])
                    if share >= coverage or matched >= run:
                        names = names or part.column(0).to_pylist()
                        rows.append((names[t], index.ids[i], matched, int(index.lengths[i]), round(share, 6), a, b))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (part.schema[0].type, None, pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    names_ = ("doc_id", "item_id", "matched", "item_words", "coverage", "first_word", "last_word")
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names_))

    return scan
