"""Ranked lexical search by three phases over term-partitioned lists with one threshold for all lists of an item.

The index holds a list for each term: (document, score) by falling score, where the score is the term's whole
contribution to a document. Lists lie side by side in the order of their terms, range-partitioned by term and score,
so a long list is many partitions' work. Every item asks its terms' lists at once, all items together:

1. The heads, ``HEAD`` entries of each list or ``k`` if that is more, give documents partial sums; the ``k``-th
   highest of an item is a lower bound of what its ``k``-th best document scores.
2. A document at that bound or over it holds, in one of the item's ``m`` lists, an entry of at least the bound's
   ``m``-th part. All entries at that threshold or over it are fetched from every list; what a document may still have
   in the other lists is less than the threshold, and no more than the list's head. An entry that several items ask
   for travels once, to the task of its document, where it is added to each item's sum; only sums that, with what may
   be missing, reach the bound leave the task. They give a better bound, which leaves few candidates.
3. The entries of candidates under the threshold are looked up, which makes their scores exact, and the best ``k`` of
   each item are ranked.

Terms are the maximal runs of characters other than ASCII without letters and digits, only A to Z put in lower case.
All counts are of all documents and whole texts. Scores are integers as ``search`` states them, so no order of sums
changes a rank.

Defined results: null and empty texts, and texts without terms, count neither as documents nor as items; equal scores
are ranked by ascending id, null ids last, then by the order of rows; repeated rows and repeated ids rank each as a
document, and repeated item ids each as an item; items whose terms no document holds have no rows; texts of any length
are read whole; empty tables give empty results. Only ids and texts are read, so other columns and their names do not
matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BROADCAST_KEYS, map_arrow, stored

SLICE = 512
HEAD = 64
#: Sums that a task holds at once, and products that it adds to them at once.
CELLS = 4_000_000
#: Terms of items go to every task up to this many and so many bytes; beyond that, all terms of documents are joined.
TERMS_SENT, TERM_BYTES_SENT = 1_000_000, 32 << 20
#: ASCII without letters and digits to blanks, capital letters to small ones.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int] | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """For each row (key, name, text) one row without a term and one for each term that is wanted."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            terms, tf, held, n = [], [], [], []
            for text in part.column(2).to_pylist():
                words = text.translate(_FOLD).split() if text else []
                found = Counter(words if wanted is None else map(wanted.get, words))
                found.pop(None, None)
                terms += [None, *found]
                tf += [0, *found.values()]
                held.append(len(found) + 1)
                n.append(len(words))
            own = np.repeat(np.arange(part.num_rows), held)
            kind = pa.int64() if wanted is not None else pa.binary()
            columns = [part.column(0).take(pa.array(own)), pa.array(terms, kind), pa.array(tf, pa.int64()), pa.array(np.repeat(np.array(n, np.int64), held)), part.column(1).take(pa.array(own))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def counted(df: DataFrame, id_col: str, text_col: str, wanted: dict[bytes, int] | None = None) -> DataFrame:
    """(key, term, tf, n, name): a row of each document's terms with their counts, and one without a term.

    ``n`` counts all terms of the row's text. With ``wanted`` only its terms appear, by their numbers.
    """
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("name"), F.col(text_col).cast("binary").alias("text"))
    sent = None if wanted is None else spark.sparkContext.broadcast(wanted)
    names = ["key", "term", "tf", "n", "name"]
    kind = rows.schema[1].dataType.simpleString()
    return map_arrow(rows, lambda batches: _counted(batches, sent.value if sent else None, names), f"key bigint, term {'bigint' if sent else 'binary'}, tf bigint, n bigint, name {kind}")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast where its counted size is bounded."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def _top(by: str, k: int, *order: Column) -> tuple[Column, Column]:
    """Rank within ``by`` and the condition that keeps the first ``k``: each task passes on ``k`` rows at most."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rank, F.col("rank") <= k


@dataclass(frozen=True)
class Asked:
    """Thresholds of all items by term, for tasks: of term ``terms[t]`` entries ``offsets[t]`` to ``offsets[t + 1]``."""

    terms: np.ndarray
    offsets: np.ndarray
    place: np.ndarray  # of the item in ``items``
    times: np.ndarray
    least: np.ndarray
    missing: np.ndarray
    items: np.ndarray
    bound: np.ndarray  # of each item
    total: np.ndarray  # of what each item's lists may be missing

    @staticmethod
    def of(rows: pa.Table) -> Asked:
        """From (item, term, times, bound, top, least, missing)."""
        column = lambda name, table=rows: table[name].to_numpy()
        items, place = np.unique(column("item"), return_inverse=True)
        bound, total = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        np.maximum.at(bound, place, column("bound"))
        np.add.at(total, place, column("missing"))
        order = np.argsort(column("term"), kind="stable")
        order = order[(column("least") <= column("top"))[order]]
        terms, begins = np.unique(column("term")[order], return_index=True)
        return Asked(terms, np.append(begins, len(order)), place[order], column("times")[order], column("least")[order], column("missing")[order], items, bound, total)

    def sums(self, key: np.ndarray, term: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, key, low, high, bound) of documents' entries, documents whole and side by side."""
        t = np.searchsorted(self.terms, term)
        each = self.offsets[t + 1] - self.offsets[t]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends, work = np.append(begins[1:], len(key)), np.add.reduceat(each, begins).cumsum()
        at = 0
        while at < len(begins):
            stop = int(np.searchsorted(work, (work[at - 1] if at else 0) + CELLS, "right"))
            stop = min(max(stop, at + 1), at + max(1, CELLS // len(self.items)), len(begins))
            own = slice(begins[at], ends[stop - 1])
            n = each[own]
            entry = np.repeat(np.arange(len(n)), n)
            asking = np.arange(len(entry)) + np.repeat(self.offsets[t[own]] - (n.cumsum() - n), n)
            fetched = score[own][entry] >= self.least[asking]
            entry, asking = entry[fetched], asking[fetched]
            doc = np.repeat(np.arange(stop - at), ends[at:stop] - begins[at:stop])
            cell = doc[entry] * len(self.items) + self.place[asking]
            low, seen = np.zeros((stop - at) * len(self.items), np.int64), np.zeros((stop - at) * len(self.items), np.int64)
            np.add.at(low, cell, self.times[asking] * score[own][entry])
            np.add.at(seen, cell, self.missing[asking])
            hit = np.flatnonzero(low)
            item = hit % len(self.items)
            high = low[hit] + self.total[item] - seen[hit]
            good = high >= self.bound[item]
            hit, item = hit[good], item[good]
            yield self.items[item], key[begins[at:stop]][hit // len(self.items)], low[hit], high[good], self.bound[item]
            at = stop


def _reaching(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """(item, key, low, high, bound) from rows (key, term, score) sorted by key: what may reach its item's bound."""
    held = [np.empty(0, np.int64)] * 3

    def made(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found in asked.sums(*rows) if len(rows[0]) else ():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["item", "key", "low", "high", "bound"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held)]
        whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last document may go on
        yield from made([r[:whole] for r in rows])
        held = [r[whole:] for r in rows]
    yield from made(held)


class Index:
    """Lists of the terms that a set of items asks for, over all documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame, terms: DataFrame, id_col: str, text_col: str):
        """``terms`` is (word, term): distinct words and their numbers."""
        size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
        self.n_terms = size.n
        if size.n <= TERMS_SENT and size.bytes <= TERM_BYTES_SENT:
            wanted = {bytes(r.word): r.term for r in terms.collect()}
            raw = stored(counted(docs, id_col, text_col, wanted), "counted")
        else:
            raw = counted(docs, id_col, text_col).withColumnRenamed("term", "word")
            raw = stored(raw.join(terms, "word", "left").where("word is null or term is not null").drop("word"), "counted")
        per_doc, entries = raw.where("term is null"), raw.where("term is not null")
        total = per_doc.where("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.names = per_doc.select("key", "name")
        lists = entries.groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(total.n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weights = stored(lists.select("term", weight.cast("bigint").alias("w")), "weights")
        m = f"(100 - 75 + ((75 * n * {total.n}L) div {max(1, total.terms)}L))"
        score = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 8 * {m}))")
        scored = entries.join(_small(weights, self.n_terms), "term").select("term", score.alias("score"), "key").where("score > 0")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["term", F.desc("score"), "key"]
        self.lists = stored(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order), "lists")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, document, score): for each item its ``k`` best documents with a score over 0.

    Of N documents with terms, L terms in all and n in a document, a term in df of them weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))) and adds w ((10^9 tf) div (1000 tf + 8 (25 + (75nN) div L))) for each
    time the item holds it.
    """
    spark = docs.sparkSession
    asked = stored(counted(items, item_col, text_col).select(F.col("key").alias("item"), F.col("name").alias("item_name"), F.col("term").alias("word"), F.col("tf").alias("times")), "asked")
    words = asked.where("word is not null").select("word").distinct()
    terms = stored(words.withColumn("term", F.monotonically_increasing_id()), "terms")
    index = Index(spark, docs, terms, id_col, text_col)
    asked_terms = stored(asked.join(_small(terms, index.n_terms), "word").select("item", "term", "times"), "asked_terms")
    n_asked = asked_terms.count()

    # 1. heads of the lists, and the bound that their sums give
    rank, first = _top("term", max(k, HEAD), F.desc("score"), F.asc("key"))
    heads = stored(index.lists.withColumn("rank", rank).where(first), "heads")
    sums = heads.join(_small(asked_terms, n_asked), "term").groupBy("item", "key").agg(F.sum(F.col("times") * F.col("score")).alias("low"))
    rank, first = _top("item", k, F.desc("low"))
    bounds = sums.withColumn("rank", rank).where(first).where(F.col("rank") == k).select("item", F.col("low").alias("bound"))
    tops = heads.where("rank = 1").select("term", F.col("score").alias("top"))
    lists = asked_terms.join(tops, "term")
    sizes = lists.groupBy("item").agg(F.count("*").alias("m"))
    lists = lists.join(sizes, "item").join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0).cast("bigint")))
    lists = lists.withColumn("least", F.expr("greatest(1L, (bound + m * times - 1) div (m * times))"))
    lists = stored(lists.select("item", "term", "times", "bound", "top", "least", (F.col("times") * F.least(F.col("least") - 1, "top")).alias("missing")), "thresholds")
    n_lists = lists.count()

    # 2. all entries at the threshold or over it; documents that may still reach the bound
    asking = lists.where("least <= top").select("term", "item", "times", "least", "missing")
    floor = asking.groupBy("term").agg(F.min("least").alias("floor"))
    wanted = index.lists.join(_small(floor, index.n_terms), "term").where("score >= floor").select("key", "term", "score")
    wanted = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    if n_lists <= BROADCAST_KEYS:
        sent = spark.sparkContext.broadcast(Asked.of(lists.toArrow()))
        seen = map_arrow(wanted.sortWithinPartitions("key"), lambda batches: _reaching(batches, sent.value), "item bigint, key bigint, low bigint, high bigint, bound bigint")
    else:
        sums = wanted.join(asking, "term").where("score >= least").groupBy("item", "key").agg(F.sum(F.col("times") * F.col("score")).alias("low"), F.sum("missing").alias("seen"))
        may = lists.groupBy("item").agg(F.max("bound").alias("bound"), F.sum("missing").alias("missing"))
        seen = sums.join(may, "item").select("item", "key", "low", (F.col("low") + F.col("missing") - F.col("seen")).alias("high"), "bound").where("high >= bound")
    seen = stored(seen, "seen")
    rank, first = _top("item", k, F.desc("low"))
    better = seen.withColumn("rank", rank).where(first).where(F.col("rank") == k).select("item", F.col("low").alias("better"))
    candidates = stored(seen.join(_small(better, n_lists), "item", "left").where("high >= coalesce(better, 0)").select("item", "key", "low", "high"), "candidates")

    # 3. what candidates have under the threshold; one whose sum is complete needs no look-up
    open_ = candidates.where("high > low")
    below = index.lists.join(_small(open_.select("item", "key"), open_.count()), "key").join(_small(lists.select("item", "term", "times", "least"), n_lists), ["item", "term"]).where("score < least")
    rest = below.groupBy("item", "key").agg(F.sum(F.col("times") * F.col("score")).alias("rest"))
    exact = candidates.join(rest, ["item", "key"], "left").select("item", "key", (F.col("low") + F.coalesce("rest", F.lit(0))).alias("score"))
    exact = exact.join(index.names, "key")
    rank, first = _top("item", k, F.desc("score"), F.asc_nulls_last("name"), F.asc("key"))
    best = exact.withColumn("rank", rank).where(first)
    found = best.join(asked.where("word is null").select("item", "item_name"), "item")
    return found.select(F.col("item_name").alias(item_col), "rank", F.col("name").alias(id_col), "score")
