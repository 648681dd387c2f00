"""Text features: hashed n-grams, pattern flags, phrase scoring and keeping the best copy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import map_arrow, written

#: Tokens whose hash a worker remembers before it begins anew.
REMEMBERED = 1_000_000
_WORDS = re.compile("[a-z0-9']+")

#: Fixed patterns of scam language: (flag, ASCII pattern).
FLAGS = (
    ("urgency", r"\b(urgent|immediately|right now|asap|act now|expire[sd]?|within [0-9]+ (?:min|minute|hour)s?|last chance|final (?:notice|warning))\b"),
    ("safe_account", r"\b(safe account|secure account|holding account|move your (?:money|funds)|transfer (?:your )?(?:money|funds|balance))\b"),
    ("authority", r"\b(hmrc|police|fraud team|bank security|government|nat(?:ional)? insurance|investigation|warrant|arrest)\b"),
    ("pressure", r"\b(do not tell|don'?t tell|keep this (?:secret|confidential)|verify (?:your )?(?:identity|account|details)|confirm your (?:pin|password|otp|code))\b"),
    ("sort_code", r"\b[0-9]{2}[-\s\x{a0}]?[0-9]{2}[-\s\x{a0}]?[0-9]{2}\b"),
    ("account_number", r"\b[0-9]{8}\b"),
    ("money", r"[£$€][\s\x{a0}]?[0-9][0-9,]*(?:\.[0-9]{2})?"),
    ("link", r"(https?://|www\.|\bbit\.ly\b|\.co\b|click (?:here|this))"),
    ("crypto", r"\b(bitcoin|btc|crypto|usdt|wallet|gift ?card)\b"),
)


def strip_html(html: Column) -> Column:
    """Tags become spaces; three entities are undone; runs of white space become one space."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    text = F.replace(F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words, word pairs joined by an underscore, and letter triples of the text without spaces."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    dense = F.replace(low, F.lit(" "), F.lit(""))
    triples = F.regexp_extract_all(dense, F.lit("(?s)(?=(.{3}))."), F.lit(1))  # one pass, overlapping; a character outside the BMP is one
    return F.concat(_marked("w:", words), _marked("b:", pairs), _marked("c:", triples))


def _marked(kind: str, found: Column) -> Column:
    return F.transform(found, lambda t: F.concat(F.lit(kind), t))


def _triples(low: str) -> np.ndarray:
    """The letter triples of a lower-case text without its spaces, three code points in one number."""
    points = np.frombuffer(low.replace(" ", "").encode("utf-32-le"), np.uint32).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def _counted(low: str) -> dict[str, dict]:
    """How often a lower-case text has each word, word pair (a tuple) and letter triple (a number)."""
    words = _WORDS.findall(low)
    triples = np.unique(_triples(low), return_counts=True)
    return {"w": Counter(words), "b": Counter(pairwise(words)), "c": dict(zip(*(t.tolist() for t in triples), strict=True))}


def _sizes(low: str) -> list[list[int]]:
    """How many words, pairs and triples a lower-case text has, and how many of each differ."""
    words, triples = _WORDS.findall(low), _triples(low)
    return [[len(words), len(set(words))], [max(0, len(words) - 1), len(set(pairwise(words)))], [len(triples), len(np.unique(triples))]]


def _spelled(key: str | tuple | int) -> str:
    """The token of a key of ``_counted``, as ``tokens`` marks it."""
    if isinstance(key, str):
        return "w:" + key
    if isinstance(key, tuple):
        return "b:" + "_".join(key)
    return "c:" + "".join(chr(key >> at & 0x1FFFFF) for at in (42, 21, 0))


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, n, n_distinct): the words, pairs and triples of each key, and how many differ.

    A text is counted where it is read, one at a time: a task holds the tokens of one text. Keys of several rows, if
    there are any, are counted token by token instead; only then is ``df`` read again.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_sizes(low.as_py() or "") for low in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.list_(pa.list_(pa.int64())))], names=[key, "sizes"])

    single = map_arrow(df.select(key, F.lower(F.col(text)).alias("low")), run, f"`{key}` {kind}, sizes array<array<bigint>>")
    held = written(single.groupBy(key).agg(F.count("*").alias("rows"), F.first("sizes").alias("sizes")), "token_sizes")
    each = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in "wbc")).alias("kind"), F.col("sizes").alias("size"))).alias("t")
    once = held.where("rows = 1").select(key, each).select(key, "t.kind", F.col("t.size")[0].alias("n"), F.col("t.size")[1].alias("n_distinct")).where("n > 0")
    several = held.where("rows > 1").select(F.col(key).alias("_key"))
    if not several.limit(1).count():
        return once
    again = df.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, F.explode(tokens(F.col(text))).alias("token"))
    return once.union(again.groupBy(key, F.substring("token", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct")))


def _sums(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(key, totals, size): the signed sums of the buckets of each key, null where no token falls, and their norm.

    A text is counted where it is read, and a token is hashed once for all texts in which a task meets it soon.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out = []
            for low in batch.column(1).to_pylist():
                totals: list = [None] * buckets
                for counts in _counted(low or "").values():
                    for token, n in counts.items():
                        place = known.get(token)
                        if place is None:
                            h = int.from_bytes(md5(_spelled(token).encode(), usedforsecurity=False).digest()[:8], "big")
                            place = known[token] = (h % buckets, 1 if h & 2 else -1)
                        totals[place[0]] = (totals[place[0]] or 0) + place[1] * n
                out.append(totals)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[key, "totals"])

    rows = map_arrow(df.select(key, F.lower(F.col(text)).alias("low")), run, f"`{key}` {kind}, totals array<bigint>")
    sums = rows.groupBy(key).agg(F.array(*(F.sum(F.get("totals", F.lit(i))) for i in range(buckets))).alias("totals"))
    return sums.withColumn("size", F.sqrt(F.aggregate("totals", F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(t * t, F.lit(0)))))


def _unit(total: Column, cancelled: float) -> Column:
    return F.when(F.col("size") > 0, total / F.col("size")).when(total.isNotNull(), cancelled)


def hashed(df: DataFrame, key: str, text: str, buckets: int = 23, cancelled: float = 0.0) -> DataFrame:
    """(key, bucket, value): the signed hashing trick, scaled to unit length by document; ``cancelled`` where all sums are 0."""
    rows = _sums(df, key, text, buckets).select(key, "size", F.posexplode("totals").alias("bucket", "total"))
    return rows.where("total is not null").select(key, "bucket", _unit(F.col("total"), cancelled).alias("value"))


def flags(text: Column) -> list[Column]:
    """One 0/1 column for each pattern."""
    low = F.coalesce(text, F.lit(""))
    return [low.rlike("(?i)" + pattern).cast("int").alias(name) for name, pattern in FLAGS]


def phrase_score(df: DataFrame, text: Column, core: list[str], themes: dict[str, tuple[float, list[str]]]) -> DataFrame:
    """Adds score, themes and phrases: a text without a core term scores 0, each theme its weight plus 0.25 a further hit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = df.withColumn("_low", low)
    low = F.col("_low")
    gate = F.lit(True)
    if core:
        gate = F.lit(False)
        for term in core:
            gate = gate | F.contains(low, F.lit(term))
    hits = {name: F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p)) for name, (_, phrases) in themes.items()}
    total = F.lit(0.0)
    for name, (weight, _) in themes.items():
        total = total + F.when(F.size(hits[name]) > 0, weight + 0.25 * (F.size(hits[name]) - 1)).otherwise(0.0)
    named = F.filter(F.array(*(F.when(F.size(h) > 0, F.lit(n)) for n, h in hits.items())), lambda x: x.isNotNull())
    found = F.sort_array(F.array_distinct(F.flatten(F.array(*hits.values()))))
    return rows.withColumns({"score": F.when(gate, F.bround(total, 2)).otherwise(0.0), "themes": F.when(gate, F.concat_ws(",", named)).otherwise(""), "phrases": F.when(gate, F.concat_ws(",", found)).otherwise("")}).drop("_low")


def best_per_key(df: DataFrame, key: Column, score: str, arrival: str) -> DataFrame:
    """The row of highest score of each key, the first to arrive at a tie."""
    w = Window.partitionBy("_key").orderBy(F.desc(score), arrival)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_key", "_r")


def dedupe_key(url: Column, source: Column, title: Column) -> Column:
    """What tells evidence apart: the address, or the source and title where there is none, in lower case."""
    plain = F.coalesce(F.nullif(url, F.lit("")), F.concat(source, F.lit(":"), title))
    return F.sha1(F.lower(F.trim(plain)).cast("binary"))


def relevant(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words; without words every text is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w)) if words else F.lit(True)


def feature_row(df: DataFrame, key: str, text: str, buckets: int = 23, cancelled: float = 0.0) -> DataFrame:
    """(key, x): the pattern flags and the hashed buckets of each text in one array; null is an empty text."""
    base = df.select(key, F.array(*(f.cast("double") for f in flags(F.col(text)))).alias("_flags"))
    sums = _sums(df, key, text, buckets).select(key, F.transform("totals", lambda t: F.coalesce(_unit(t, cancelled), F.lit(0.0))).alias("_x"))
    empty = F.array_repeat(F.lit(0.0), F.lit(buckets))
    return base.join(sums, key, "left").select(key, F.concat("_flags", F.coalesce("_x", empty)).alias("x"))
