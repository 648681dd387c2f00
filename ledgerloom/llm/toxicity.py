"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is one word, longer runs cut at ``LONGEST`` characters. It is written out as its bytes, each followed by
two bytes that hash it with the two before, so that text seen in a dictionary saves far more than zstandard's fixed
cost of a match, and parts of a word (prefixes, syllables) save in proportion. The gain of a window is its compressed
length with the ordinary dictionary less that with the toxic one. A document's score is a logistic function,
calibrated on labelled texts, of the shares of its windows whose gain passes each threshold and of its largest gain.

Dictionaries are trained by compression alone, no words are counted. Labelled texts are split in two folds. Of each
fold ``pairs`` pairs of small dictionaries are made, one of random toxic passages and one of as much ordinary text;
the windows of the other fold's texts are compressed with all of them. Text that toxic passages have more often
than ordinary ones gains on average, whatever single passages happen to hold. The toxic dictionary is the toxic
windows with a mean gain of ``least_gain`` bytes or more, those of most gain last, where matches cost least; the ordinary
dictionary is the ordinary windows that gain nothing. This is done for two halves of the labelled texts; each
half's dictionaries are calibrated on the other half, and a score is the logistic of the mean of the two logits.

Fitting uses a bounded sample, at most ``rows_per_class`` labelled rows of each class, those with the lowest hash of
their id, and ``SAMPLE_CHARS`` characters of each, in one task; the driver gets the dictionaries only.

Defined results: null and empty texts have no windows and get the score of the model for none; without rows
of both classes every score is 0; labels other than 0 and 1 are not learned from. Rows are kept one for one, repeated
rows get equal scores, other columns are not read; texts are scored whole.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import bounded_sample, map_arrow, stored

CACHE = 300_000
#: Words remembered in each of two generations; their gains are shared tuples, some 150 bytes a word in all.
WORDS = 600_000
SLICE = 256
LONGEST = 48
SAMPLE_CHARS = 20_000
THRESHOLDS = (3, 5, 7, 9, 12, 15, 18)
_WORD = re.compile(r"[^\W_]+")
_state: dict = {}


def windows(text: str | None) -> list[str]:
    """The words of a text in lower case; longer runs are cut so that nothing is left out."""
    found = _WORD.findall(text.lower()) if text else []
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)] if any(len(w) > LONGEST for w in found) else found


class _Spread(dict):
    """What each byte becomes after the two before it."""

    def __missing__(self, three: bytes) -> bytes:
        before, last, c = three
        h = (c * 0x9E3779B1 + last * 0x85EBCA77 + before * 0xC2B2AE3D) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        self[three] = made = bytes((c, (h ^ (h >> 12)) & 255, (h >> 20) & 255))
        return made


_SPREAD = _Spread()


def spread(word: str) -> bytes:
    """The window's bytes between blanks, each with two bytes that depend on it and the two before."""
    if len(_SPREAD) > CACHE:
        _SPREAD.clear()
    data = f"\0\0 {word} ".encode()
    return b"".join([_SPREAD[data[i : i + 3]] for i in range(len(data) - 2)])


def _lengths(dictionary: bytes):
    """A function from the bytes of a window to its compressed length with ``dictionary``."""
    import zstandard as zs

    options = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_BTLAZY2, min_match=3, window_log=max(17, len(dictionary).bit_length()), hash_log=17, chain_log=18, search_log=7, target_length=64,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
    compress = zs.ZstdCompressor(dict_data=held, compression_params=options).compress
    return lambda data: len(compress(data))


class Gains:
    """Compression gains of windows with the dictionaries of every part of a model, remembered by word."""

    def __init__(self, parts: list[tuple[bytes, bytes]]):
        self.parts = [(_lengths(ordinary), _lengths(toxic)) for ordinary, toxic in parts]
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.shared: dict[tuple[int, ...], tuple[int, ...]] = {}

    def counts(self, text: str | None) -> Counter:
        """How many windows of a text have each tuple of gains."""
        if len(self.known) > WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        words = windows(text)
        gains = list(map(known.get, words))
        if None in gains:
            for k, gain in enumerate(gains):
                if gain is None:
                    word = words[k]
                    gain = known.get(word) or before.get(word)
                    if gain is None:
                        data = spread(word)
                        gain = tuple([ordinary(data) - toxic(data) for ordinary, toxic in self.parts])
                        gain = self.shared.setdefault(gain, gain)
                    gains[k] = known[word] = gain
        return Counter(gains)


def _features(counts: Counter, part: int) -> list[float]:
    """What a document's score is made of: its largest and mean gain, and windows over each threshold."""
    n = max(1, sum(counts.values()))
    gains: Counter = Counter()
    for gain, k in counts.items():
        gains[gain[part]] += k
    over = [sum(k for g, k in gains.items() if g >= t) for t in THRESHOLDS]
    return [max(max(gains, default=0), 0) / 5, sum(g * k for g, k in gains.items()) / n] + [math.sqrt(k / n) * 10 for k in over] + [math.log1p(k) for k in over]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with the bias last, by Newton steps, and the columns' means and spreads."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hess, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, std


def _passages(texts: list[str], size: int, rng: np.random.Generator, chars: int = 400) -> bytes:
    """Random passages of random texts, spread, of ``size`` bytes."""
    out, n = [], 0
    order = rng.permutation(len(texts))
    for turn in range(4 * size // chars if texts else 0):
        text = texts[order[turn % len(order)]]
        at = int(rng.integers(0, max(1, len(text) - chars) + 1))
        out.append(b"".join(map(spread, windows(text[at : at + chars]))))
        n += len(out[-1])
        if n >= size:
            break
    return b"".join(out)[:size]


def _halves(texts: list[str]) -> tuple[list[str], list[str]]:
    return (texts[0::2], texts[1::2]) if len(texts) > 1 else (texts, texts)


def train(ordinary: list[str], toxic: list[str], rng: np.random.Generator, pairs: int, small: int, least_gain: float, size: int) -> tuple[bytes, bytes]:
    """An ordinary and a toxic dictionary of at most ``size`` bytes each from labelled texts."""
    plain: list[bytes] = []
    marked: list[tuple[float, bytes]] = []
    folds = list(zip(_halves(ordinary), _halves(toxic), strict=True))
    for (mine_o, mine_t), (other_o, other_t) in (folds, folds[::-1]):
        trials = Gains([(_passages(other_o, small, rng), _passages(other_t, small, rng)) for _ in range(pairs)])

        def mean_gains(texts: list[str], trials: Gains = trials) -> Iterator[tuple[float, str]]:
            for text in texts:
                for word in dict.fromkeys(windows(text)):
                    trials.counts(word)
                    gains = trials.known[word]
                    yield sum(gains) / len(gains), word

        marked += [(gain, spread(word)) for gain, word in mean_gains(mine_t) if gain >= least_gain]
        several = [mine_o[i] for i in rng.permutation(len(mine_o))[: max(20, len(mine_t))]]
        plain += [spread(word) for gain, word in mean_gains(several) if gain <= 0]
    marked.sort(key=lambda x: x[0])
    return b"".join([plain[i] for i in rng.permutation(len(plain))])[-size:], b"".join([w for _, w in marked])[-size:]


def _fit(rows: list[tuple[str, int]], pairs: int, small: int, least_gain: float, size: int) -> dict:
    rng = np.random.default_rng(7)
    texts = sorted(set(rows))
    by_label = [[t for t, y in texts if y == label] for label in (0, 1)]
    halves = [_halves([own[i] for i in rng.permutation(len(own))]) for own in by_label]
    model: dict = {"name": uuid.uuid4().hex, "dictionaries": [], "weights": []}
    for k in (0, 1):
        pair = train(halves[0][k], halves[1][k], rng, pairs, small, least_gain, size)
        unseen = [(t, label) for label in (0, 1) for t in halves[label][1 - k]]
        gains = Gains([pair])
        x = np.array([_features(gains.counts(t), 0) for t, _ in unseen])
        model["dictionaries"].append(pair)
        model["weights"].append(_logistic(x, np.array([y for _, y in unseen], float)))
    return model


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 800, pairs: int = 16, small: int = 36_000, least_gain: float = 5.0, size: int = 393_216
) -> dict:
    """The model from rows with a label of 0 or 1."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and text is not null")
    sample = stored(bounded_sample(rows, "label", rows_per_class, SAMPLE_CHARS).select("text", "label"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if len({y for _, y in found}) == 2:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(_fit(found, pairs, small, least_gain, size))]})

    made = map_arrow(sample.repartition(1), run, "model binary").first()
    return pickle.loads(made[0]) if made else {"weights": None}  # noqa: S301 (made by the line above)


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    rows = df.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    if model["weights"] is None:
        return rows.select(id_col, F.lit(0.0).alias("score"))
    held = df.sparkSession.sparkContext.broadcast(model)  # four dictionaries of at most ``size`` bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        if _state.get("name") != m["name"]:
            _state.update(name=m["name"], gains=Gains(m["dictionaries"]))
        gains = _state["gains"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts = [gains.counts(t) for t in part.column(1).to_pylist()]
                z = 0.0
                for k, (w, mean, std) in enumerate(m["weights"]):
                    x = np.array([_features(c, k) for c in counts])
                    z = z + np.clip((x - mean) / std @ w[:-1] + w[-1], -30, 30) / len(m["weights"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], names=[id_col, "score"])

    return map_arrow(rows, run, f"`{id_col}` {kind}, score double")
