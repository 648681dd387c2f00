"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language's dictionary is raw text of that language. A text is put in lower case and written out as its
bytes, each followed by a hash of it and the two before (so that a shared run of letters outweighs
zstandard's fixed cost of a match), and cut into windows; every window is compressed with each dictionary
and the language with the fewest bytes over all windows wins, at a tie the one with more labelled rows. The
margin is how much shorter the winner is than the runner-up; narrow margins are rejected (``rejected``).

Fitting uses a bounded sample: the ``docs_per_lang`` labelled rows of each language with the lowest hash of
their id, at most ``dict_bytes`` of text for a dictionary; half as many others calibrate the score. Rows are chosen, so
an id of many rows does not bring them all, and equal rows count once; more than ``max_langs`` languages are an error.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and rejected; rows are kept
one for one, and with no labelled language at all every text is ``und``. Texts are scored whole, of any length; an
empty table gives an empty result; only the columns named are read, so others and their names do not matter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import bounded_sample, map_arrow

WINDOW = 1024
SLICE = 512
_state: dict = {}


def spread(text: str) -> bytes:
    """The lower-case text's bytes, each with a hash of it and the two before."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    h = data * np.uint32(0x9E3779B1)
    h[1:] += data[:-1] * np.uint32(0x85EBCA77)
    h[2:] += data[:-2] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.stack([data.astype(np.uint8), (h ^ (h >> np.uint32(12))).astype(np.uint8)], axis=1).tobytes()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 240, dict_bytes: int = 131_072, max_langs: int = 200) -> dict:
    """Dictionaries and score scale from rows with a language; the sample's bound is documented above."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}  # a row for each language
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    sample = bounded_sample(rows, "lang", docs_per_lang, 20_000).select("id", "lang", "text").collect()
    by: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r.lang, str(r.id), r.text)):
        by.setdefault(row.lang, []).append(row.text)
    dictionaries, held = {}, []
    for lang, texts in by.items():
        own = texts[0::3] + texts[1::3]
        share = max(1, dict_bytes // max(1, len(own)))
        dictionaries[lang] = b"".join(spread(t[:share]) for t in own)[-dict_bytes:]
        held += [(lang, t) for t in texts[2::3]]
    model = {"dictionaries": dictionaries, "scale": 60.0, "margin": 0.005, "sizes": sizes, "name": uuid.uuid4().hex}
    judge = Judge(model)
    right = sorted(m for lang, t in held for best, m, _ in [judge.judge(t)] if best == lang)
    if right:  # half of the rightly judged texts score over 0.95
        model["scale"] = min(1000.0, 3.0 / max(right[len(right) // 2], 1e-3))
    return model


class Judge:
    """Dictionaries made ready for compression in a worker."""

    def __init__(self, model: dict):
        import zstandard as zs

        self.model, self.by = model, []
        options = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_FAST, min_match=6, window_log=18, hash_log=17, chain_log=17, search_log=2, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang, content in sorted(model["dictionaries"].items()):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            self.by.append((-model["sizes"][lang], lang, zs.ZstdCompressor(compression_params=options, dict_data=held)))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, margin, score)"""
        if not self.by or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = spread(text)
        windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
        sizes = sorted((sum(len(c.compress(w)) for w in windows), rank, lang) for rank, lang, c in self.by)
        margin = 1.0 if len(sizes) < 2 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][2], margin, 1 / (1 + math.exp(-min(30.0, margin * self.model["scale"])))


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row."""
    rows = df.select(id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages times dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("name") != held.value["name"]:
            _state.update(name=held.value["name"], judge=Judge(held.value))
        judge, narrow = _state["judge"], held.value["margin"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [judge.judge(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == "und" or f[1] < narrow for f in found], pa.bool_())],
                    names=[id_col, "lang_pred", "score", "margin", "rejected"],
                )

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean")
