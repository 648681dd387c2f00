"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank vocabulary.

The vocabulary (bytes -> rank) becomes a sentencepiece BPE model without any training: piece ``i`` is the
byte-mapped string of rank ``i`` with score ``-i``, the normaliser is the identity, so sentencepiece merges
exactly the pair whose union has the lowest rank, leftmost first. Texts are cut into pre-tokens by the
vocabulary's pattern and each is encoded alone; decoding maps ids to their bytes again.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are kept one for one,
repeated or with null ids, and other columns are not read. Texts of any length are encoded whole; memory is
bounded by one slice of an Arrow batch and a cache of ``CACHE`` entries per worker, emptied when full.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.shared import map_arrow

CACHE = 200_000
SLICE = 256
_state: dict = {}


def byte_alphabet() -> list[str]:
    """A printable character for every byte: itself where printable, else the next code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id of every token is its rank."""
    from sentencepiece import sentencepiece_model_pb2 as spm

    alphabet = byte_alphabet()
    model = spm.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(alphabet[b] for b in token), -float(rank), 1
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, 2
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = 2, len(tokens) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary inside a task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = pa.array(tokens, pa.binary())
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        # white space as the pattern's own engine has it: the Unicode property, without U+001C to U+001F
        self.pretoken = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # no pre-token reaches over a single space between two others, so texts can be looked up in such parts
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.table = dict(enumerate(byte_alphabet()))
        # parts and pre-tokens seen lately, each in two generations: what is still in use outlives a full one
        self.parts: list[dict[str, bytes]] = [{}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each pre-token; those not seen lately are encoded by one call."""
        new, old = self.words
        found = {w: new.get(w) or old.get(w) for w in words}
        fresh = [w for w, ids in found.items() if ids is None]
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in fresh]
        for word, ids in zip(fresh, self.piece.encode(mapped, num_threads=1) if fresh else [], strict=True):
            found[word] = array("i", ids).tobytes()
        if len(new) > CACHE:
            self.words = [{}, new]
        self.words[0].update((w, ids) for w, ids in found.items() if len(w) < 64)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        if len(self.parts[0]) > CACHE:
            self.parts = [{}, self.parts[0]]
        new, old = self.parts
        cut, holes, missing = [], [], {}
        for text in texts:
            # a part after the first is looked up without the space that it begins with
            head, *rest = self.cut.split(text) if text else ("",)
            found = list(map(new.get, rest))
            cut.append((head, found))
            missing["\0" + head] = self.pretoken.findall(head)
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        part = rest[k]
                        ids = new.get(part) or old.get(part)
                        if ids is not None:
                            found[k] = new[part] = ids
                        else:
                            holes.append((found, k, part))
                            if part not in missing:
                                missing[part] = self.pretoken.findall(" " + part)
        words = self._learn_words({w for ws in missing.values() for w in ws})
        made = {part: b"".join([words[w] for w in ws]) for part, ws in missing.items()}
        new.update((part, ids) for part, ids in made.items() if len(part) < 64 and part[0] != "\0")
        for found, k, part in holes:
            found[k] = made[part]
        return [made["\0" + head] + b"".join(found) for head, found in cut]

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids, taken from the vocabulary's one buffer; null lists have none."""
        lists = lists.fill_null([]) if lists.null_count else lists
        ends = lists.offsets.to_numpy()
        pieces = self.tokens.take(lists.flatten())
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(bounds[ends - ends[0]])), pieces.buffers()[2] if len(pieces) else pa.py_buffer(b"")])


def _codec(key: str, tokens: list[bytes], model: bytes, pattern: str) -> Codec:
    if _state.get("key") != key:
        _state.update(key=key, codec=Codec(tokens, model, pattern))
    return _state["codec"]


def codec_for(spark, path: str, pattern: str) -> Callable[[], Codec]:
    """Broadcasts the vocabulary (fixed size, it does not grow with the data) and makes the codec per worker."""
    tokens = read_ranks(path)
    held = spark.sparkContext.broadcast((tokens, build_model(tokens), pattern))
    return lambda: _codec(f"{path}|{pattern}", *held.value)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(df: DataFrame, codec: Callable[[], Codec], id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded binary]) of every row; ``decoded`` is decoded from the ids in the same stage."""
    rows = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = _lists(one.encode(part.column(1).to_pylist()))
                columns = [part.column(0), ids] + ([one.decode(ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids"] + ["decoded"] * decoded)

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(df: DataFrame, codec: Callable[[], Codec], id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary) from rows with ``ids``; null ids decode to no bytes."""
    rows = df.select(id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), one.decode(part.column(1))], names=[id_col, "ids", "decoded"])

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
