"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

File format of part ``p``: ``part-p.bin`` holds the ids of its documents one after another as little-endian
unsigned integers (16 bits while the vocabulary allows it, else 32); ``part-p.idx`` holds, as little-endian
64-bit integers, the documents' ids and then n + 1 offsets into the part. The manifest has a row for each
part; a part's base, the number of ids in all parts before it, is the prefix sum of the parts' counts, so no
task needs another's output. Documents are in ascending order of id over all parts (nulls first, kept apart
by a null mask of id minus 2^63); ties are ordered by text.

Defined results: null and empty texts hold only the end id; repeated rows are all written. A part is written
under a name of its own attempt and then moved, so a lost executor or a repeated task leaves whole files.
The folder must be one that driver and executors share; any store with a pyarrow file system will do, and
parts in a local file system are memory-mapped.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import byte_alphabet
from ledgerloom.llm.shared import fresh_path, map_arrow

CACHE = 250_000
SLICE = 512
NULL_ID = -(2**63)
MANIFEST = "part int, n_docs bigint, n_tokens bigint, width int, folder string"
#: Composed Latin letters whose lower case is one letter (U+0130 has two), and ASCII punctuation after them.
_PLAIN = re.compile(r"((?:(?![\u0130×÷])[a-zA-Z\u00c0-\u024f])+)([!-&(-/:;=-@\[-`{-~]*)")
_state: dict = {}


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file whose pre-tokeniser never joins text over white space.

    Texts are cut at plain spaces and line ends and each word is encoded by the library once; words are then looked up.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if dtype == "<u2" else "I"  # arrays of machine integers; executors are little-endian
        self.table = dict(enumerate(byte_alphabet()))
        # words seen lately in two generations: what is still in use outlives a full one
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _library(self, words: list[str]) -> list[bytes]:
        return [array(self.code, made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Ids of words: Latin letters are one pre-token in lower case and go to the library's model at once."""
        known, before, tokenize = self.known, self.before, self.tokenizer.model.tokenize
        others = []
        for word in words:
            ids = before.get(word)
            if ids is None:
                plain = _PLAIN.fullmatch(word)
                if plain is None:
                    others.append(word)
                    continue
                core, tail = plain.groups()
                core = core.lower()
                ids = known.get(core)
                if ids is None:
                    mapped = core if core.isascii() else core.encode().decode("latin-1").translate(self.table)
                    ids = known[core] = array(self.code, [t.id for t in tokenize(mapped)]).tobytes()
                if tail:
                    if tail not in known:
                        known[tail] = self._library([tail])[0]
                    ids += known[tail]
            known[word] = ids
        known.update(zip(others, self._library(others), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        known = self.known
        # a line end is white space to the library as a blank is, and no special token holds either
        words = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        found = [list(map(known.get, ws)) for ws in words]
        holes = [k for k, ids in enumerate(found) if None in ids]
        fresh = {w for k in holes for w, ids in zip(words[k], found[k], strict=True) if ids is None}
        self._learn(fresh)
        for k in holes:
            found[k] = list(map(known.get, words[k]))
        for word in fresh:
            if len(word) > 64:
                known.pop(word, None)
        return list(map(b"".join, found))


def _encoder(path: str, dtype: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if _state.get("key") != (path, dtype):
        _state.update(key=(path, dtype), encoder=WordEncoder(path, dtype))
    return _state["encoder"]


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(df: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every row and write the parts; returns the manifest with ``base`` for each part."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    dtype = "<u2" if vocabulary <= 2**16 else "<u4"
    width = np.dtype(dtype).itemsize
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, (store, root) = _encoder(tokenizer_path, dtype), _place(folder)
        store.create_dir(root, recursive=True)
        end = np.array([end_id], dtype).tobytes()
        mine = f"{root}/.{part}-{uuid.uuid4().hex}"
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        with store.open_output_stream(f"{mine}.bin") as out:
            for batch in batches:
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                for at in range(0, batch.num_rows, SLICE):
                    made = encoder.encode(batch.column(1).slice(at, SLICE).to_pylist())
                    counts.append(np.array([len(x) // width + 1 for x in made], np.int64))
                    out.write(b"".join([y for x in made for y in (x, end)]))
        docs = np.concatenate(ids) if ids else np.empty(0, np.int64)
        offsets = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum()
        with store.open_output_stream(f"{mine}.idx") as out:
            out.write(docs.astype("<i8").tobytes() + offsets.astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            store.move(f"{mine}.{kind}", f"{root}/part-{part:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(docs)], "n_tokens": [int(offsets[-1])], "width": pa.array([width], pa.int32()), "folder": [folder]})

    listed = f"{folder}-manifest"
    map_arrow(rows, run, MANIFEST).write.parquet(listed)
    done = sorted(spark.read.schema(MANIFEST).parquet(listed).collect())  # a row for each part
    bases = np.cumsum([0] + [r.n_tokens for r in done]).tolist()
    return spark.createDataFrame([(*r, b) for r, b in zip(done, bases, strict=False)], MANIFEST + ", base bigint")


def _map(store, path: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary of little-endian unsigned 32-bit integers) of every document."""
    spark: SparkSession = manifest.sparkSession
    schema = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = _place(row["folder"])
                index = _map(store, f"{root}/part-{row['part']:06d}.idx", "<i8")
                tokens = _map(store, f"{root}/part-{row['part']:06d}.bin", f"<u{row['width']}")
                n = row["n_docs"]
                docs, offsets = index[:n], index[n:]
                for at in range(0, n, SLICE):
                    own = offsets[at : at + SLICE + 1]
                    names = docs[at : at + SLICE]
                    ids = [tokens[a:b].astype("<u4").tobytes() for a, b in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64(), mask=np.asarray(names) == NULL_ID), pa.array(own[:-1] + row["base"]), pa.array(np.diff(own)), pa.array(ids, pa.binary())],
                        names=[id_col, "start", "n_tokens", "ids"],
                    )

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(manifest.repartition(parts, "part"), run, schema)
