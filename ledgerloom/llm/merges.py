"""Exact BPE in linear time by backtracking over the longest tokens, and decoding by an offset table.

A pre-token is written over an alphabet of 512 letters: a byte, or a byte that ends a word. An Aho-Corasick automaton
over the tokens gives the longest token at each position. The encoder walks on by longest tokens; where the next token
cannot stand beside the one before, it tries the next shorter prefix that is a token, and where none is left it gives
up the last token and never returns to the position where it stood. A prefix of a word has one valid path, so every
position is given up once at most and the work is linear in the word.

Two tokens may stand side by side when no merge would have joined them first. Of each token the history is known: its
right edge was in turn each token of its chain of last parts, its left edge each of its chain of first parts, each from
its own merge until the next one up the chain. A merge across the joint happens when two edges that existed at one time
have a merge that comes before the merge that ends either of them; of equal merges the left one comes first. Answers
are kept in a table of pairs.

The vocabulary must be one whose merges never need a later merge and whose tokens all encode to themselves, which
``Merges`` verifies when it is built; a vocabulary that fails is refused.

Texts are normalised and cut into pre-tokens as the vocabulary's file says, by the library's own normaliser and
pre-tokeniser; a chunk of Latin letters and ASCII marks, which they only put in lower case and cut in two, goes without. Strings of added tokens in a text become their ids, as the library does.

Defined results: a null or empty text has no ids and decodes to the empty text; null lists of ids decode to the empty
text; rows are kept one for one, repeated or with null or repeated ids; other columns are not read, so their names do
not matter; an empty table gives an empty result. Texts of any length are encoded whole; memory is bounded by a slice
of an Arrow batch and by tables of ``CACHE`` entries a worker, emptied when full.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import byte_alphabet
from ledgerloom.llm.shared import map_arrow

CACHE = 250_000
SLICE = 256
LAST = 256  # letters from here on are bytes that end a word
NEVER = 1 << 30
_state: dict = {}


class Merges:
    """Tokens over the 512 letters, how each was made, and the encoder of single pre-tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        import ahocorasick

        byte_of = {c: b for b, c in enumerate(byte_alphabet())}

        def letters(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            own = [byte_of[c] for c in (token.removesuffix(suffix) if ends else token)]
            return "".join(map(chr, own[:-1])) + chr(own[-1] + LAST * ends)

        self.ids = {letters(token): i for token, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.first, self.second, self.made = [-1] * size, [-1] * size, [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if self.made[whole] >= 0:
                raise ValueError(f"token {a + b!r} is merged twice")
            self.first[whole], self.second[whole], self.made[whole] = x, y, rank
            self.joined[x, y] = rank
        self.pairs: dict[int, bool] = {}
        for whole, (x, y) in enumerate(zip(self.first, self.second, strict=True)):
            if x >= 0 and max(self.made[x], self.made[y]) >= self.made[whole]:
                raise ValueError(f"token {whole} is merged before its parts")
            if x >= 0 and not self._apart(x, y, self.made[whole]):
                raise ValueError(f"token {whole} does not encode to itself")
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.length = [0] * size
        self.shorter = [-1] * size
        for token, i in self.ids.items():
            self.length[i] = len(token)
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def _edge(self, token: int, part: list[int], until: int) -> list[tuple[int, int]]:
        """(edge, rank of the merge that ends it) from the whole token inwards."""
        chain = []
        while token >= 0:
            chain.append((token, until))
            until, token = self.made[token], part[token]
        return chain

    def _apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """No merge before ``until`` joins an edge of ``a`` with an edge of ``b``."""
        rights, lefts = self._edge(a, self.second, until), self._edge(b, self.first, until)
        i, j = len(rights) - 1, len(lefts) - 1
        while True:
            (x, x_ends), (y, y_ends) = rights[i], lefts[j]
            rank = self.joined.get((x, y), NEVER)
            # an equal merge on the left comes first, one on the right comes after
            if rank < x_ends and rank <= y_ends and rank < until:
                return False
            # the edge that ends first gives way
            if i and (x_ends <= y_ends or not j):
                i -= 1
            elif j:
                j -= 1
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token; every letter is a token, so there always is a way."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        longest: dict[int, int] = {}
        for end, (n, token) in self.automaton.iter(word):
            longest[end - n + 1] = token  # of one start, later ends are longer
        pairs, length, size = self.pairs, self.length, len(word)
        given_up: set[int] = set()
        path: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + length[token]
            fits = end not in given_up
            if fits and path:
                key = path[-1] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._apart(path[-1], token)
            if fits:
                path.append(token)
                at = end
                token = longest.get(at, -1)
                continue
            token = self.shorter[token]
            while token < 0:
                given_up.add(at)
                token = path.pop()
                at -= length[token]
                token = self.shorter[token]
        if len(pairs) > 2 * CACHE:
            self.pairs = {}
        return path


#: A core of Latin letters and ASCII punctuation after it; U+0130 has two letters in lower case.
_PLAIN = re.compile(r"((?:(?![İ×÷])[a-zA-ZÀ-ɏ])+)([!-&(-/:;=-@\[-`{-~]*)")


class Codec:
    """Encoder and decoder of one vocabulary file inside a task."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        made = json.loads(spec)
        model = made["model"]
        self.library = Tokenizer.from_str(spec)  # for its normaliser and pre-tokeniser; its model is not called
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        by_id = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        pieces = [(by_id.get(i, "") + " ").encode() for i in range(max(by_id) + 1)]
        #: The offset table: the tokens one after another, each with the space that follows it, and where each begins.
        self.table = pa.array(pieces, pa.binary())

    def _letters(self, own: bytes) -> str:
        return own[:-1].decode("latin-1") + chr(own[-1] + LAST)

    def _segment(self, text: str) -> list[int]:
        """Ids of text without added tokens."""
        if not text:
            return []
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        encode, byte_of = self.merges.encode, self.byte_of
        return [i for mapped, _ in cut for i in encode(self._letters(bytes([byte_of[c] for c in mapped])))]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without blanks and line ends."""
        ids, at = [], 0
        for mark in self.marks.finditer(chunk):
            ids += [*self._segment(chunk[at : mark.start()]), self.added[mark[0]]]
            at = mark.end()
        return array("I", ids + self._segment(chunk[at:])).tobytes()

    def _core(self, core: str) -> bytes:
        """Ids of one pre-token in lower case."""
        return array("I", self.merges.encode(self._letters(core.encode()))).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        known, before = self.known, self.before
        for chunk in chunks:
            ids = before.get(chunk)
            if ids is None:
                plain = _PLAIN.fullmatch(chunk)
                if plain is None:
                    ids = self._chunk(chunk)
                else:
                    core, tail = plain.groups()
                    core = core.lower()
                    ids = known.get(core)
                    if ids is None:
                        ids = known[core] = self._core(core)
                    if tail:
                        end = known.get(tail)
                        if end is None:
                            end = known[tail] = self._chunk(tail)
                        ids += end
            known[chunk] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        known = self.known
        # a line end is white space to the vocabulary as a blank is, and no added token holds either
        chunks = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        found = [list(map(known.get, c)) for c in chunks]
        holes = [k for k, ids in enumerate(found) if None in ids]
        fresh = {c for k in holes for c, ids in zip(chunks[k], found[k], strict=True) if ids is None}
        self._learn(fresh)
        for k in holes:
            found[k] = list(map(known.get, chunks[k]))
        for chunk in fresh:
            if len(chunk) > 64:
                known.pop(chunk, None)
        return list(map(b"".join, found))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Tokens of each list joined by a space: bytes taken by the offset table, less the last space."""
        lists = lists.fill_null([]) if lists.null_count else lists
        ends = lists.offsets.to_numpy()
        pieces = self.table.take(lists.flatten())
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        own = bounds[ends - ends[0]]
        data = memoryview(pieces.buffers()[2]) if len(pieces) else b""
        return pa.array([bytes(data[a : max(a, b - 1)]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _codec(key: str, spec: str) -> Codec:
    if _state.get("key") != key:
        _state.update(key=key, codec=Codec(spec))
    return _state["codec"]


def codec_for(spark: SparkSession, path: str) -> Callable[[], Codec]:
    """Broadcasts the vocabulary's file (fixed size, it does not grow with the data); a worker builds its codec once."""
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    return lambda: _codec(path, held.value)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(df: DataFrame, codec: Callable[[], Codec], id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) of every row; ``decoded`` is decoded from the ids in the same stage."""
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
    return map_arrow(rows, run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, codec: Callable[[], Codec], id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded string) from rows with ``ids``."""
    rows = df.select(id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), one.decode(part.column(1))], names=[id_col, "ids", "decoded"])

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, ids array<int>, decoded string")
