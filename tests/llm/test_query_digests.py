"""The queries without SQL against plain Python over the same tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import decontam, queries, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op7_rows_are_those_of_the_library(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts(spark).items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_byte_bpe(spark, SF).collect()} == want


def test_op10_rows_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i, t in sorted(texts(spark).items()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, SF).collect()} == want


def test_special_tokens_in_texts_are_those_of_the_library():
    from tokenizers import Tokenizer

    from ledgerloom.llm.token_files import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), WordEncoder(path, "<u2")
    rows = ["hello <|endoftext|> x", "a<|endoftext|>b,", "<|startoftext|>\n<|endoftext|>", "it's\n\n'LL é\ńx $$$ w*** \t<|", "", None]
    for made, text in zip(ours.encode(rows), rows, strict=True):
        assert np.frombuffer(made, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_op8_candidates_are_those_of_the_pattern(spark):
    key = hashlib.sha256(b"z").hexdigest()
    rows = [*texts(spark).items(), (-1, f'é password = "{key}{key}{key}" 東 token: {key[:30]}, AKIA{key[:20].upper()}'), (-2, f"{key} {key}\n{key}")]
    pattern, keyed = re.compile(secrets.CANDIDATE), re.compile("(?i)^(?:" + "|".join(secrets.KEYWORDS) + ")")
    want = []
    for i, t in rows:
        for m in pattern.finditer(t):
            value = m[0]
            if keyed.match(value):
                own = re.match(r"^[\w.-]*?[\"']?\s{0,3}[=:]\s{0,3}[\"']?(\S{8,}+)$", value)
                value = own[1] if own else value
            want.append((i, m.end() - len(value), value))
    found = secrets.candidates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r["at"], r.value) for r in found) == sorted(want) and len(want) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_op3_finds_what_every_offset_finds(spark, seed):
    """Every item that shares a seed and half its words with a document at one offset, and nothing without such words."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"v{i}" for i in range(60)])
    items = [rng.choice(vocabulary, n).tolist() for n in (6, 9, 12, 20, 33, 50, 70, 12)]
    docs = []
    for k in range(40):
        words = rng.choice(vocabulary, rng.integers(0, 120)).tolist()
        if k % 2:
            item = list(items[k % len(items)])
            for at in rng.choice(len(item), int(len(item) * rng.choice([0, 0.1, 0.25, 0.4])), replace=False):
                item[at] = "zz"
            cut = rng.integers(0, len(words) + 1)
            words = words[:cut] + item + words[cut:]
        docs.append(words)
    docs.append(["v1"] * 400)
    items.append(["v1"] * 30)  # both repetitive
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in decontam.find(frame, bench).collect()}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            equal = np.zeros(len(item), bool)
            must = False
            for shift in range(-len(item) + 1, len(words)):
                same = np.array([0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(item)])
                equal |= same
                masks = decontam.MASKS + (decontam.LIGHT_MASKS if len(item) < decontam.LIGHT_BELOW else ())
                seeded = any(same[[k + q for q in m]].all() for m in masks for k in range(len(item) - max(m)))
                must |= bool(seeded and same.sum() >= 0.5 * len(item))
            if must:
                assert (d, i) in found
            if (d, i) in found:
                assert found[d, i] <= equal.sum() and (found[d, i] >= 0.5 * len(item) or found[d, i] >= 25)
