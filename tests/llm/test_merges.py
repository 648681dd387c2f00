"""The backtracking encoder against the library, token for token."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import merges, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return merges.Codec(f.read())


def agree(codec, library, rows):
    found = codec.encode(rows)
    for made, back, text in zip(found, codec.decode(merges._lists(found)).to_pylist(), rows, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(made, "<u4").tolist() == want, text
        assert back == library.decode(want, skip_special_tokens=False), text


def test_odd_texts_are_those_of_the_library(codec, library):
    agree(codec, library, ["hello <|endoftext|> x", "a<|endoftext|>b,", "<|startoftext|>\n<|endoftext|>", "it's\n\n'LL é\ńx $$$ w*** \t<|", "", None, "ΑΣ ΣΑΣ", "İI"])
    agree(codec, library, ["a\x1cb \x85 c d", "don't I'VE 'Re", " ́a é é", "ﬁ ﬀ", "가나다 각 가", "a\0b", "x" * 100_000, "=-" * 50_000, "東京" * 20_000])


@pytest.mark.parametrize("letters", ["abcdeinthr", "aah", "!.=-*#'?\"", "éàüoß n"])
def test_random_words_are_those_of_the_library(codec, library, letters):
    draw = random.Random(letters)
    agree(codec, library, ["".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(3000)])


def test_any_characters_and_joined_tokens(codec, library):
    draw = random.Random(3)
    spans = [(32, 127), (0xA0, 0x24F), (0x370, 0x5FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (0, 0xD7FF)]
    agree(codec, library, ["".join(chr(draw.randint(*draw.choice(spans))) for _ in range(draw.randint(1, 40))) for _ in range(3000)])
    tokens = sorted(t.replace("</w>", "") for t in library.get_vocab())
    agree(codec, library, ["".join(draw.choice(tokens) for _ in range(draw.randint(1, 4))) for _ in range(5000)])


def plain_merges(word, ranks):
    """Lowest merge first, of equal ones the leftmost."""
    parts = list(word)
    while True:
        best = min(((ranks.get((a, b), 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return parts
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_small_vocabularies_against_plain_merging():
    """Vocabularies learned from random words: many need the encoder to step back."""
    for seed in range(12):
        draw = random.Random(seed)
        words = [list("".join(draw.choice("abc") for _ in range(draw.randint(2, 12)))) for _ in range(60)]
        made, ranks = [], {}
        for _ in range(25):
            counts: dict = {}
            for w in words:
                for pair in zip(w, w[1:], strict=False):
                    counts[pair] = counts.get(pair, 0) + 1
            pair = max(sorted(counts), key=counts.get)
            if any(a + b == pair[0] + pair[1] for a, b in made):
                break
            ranks[pair] = len(made)
            made.append(pair)
            for w in words:
                k = 0
                while k + 1 < len(w):
                    if (w[k], w[k + 1]) == pair:
                        w[k : k + 2] = [w[k] + w[k + 1]]
                    k += 1
        vocab = {t: i for i, t in enumerate([*"abc", *(a + b for a, b in made)])}
        ours = merges.Merges(vocab, [list(p) for p in made], "</w>")
        names = {i: t for t, i in vocab.items()}
        for _ in range(400):
            word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 40)))
            assert [names[i] for i in ours.encode(word)] == plain_merges(word, ranks), word


def test_vocabularies_that_backtracking_cannot_encode_are_refused():
    with pytest.raises(ValueError, match="before its parts"):
        merges.Merges({"a": 0, "b": 1, "c": 2, "abc": 3, "ab": 4}, [["ab", "c"], ["a", "b"]], "</w>")
    with pytest.raises(ValueError, match="itself"):
        merges.Merges({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}, [["b", "c"], ["a", "b"], ["ab", "c"]], "</w>")


def test_frames_round_trip_with_odd_rows(spark, library):
    rows = [(1, "Hello <|endoftext|>"), (1, "Hello <|endoftext|>"), (None, "é x"), (2, None), (3, ""), (4, "a " * 50_000)]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA)
    codec = merges.codec_for(spark, PATH)
    both = merges.decode(merges.encode(frame, codec), codec).collect()
    for text in {t for _, t in rows}:
        ids = library.encode(text or "", add_special_tokens=False).ids
        own = [r for r in both if r.ids == ids]
        assert own and all(r.decoded == library.decode(ids, skip_special_tokens=False) for r in own)
    assert len(both) == len(rows)
    assert merges.encode(spark.createDataFrame([], SCHEMA), codec).count() == 0
    assert [r.decoded for r in merges.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), codec).collect()] == [""]


def test_query_rows_are_those_of_the_library(spark, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_merge_bpe(spark, SF).collect()} == want


def test_the_file_is_one_the_codec_can_read():
    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    assert made["decoder"] is None and made["post_processor"] is None and made["model"]["end_of_word_suffix"] == "</w>"
