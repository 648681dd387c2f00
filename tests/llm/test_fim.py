"""The fill-in-middle transformation against plain Python, and its odd rows."""

import hashlib

import pytest

from ledgerloom.llm import fim, queries

SF = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (None, "no id"), (3, "a<P>b"), (4, "x<"), (5, "S>M>"), (6, "é東🎉x́\r\n\t\0 end"), (7, "a" * 300_000 + "é"), (7, "a" * 300_000 + "é"), (8, "<M"), (9, " ")]


def by_hand(doc_id, text, moved=90, spm=20, seed="1"):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, share, kind = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or share % 100 >= moved:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if kind % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("moved,spm", [(90, 20), (100, 50), (0, 20)])
def test_every_form_is_as_by_hand_and_restores(spark, moved, spm):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD * 2], "doc_id bigint, text string, form string, n int")
    found = fim.transform(rows, moved_percent=moved, spm_percent=spm, restored=True).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found), key=key) == sorted(
        ((i, *by_hand(i, t, moved, spm), t or "") for i, t in ODD * 2), key=key
    )


@pytest.mark.parametrize("unit,cut", [(fim.WORDS, r"[^ \n]*[ \n]+|[^ \n]+"), (fim.LINES, r"[^\n]*\n|[^\n]+")])
def test_other_units_cut_between_units_only(spark, unit, cut):
    import re

    texts = {i: f"one  two\n\nthree{i} é 東\n four\t{'w ' * i}" for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    moved = fim.transform(rows, unit=unit, moved_percent=100)
    back = {r.doc_id: r.restored for r in fim.restore(moved).collect()}
    assert back == texts
    for r in moved.collect():
        text = texts[r.doc_id]
        ends = {0, *(m.end() for m in re.finditer(cut, text))}
        assert r.n == len(ends) - 1 and r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends


def test_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, form string, output string"
    assert [r.restored for r in fim.restore(spark.createDataFrame([(1, "psm", None)], schema)).collect()] == [None]
    assert fim.restore(spark.createDataFrame([], schema)).count() == 0
    assert fim.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_rows_are_those_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in docs:
        *head, output = by_hand(r.doc_id, r.text)
        want.add((r.doc_id, *head, sha(output), sha(r.text or "")))
    assert {tuple(r) for r in queries.op12_fill_in_middle(spark, SF).collect()} == want
