"""Secrets of any length are found and masked whole."""

import base64
import hashlib

import pytest

from ledgerloom.llm import secrets

LENGTHS = (201, 1000, 5000)


def hexes(n, salt="x"):
    return "".join(hashlib.sha256(f"{salt}{i}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]


def b64(n, salt="x"):
    return base64.b64encode(b"".join(hashlib.sha256(f"{salt}{i}".encode()).digest() for i in range(n // 32 + 1))).decode()[:n]


def url64(n, salt="x"):
    return b64(n, salt).translate(str.maketrans("+/", "-_"))


def cases():
    out = []
    for n in LENGTHS:
        jwt = f"eyJ{url64(n, 'h')}.{url64(n, 'p')}.{url64(n, 's')}"
        out += [
            ("hex after a key word", f'so password = "{hexes(n)}" it is', hexes(n)),
            ("base64 after a key word", f"und api_key: {b64(n)} mit", b64(n)),
            ("bare token", f"et {jwt} la", jwt),
            ("token after a key word", f"Authorization: Bearer token={jwt} la", jwt),
            ("prefix", f"see ghp_{hexes(n)} la", "ghp_" + hexes(n)),
        ]
    return out


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark)


def test_long_secrets_are_masked_whole(spark, model):
    rows = cases()
    frame = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id bigint, text string")
    found = {(r.doc_id, r.value): r.is_secret for r in secrets.scan(frame, model).collect()}
    assert found == {(i, v): True for i, (_, _, v) in enumerate(rows)}
    clean = {r.doc_id: r.text for r in secrets.redact(frame, model).collect()}
    assert clean == {i: t.replace(v, "[SECRET]") for i, (_, t, v) in enumerate(rows)}


def test_long_bare_runs_are_candidates(spark):
    late = "abcdefghij" * 15 + "7" + "k" * 60  # the first digit stands late
    runs = [hexes(n, "bare") for n in LENGTHS] + [late]
    frame = spark.createDataFrame([(i, f"und {v} der") for i, v in enumerate(runs)], "doc_id bigint, text string")
    assert {(r.doc_id, r.at, r.value) for r in secrets.candidates(frame).collect()} == {(i, 4, v) for i, v in enumerate(runs)}
