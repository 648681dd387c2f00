"""Bounded samples hold whatever the ids are; tokens are candidates whatever stands beside them."""

import hashlib

import pytest

from ledgerloom.llm import langid, secrets, toxicity
from ledgerloom.llm.shared import bounded_sample

DOCS = "doc_id bigint, text string"


def test_an_id_of_many_rows_keeps_the_bound(spark):
    rows = [(7, f"text number {i}", "en") for i in range(5000)] + [(None, f"none {i}", "en") for i in range(50)] + [(8, "same", "de")] * 300 + [(i, f"fr {i}", "fr") for i in range(90)]
    rows += [(i, f"fr {i} in de", "de") for i in range(90)]  # ids of two languages
    frame = spark.createDataFrame(rows, "id bigint, text string, lang string")
    found = bounded_sample(frame, "lang", 240, 100).collect()
    count = {k: sum(r.lang == k for r in found) for k in ("en", "de", "fr")}
    assert count == {"en": 240, "de": 91, "fr": 90} and len({(r["id"], r.text) for r in found}) == len(found)
    few = bounded_sample(frame.where("id < 90 and id not in (7, 8)"), "lang", 10, 100).collect()
    assert sorted(r.lang for r in few) == ["de"] * 10 + ["fr"] * 10
    assert bounded_sample(frame.where("false"), "lang", 240, 100).count() == 0


def test_models_fit_when_all_rows_have_one_id(spark):
    rows = [(7, f"the house and the garden number {i}", "en") for i in range(600)] + [(7, f"das Haus und der Garten Nummer {i}", "de") for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(model["dictionaries"]) == {"en", "de"} and model["sizes"] == {"en": 600, "de": 600}
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_langs=1)
    words = [(7, f"kind {i} word", 0) for i in range(2000)] + [(7, f"awful{i % 3} thing {i}", 1) for i in range(2000)]
    assert toxicity.fit(spark.createDataFrame(words, "doc_id bigint, text string, toxic int"), rows_per_class=50)["weights"] is not None


KEY = hashlib.sha256(b"k").hexdigest()


@pytest.mark.parametrize(
    "text,value",
    [
        (f"the key {KEY}.", KEY), (f"the key {KEY} next", KEY), (f"~{KEY}~", KEY), (f"see {KEY}.{KEY[::-1]}", KEY), (f"a.{KEY}", KEY), (f"({KEY})", KEY),
        ('password: "p@ss!w0rd#9Zkq$1"', "p@ss!w0rd#9Zkq$1"), ("pwd='a\"b&c*d(e)f'", 'a"b&c*d(e)f'), ('token = "two words here"', None), (f'secret="{KEY}', KEY),
    ],
)
def test_tokens_are_found_beside_any_character(spark, text, value):
    found = secrets.candidates(spark.createDataFrame([(1, text)], DOCS)).collect()
    if value is None:
        assert not found
        return
    assert value in [r.value for r in found] and all(text[r["at"] : r["at"] + len(r.value)] == r.value for r in found)


def planted():
    """(text, is a secret) of kinds that the forest was not drawn from."""
    h = lambda salt, i: hashlib.sha512(f"{salt}-{i}".encode()).hexdigest()
    mixed = lambda i: "".join(c.upper() if int(h("m", i)[k], 16) % 2 else c for k, c in enumerate(h("v", i)[:28]))
    for i in range(40):
        yield f'le jardin, db_password = "{mixed(i)}" et la maison', True
        yield f"export API_KEY={h('a', i)[:40]}", True
        yield f"use AKIA{h('b', i)[:16].upper()} there.", True
        yield f'passwd: "{h("c", i)[:6]}!{mixed(i)[:8]}#9" und', True
        yield f"the sha256 checksum is {h('d', i)[:64]}", False
        yield "password = your_password_here_please", False
        yield f"see src/main/config/{h('e', i)[:6]}/template_file_name_list", False
        yield "token: example_token_value_string", False


def test_precision_and_recall_on_planted_secrets(spark):
    rows = list(planted())
    found = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS), secrets.fit(spark)).where("is_secret").select("doc_id").distinct().collect()
    hit = {r.doc_id for r in found}
    right = sum(rows[i][1] for i in hit)
    precision, recall = right / max(1, len(hit)), right / sum(y for _, y in rows)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9
