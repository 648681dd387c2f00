"""Nested JSON, feeds, links and the registry of sources against plain Python, on odd payloads."""

import json
import random
import urllib.parse

from pyspark.sql import functions as F

from ledgerloom.sources import nested, registry
from ledgerloom.sources.evidence import COLUMNS


def walk(node, name, path="$", depth=0):
    if isinstance(node, dict):
        for k, v in node.items():
            at = f"{path}.{k}"
            if k == name and isinstance(v, dict):
                yield at, depth + 1, v
            yield from walk(v, name, at, depth + 1)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, name, f"{path}[{i}]", depth + 1)


def grow(draw, depth):
    if depth == 0 or draw.random() < 0.2:
        return draw.choice([1, "x", None, True, 2.5, '"hit"', "é"])
    if draw.random() < 0.4:
        return [grow(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice(["hit", "a", "b", "hit2"]): grow(draw, depth - 1) for _ in range(draw.randint(0, 3))}


def test_objects_at_any_depth_are_as_by_hand(spark):
    draw = random.Random(1)
    docs = [(i, json.dumps(grow(draw, 9))) for i in range(60)]
    deep = {"hit": {"leaf": 1}}
    for k in range(150):
        deep = {"d": deep} if k % 2 else [deep]
    docs += [(100, json.dumps(deep)), (101, None), (102, "no json"), (103, '{"hit": 3, "x": {"hit": [{"hit": {}}]}}'), (104, "{}"), (103, '{"hit": {"hit": {}}}')]
    want = sorted((i, p, d, json.dumps(v, sort_keys=True)) for i, t in docs if t and t != "no json" for p, d, v in walk(json.loads(t), "hit"))
    found = nested.find_objects(spark.createDataFrame(docs, "id int, body string"), "id", "body", "hit").collect()
    assert sorted((r["id"], r.path, r.depth, json.dumps(json.loads(r.value), sort_keys=True)) for r in found) == want
    assert nested.find_objects(spark.createDataFrame([], "id int, body string"), "id", "body", "hit").count() == 0


def test_a_document_is_walked_without_jobs_between_levels(spark):
    """Levels of a document cost no job each and nothing is written on the way; keys and values may be escaped."""
    odd = {"a}{": ['"hit":{', {"hit": {"x": "}]\\\"", "n": -1.5e300, "é\n": [{}, []]}}], "b.c": {'q"': {"hit": {}}}}
    docs = spark.createDataFrame([(None, json.dumps(odd, indent=1)), (2, '{"h\\u0069t": {"hit":[{"hit":{"k":"v"}}]}, "hit2": {}}'), (3, '"hit"'), (4, '{"hit":{}')], "id int, body string")
    spark.sparkContext.setJobGroup("nested", "levels")
    try:
        found = nested.find_objects(docs, "id", "body", "hit")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("nested")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = sorted((r["id"] or 0, r.path, r.depth, json.dumps(json.loads(r.value), sort_keys=True)) for r in found.collect())
    want = [(0, p, d, json.dumps(v, sort_keys=True)) for p, d, v in walk(odd, "hit")] + [(2, p, d, json.dumps(v)) for p, d, v in walk({"hit": {"hit": [{"hit": {"k": "v"}}]}, "hit2": {}}, "hit")]
    assert got == sorted(want) and len(got) == 4


def test_texts_of_nodes(spark):
    nodes = ['{"simpleText":"a"}', '{"runs":[{"text":"a"},{"x":1},{"text":"b"}]}', '[{"snippetText":{"runs":[{"text":"c"}]}},{"simpleText":"d"}]', "{}", "[]", None, "3"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "i int, n string")
    assert [r.t for r in rows.select("i", nested.runs_text(F.col("n")).alias("t")).orderBy("i").collect()] == ["a", "ab", "c d", "", "", "", ""]


def test_pages_without_data_have_no_talks(spark):
    pages = [(1, 'x var ytInitialData = {"a":{"videoRenderer":{"videoId":"v","title":{"simpleText":"t"}}}}; y'), (2, "nothing"), (3, None), (4, 'var ytInitialData = {"videoRenderer":{"title":{}}};'), (5, "var ytInitialData = {broken};")]
    assert [(r["id"], r.video_id, r.title, r.channel) for r in nested.talks(spark.createDataFrame(pages, "id int, html string"), "id", "html").collect()] == [(1, "v", "t", "")]


def test_feeds_of_both_kinds_and_broken_ones(spark):
    bodies = [
        "<rss><channel><item><title> T </title><link>l</link><description>&lt;p&gt;hi&lt;/p&gt;</description></item><item><guid>g</guid></item></channel></rss>",
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="h"/><content>c</content></entry></feed>',
        "<rss><channel/></rss>", "<broken", "", None,
    ]
    found = registry.feed(spark.createDataFrame([(b,) for b in bodies], "body string"), "https://user@f.example:8080/x").collect()
    assert sorted((r.source, r.title, r.url, r.text) for r in found) == [("f.example", "", "g", ""), ("f.example", "A", "h", "c"), ("f.example", "T", "l", "hi")]


def test_links_are_quoted_as_python_quotes(spark):
    texts = ["a b", "c&d=e", "~_.-/*+", "é東", "100%", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "query string")
    assert {r.url for r in registry.search_links(rows, {"s": "https://x/?q={}"}).collect()} == {f"https://x/?q={urllib.parse.quote(t)}" for t in texts}


def test_a_broken_source_leaves_the_others(spark):
    def plain(df):
        return df.select(*(F.col("body").alias(c) if c == "title" else F.lit(None).cast({"created_utc": "double", "popularity": "bigint"}.get(c, "string")).alias(c) for c in COLUMNS))

    def lost(df):
        raise RuntimeError("address not known")

    sources = [registry.Source("good", plain), registry.Source("lost", lost), registry.Source("late", lambda df: plain(df.withColumn("body", F.raise_error(F.lit("gone")).cast("string")))), registry.Source("off", lost, enabled=False), registry.Source("empty", plain)]
    payloads = spark.createDataFrame([("good", "{}"), ("good", "bad"), ("late", "{}"), ("off", "{}"), ("other", "{}"), (None, "{}")], "origin string, body string")
    rows, report = registry.collect(spark, sources, payloads)
    assert sorted((r.origin, r.title) for r in rows.collect()) == [("good", "bad"), ("good", "{}")]
    status = {r.source: (r.status, r.n_rows, r.n_bad, r.error is not None) for r in report.collect()}
    assert status == {"good": ("read", 2, 1, False), "lost": ("failed", 0, 0, True), "late": ("failed", 0, 0, True), "off": ("skipped", 0, 0, False), "empty": ("read", 0, 0, False)}
    _, few = registry.collect(spark, sources, payloads, only=["empty"])
    assert sorted(r.status for r in few.collect()) == ["read"] + ["skipped"] * 4
