"""Readers on literal files and streaming jobs on small streams."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import evidence, feature_map
from ledgerloom.streaming import rounds

PAYMENTS = """<?xml version="1.0"?><Document xmlns="urn:x"><Hdr><MsgId>m</MsgId><Cd v="7"/></Hdr>
<CdtTrfTxInf><IntrBkSttlmAmt Ccy="GBP">4800.00</IntrBkSttlmAmt><Amt><InstdAmt Ccy="GBP">4800.00</InstdAmt></Amt></CdtTrfTxInf>
<CdtTrfTxInf><IntrBkSttlmAmt Ccy="GBP">9200.00</IntrBkSttlmAmt><Amt><InstdAmt Ccy="GBP">9200.00</InstdAmt></Amt></CdtTrfTxInf></Document>"""


def test_csv_map(spark, tmp_path):
    (tmp_path / "a.csv").write_text("amount,account_age,moved,is_fraud\nnan,-2.0,yes,1\ninf,0.5,0,0\n3.0,,no,0.5\n")
    config = {"source": {"kind": "csv", "path": "a.csv", "label_column": "is_fraud"}, "features": {"amount": {"from": "amount"}, "account_age": {"from": "account_age", "transform": "log1p"}, "isTransfer": {"from": "moved", "transform": "bool"}, "velocity": {"from": "absent", "default": 2}, "campaignSig": {"default": 1.5}}}
    (tmp_path / "m.json").write_text(json.dumps(config))
    rows = feature_map.read(spark, feature_map.load(str(tmp_path / "m.json"))).collect()
    assert [r.amount for r in rows] == [0.0, 0.0, 3.0] and [r.y for r in rows] == [1, 0, 0]
    assert rows[0].accountAge == 0.0 and rows[0].isTransfer == 1.0 and {(r.velocity, r.campaignSig, r.fanout) for r in rows} == {(2.0, 1.5, 0.0)}
    with pytest.raises(ValueError):
        feature_map.parse({"source": {"kind": "csv", "path": "x"}, "features": {"nonsense": {}}})


def test_payment_map(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAYMENTS)
    config = {"source": {"kind": "iso20022", "path": "p.xml", "label": 1}, "features": {"amount": {"iso_path": "CdtTrfTxInf/IntrBkSttlmAmt", "transform": "zscore"}, "newOrig": {"iso_path": "CdtTrfTxInf/Amt/InstdAmt"}, "fanout": {"iso_path": "Hdr/Cd"}, "campaignSig": {"default": 1.5}}}
    rows = feature_map.read(spark, feature_map.parse(config, str(tmp_path))).orderBy("amount").collect()
    assert [(r.amount, r.newOrig, r.fanout, r.campaignSig, r.y) for r in rows] == [(-1.0, 4800.0, 7.0, 1.5, 1), (1.0, 9200.0, 7.0, 1.5, 1)]


def test_payment_paths_are_looked_up_once(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAYMENTS)
    config = {"source": {"kind": "iso20022", "path": "p.xml"}, "features": {"fanout": {"iso_path": "Hdr/Cd"}}}
    found = feature_map.read(spark, feature_map.parse(config, str(tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("evaluate(document") == plan.count("evaluate(block") == 2  # text and attribute
    assert [r.fanout for r in found.collect()] == [7.0, 7.0]


def test_card_columns(spark):
    names = ["Time", *(f"V{i}" for i in range(1, 29)), "Amount", "Class"]
    rows = spark.createDataFrame([("0", *["1"] * 28, "0", '"0"'), ("10", *["3"] * 28, "9", '"1"')], ", ".join(f"{n} string" for n in names))
    found = feature_map.read_cards(rows).orderBy("y").collect()
    assert [(r.Time, r.V7, r.Amount, r.y) for r in found] == [(-1.0, -1.0, -1.0, 0), (1.0, 1.0, 1.0, 1)]


def test_payloads(spark):
    one = lambda body: spark.createDataFrame([(json.dumps(body),), ("not json",), (None,)], "body string")
    r = evidence.reddit(one({"data": {"children": [{"data": {"permalink": "/r/x/1", "subreddit": "x", "title": "t", "selftext": "s", "score": 4, "author": "a", "created_utc": 5.0}}]}})).collect()
    assert [tuple(x) for x in r] == [("reddit", "r/x", "t", "https://www.reddit.com/r/x/1", "a", 5.0, "s", 4)]
    h = evidence.hackernews(one({"hits": [{"objectID": "9", "story_title": "st", "comment_text": "<p>hi</p>", "created_at_i": 3}]})).collect()
    assert [(x.title, x.url[-4:], x.text) for x in h] == [("st", "id=9", "hi")]
    assert evidence.greenhouse(one({"jobs": [{"title": "j", "content": "<b>c</b>", "absolute_url": "u"}]}), "b").first().text == "c"
    assert evidence.lever(one([{"text": "j", "descriptionPlain": "d", "hostedUrl": "u", "createdAt": 2000}]), "b").first().created_utc == 2.0
    d = evidence.discourse(one({"topics": [{"id": 1, "slug": "s", "title": "T"}], "posts": [{"topic_id": 1, "username": "u", "blurb": "b"}, {"topic_id": 2, "username": "v", "blurb": "c"}]}), "https://f").collect()
    assert [(x.title, x.url) for x in d] == [("T", "https://f/t/s/1"), ("", "https://f/t/-/2")]


def stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*")


def test_round_barrier_stream(spark, tmp_path):
    schema = "round bigint, member string, arrival bigint, v array<double>"
    batches = [[(1, "a", 1, [1.0]), (2, "a", 2, [7.0])], [(1, "a", 3, [4.0]), (1, "b", 4, [5.0])], [(1, "c", 5, [6.0]), (1, "d", 6, [100.0])], [(1, "a", 7, [50.0])]]
    out = rounds.run_to_end(rounds.round_barrier(stream(spark, str(tmp_path), batches, schema)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [tuple(r) for r in out.collect()] == [(1, 3, [5.0])]


def test_token_bucket_stream(spark, tmp_path):
    batches = [[("x", float(i) / 100) for i in range(10)], [("x", 3.0), ("y", 0.0)]]
    out = rounds.run_to_end(rounds.token_bucket(stream(spark, str(tmp_path), batches, "client string, at double")), f"{tmp_path}/out", f"{tmp_path}/cp")
    found = sorted(map(tuple, out.collect()))
    assert [a for c, _, a in found if c == "x"] == [True] * 8 + [False] * 2 + [True] and found[-1] == ("y", 0.0, True)


def test_velocity_equals_batch(spark):
    events = spark.createDataFrame([(1, 10, 2.0), (1, 3500, 3.0), (1, 3700, 4.0), (2, 5, 1.0)], "user_id int, s int, value double").withColumn("ts", F.timestamp_seconds("s"))
    found = {(r.user_id, r.n, r.total) for r in rounds.velocity(events).collect()}
    assert found == {(1, 2, 5.0), (1, 1, 4.0), (2, 1, 1.0)}
