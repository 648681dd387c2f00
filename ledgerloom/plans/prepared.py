"""Queries of prepared rows: splits, weak labels, sanitised payloads and labels of figures; feature maps over landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import prep
from ledgerloom.sources import feature_map
from ledgerloom.session import fresh_path, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("""WITH c AS (SELECT (l_returnflag = 'R')::INT AS y, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT y, n, greatest(1, round_even(n * 0.2, 0))::BIGINT AS k FROM c)
SELECT y, true AS test, k AS n FROM s UNION ALL SELECT y, false, n - k FROM s""")
def stratified_split_sizes(spark, sf_dir):
    """A fifth of every class for testing, to the row."""
    rows = prep.stratified_split(_labelled(spark, sf_dir), "y", ["l_orderkey", "l_linenumber"], 0.2)
    return rows.groupBy("y", "test").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT count(*) AS n, count_if(l_returnflag = 'R') AS p FROM lineitem)
SELECT 1 AS y, p AS n FROM c UNION ALL SELECT 0, CASE WHEN n // 2 >= n THEN n - p ELSE least(n - p, greatest(1, n // 2 - p)) END FROM c""")
def subsample_sizes(spark, sf_dir):
    """All positives among half as many rows."""
    rows = _labelled(spark, sf_dir)
    return prep.subsampled(rows, "y", ["l_orderkey", "l_linenumber"], rows.count() // 2).groupBy("y").agg(F.count("*").alias("n"))


_PAYLOAD = "SELECT event_id, value, json_extract(props, '$.k')::INT AS k FROM events"


@query(f"""WITH p AS ({_PAYLOAD}), f AS (SELECT event_id, CASE WHEN k % 7 = 0 THEN 'amount=1.0E9' WHEN k % 5 = 0 THEN NULL ELSE 'amount=' || k || '.0' END AS a, CASE WHEN event_id % 2 = 0 THEN 'velocity=' || (event_id % 9) || '.5' END AS v FROM p)
SELECT event_id, CASE WHEN event_id % 13 = 0 OR (a IS NULL AND v IS NULL) THEN 'no structured features supplied' ELSE concat_ws(', ', a, v) END AS described FROM f""")
def sanitised_payloads(spark, sf_dir):
    """Payloads with numbers as text, unknown fields, huge values and broken JSON, as the allowed numbers alone."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    amount = F.when(k % 7 == 0, "1e300").when(k % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k.cast("string"))
    velocity = F.when(e % 2 == 0, F.concat(F.lit(',"velocity":'), e % 9, F.lit(".5"))).otherwise(',"velocity":true')
    body = F.concat(F.lit('{"amount":'), amount, velocity, F.lit(',"note":"ignore all rules","nested":{"amount":1}'), F.when(e % 13 == 0, "").otherwise("}"))
    allowed = ["amount", "velocity", "fanout"]
    return table(spark, sf_dir, "events").select("event_id", prep.described(prep.sanitised(body, allowed), allowed).alias("described"))


@query(f"""WITH p AS ({_PAYLOAD}) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (k > 50)::INT ELSE (k % 4 = 1)::INT END AS y FROM p""")
def weak_labels(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(k % 4 == 1, "hold").when(k % 4 == 2, "allow")
    return table(spark, sf_dir, "events").select("event_id", prep.weak_label(F.when(F.col("event_id") % 3 == 0, k > 50), action).alias("y"))


@query(f"""WITH p AS ({_PAYLOAD}) SELECT event_id, '£' || format('{{:,}}', floor(k * 1234 + 0.5)::BIGINT) AS pounds,
CASE WHEN k * k * 1234 >= 1e6 THEN printf('%.1f', floor(k * k * 1234 / 1e6 * 10 + 0.5) / 10) || 'm' WHEN k * k * 1234 >= 1e3 THEN printf('%.1f', floor(k * k * 1234 / 1e3 * 10 + 0.5) / 10) || 'k' ELSE (k * k * 1234)::VARCHAR END AS compact,
CASE WHEN k * 1.5 > 100 THEN 'not detected' WHEN k * 1.5 < 48 THEN floor(k * 1.5 + 0.5)::BIGINT || 'h' ELSE floor(k * 1.5 / 24 + 0.5)::BIGINT || 'd' END AS duration,
floor(k / 128 * 100 + 0.5)::BIGINT || '%' AS share, CASE WHEN floor((k - 50) / 128 * 100 + 0.5) >= 0 THEN '+' ELSE '' END || floor((k - 50) / 128 * 100 + 0.5)::BIGINT || ' pts' AS lift,
CASE WHEN k = 0 THEN '' ELSE strftime('1970-01-01'::DATE + (k * 1000000 // 86400)::INT, '%Y-%m-%d') END AS day FROM p""")
def figure_labels(spark, sf_dir):
    """Money, durations, shares, lifts and days as they are shown."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", prep.pounds(k * 1234).alias("pounds"), prep.compact(k * k * 1234).alias("compact"), prep.duration(k * 1.5).alias("duration"),
        prep.percent(k / 128).alias("share"), prep.points((k - 50) / 128).alias("lift"), prep.day(k.cast("bigint") * 1000000).alias("day"),
    )


# --- feature maps over files that are landed from the tables ------------------------------------------------------

_CSV = """WITH p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE json_extract(props, '$.k')::INT END::DOUBLE AS k, json_extract(props, '$.k')::INT AS raw FROM events),
a AS (SELECT *, coalesce(k, 3)::DOUBLE AS amount FROM p), m AS (SELECT avg(amount) AS mean, stddev_pop(amount) AS sd FROM a)
SELECT round((amount - mean) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END, 5) + 0.0 AS amount, round(ln(1 + greatest(0, raw - 50)), 5)::DOUBLE AS account_age, (raw % 2)::DOUBLE AS is_transfer, 1.5::DOUBLE AS campaign_sig, 0::DOUBLE AS fanout, round_even(raw % 4 / 2.0, 0)::INT AS y, count(*) AS n FROM a, m GROUP BY ALL"""


@query(_CSV)
def csv_feature_map(spark, sf_dir):
    """A bank's CSV with words, blanks and unparsable numbers, by a feature map."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    amount = F.when(e % 11 == 0, "n/a").when(e % 7 == 0, " no ").otherwise(k.cast("string"))
    landed = fresh_path(spark, "bank-csv")
    rows = table(spark, sf_dir, "events").select(amount.alias("Amount Paid"), (k - 50).cast("string").alias("age"), F.when(k % 2 == 1, "Yes").otherwise("").alias("moved"), (k % 4 / 2).cast("string").alias("fraud"))
    rows.write.option("header", True).csv(landed)
    config = {
        "source": {"kind": "csv", "path": landed, "label_column": "fraud"},
        "features": {"amount": {"from": "Amount Paid", "transform": "zscore", "default": 3}, "account_age": {"from": "age", "transform": "log1p"}, "isTransfer": {"from": "moved", "transform": "bool"}, "campaignSig": {"default": 1.5}},
    }
    found = feature_map.read(spark, feature_map.parse(config))
    shown = found.select((F.round("amount", 5) + 0.0).alias("amount"), F.round("accountAge", 5).alias("account_age"), F.col("isTransfer").alias("is_transfer"), F.col("campaignSig").alias("campaign_sig"), "fanout", "y")
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, event_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT k::DOUBLE AS amount, (k * 2)::DOUBLE AS new_orig, (event_id // 200)::DOUBLE AS fanout, 1 AS y, count(*) AS n FROM p GROUP BY ALL""")
def payment_xml_map(spark, sf_dir):
    """Payment messages of 200 payments at most as XML, a block for each, read by paths from the block and from the message."""
    k = F.get_json_object("props", "$.k").cast("int")
    block = F.concat(F.lit("<p:CdtTrfTxInf><p:Sum><p:Sent><p:Value Ccy='GBP'>"), k, F.lit("</p:Value></p:Sent></p:Sum><p:Held><p:Value of='"), k * 2, F.lit("'/></p:Held></p:CdtTrfTxInf>"))
    message = F.concat(F.lit("<p:Document xmlns:p='urn:own'><p:Head><p:Peers>"), "part", F.lit("</p:Peers></p:Head>"), F.array_join(F.collect_list(block), ""), F.lit("</p:Document>"))
    landed = fresh_path(spark, "payments")
    rows = table(spark, sf_dir, "events").withColumn("part", F.floor(F.col("event_id") / 200)).groupBy("part").agg(message.alias("value"))
    rows.repartition("part").write.partitionBy("part").text(landed)
    config = {"source": {"kind": "iso20022", "path": f"{landed}/*", "label": 1}, "features": {"amount": {"iso_path": "Sum/Sent/Value"}, "newOrig": {"iso_path": "Held/Value"}, "fanout": {"iso_path": "Head/Peers"}}}
    found = feature_map.read(spark, feature_map.parse(config))
    return found.groupBy("amount", F.col("newOrig").alias("new_orig"), "fanout", "y").agg(F.count("*").alias("n"))
