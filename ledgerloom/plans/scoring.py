"""Queries over transactions: features, scores, metrics, histograms and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scalar import is_valid_vector, seeded_unit, to_number
from ledgerloom.operators import features, metrics, rules, trees
from ledgerloom.operators.features import BIAS, FEATURES, WEIGHTS
from ledgerloom.session import table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: The transaction view and its standardised and scored forms, for the oracle.
TX = """
WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bc AS (SELECT o_custkey AS ck, min(o_orderdate) AS first_order, count(*) AS n_orders FROM orders GROUP BY 1),
fo AS (SELECT o_custkey AS ck, count(DISTINCT l_suppkey) AS n_suppliers FROM j GROUP BY 1),
tx AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, n_regionkey AS bank, l_extendedprice AS amount, c_acctbal AS old_orig, c_acctbal - o_totalprice AS new_orig,
    s_acctbal AS old_dest, s_acctbal + l_extendedprice AS new_dest, date_diff('day', first_order::DATE, o_orderdate::DATE)::DOUBLE AS account_age,
    n_orders::DOUBLE AS velocity, n_suppliers::DOUBLE AS fanout, (l_linestatus = 'O')::INT::DOUBLE AS is_transfer, CASE WHEN l_tax = 0 THEN 1.5 ELSE 0 END::DOUBLE AS campaign_sig,
    (l_returnflag = 'R')::INT AS y
  FROM j JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN bc ON bc.ck = o_custkey JOIN fo ON fo.ck = o_custkey JOIN supplier ON l_suppkey = s_suppkey),
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in FEATURES) + """ FROM tx),
z AS (SELECT tx.* EXCLUDE (""" + ", ".join(FEATURES) + "), " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES) + """ FROM tx, st),
sc AS (SELECT *, round(1 / (1 + exp(-greatest(-30, least(30, """ + " + ".join([str(BIAS)] + [f"{c} * ({w})" for c, w in zip(FEATURES, WEIGHTS, strict=True)]) + """)))), 4) AS score FROM z)
"""
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _scored(spark, sf_dir, *columns):
    """Scored transactions; the join is written once, as its statistics and its rows are both read.

    Only the features, bank, label and the columns named are written.
    """
    rows = features.transactions(spark, sf_dir).select("bank", "y", *FEATURES, *(c for c in columns if c not in FEATURES))
    return features.scored(features.standardise(written(rows, "transactions")))


def _ranked(spark, sf_dir):
    """What a ranking of single rows reads, written once: bank, label, score and the order among equal scores."""
    return written(_scored(spark, sf_dir, *_ORDER).select("bank", "y", "score", *_ORDER), "ranked")


@query(TX + """, g AS (SELECT bank, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY bank ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT bank, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY 1)
SELECT bank, round(auc, 6) AS auc, round(count_if(score > 0.5 AND y = 1) / count_if(y = 1), 6) AS recall, count(*) AS n FROM sc JOIN a USING (bank) GROUP BY bank, auc""")
def score_recall_auc_by_bank(spark, sf_dir):
    rows = written(_scored(spark, sf_dir).select("bank", "score", "y"), "scores")
    auc = metrics.roc_auc(rows, ["bank"])
    recall = rows.groupBy("bank").agg(F.round(metrics.recall(F.col("score"), F.col("y")), 6).alias("recall"), F.count("*").alias("n"))
    return recall.join(auc, "bank").select("bank", F.round("auc", 6).alias("auc"), "recall", "n")


@query(TX + "SELECT " + KEY + ", bank, y, " + ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES) + " FROM tx")
def feature_map_projection(spark, sf_dir):
    return features.transactions(spark, sf_dir).select(*KEY.split(", "), "bank", "y", *(F.round(c, 4).alias(c) for c in FEATURES))


@query(TX + "SELECT bank, " + ", ".join(f"round(avg({c}), 5) + 0.0 AS {c}" for c in FEATURES) + " FROM z GROUP BY bank")
def zscore_features(spark, sf_dir):
    rows = features.standardise(written(features.transactions(spark, sf_dir), "transactions"))
    return rows.groupBy("bank").agg(*((F.round(F.avg(c), 5) + 0.0).alias(c) for c in FEATURES))


@query(TX + "SELECT " + KEY + ", score FROM sc")
def logistic_scores(spark, sf_dir):
    return _scored(spark, sf_dir, *KEY.split(", ")).select(*KEY.split(", "), "score")


_CONTRIBUTION = ", ".join(f"('{c}', round({c} * ({w}), 6))" for c, w in zip(FEATURES, WEIGHTS, strict=True))


@query(TX + f""", c AS (SELECT {KEY}, u.name, u.value, row_number() OVER (PARTITION BY {KEY}, amount ORDER BY u.value DESC, u.name) AS r FROM z, LATERAL (VALUES {_CONTRIBUTION}) AS u(name, value) WHERE u.value > 1e-9)
SELECT name, r AS place, count(*) AS n FROM c WHERE r <= 3 GROUP BY 1, 2""")
def feature_contributions_top3(spark, sf_dir):
    """How often each feature is among the three largest positive contributions of a transaction."""
    rows = features.standardise(written(features.transactions(spark, sf_dir), "transactions"))
    parts = F.array(*(F.struct((-F.round(F.col(c) * w, 6)).alias("minus"), F.lit(c).alias("name")) for c, w in zip(FEATURES, WEIGHTS, strict=True)))
    top = F.slice(F.array_sort(F.filter(parts, lambda x: x["minus"] < -1e-9)), 1, 3)
    return rows.select(F.posexplode(top).alias("place", "one")).groupBy(F.col("one.name").alias("name"), (F.col("place") + 1).cast("bigint").alias("place")).agg(F.count("*").alias("n"))


@query(TX + "SELECT bank, round(coalesce(count_if(score > 0.6 AND y = 1) / nullif(count_if(y = 1), 0), 1), 6) AS recall, round(avg(((score > 0.5) = (y = 1))::INT), 6) AS accuracy FROM sc GROUP BY bank")
def recall_at_threshold(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    right = ((F.col("score") > 0.5) == (F.col("y") == 1)).cast("int")
    return rows.groupBy("bank").agg(F.round(metrics.recall(F.col("score"), F.col("y"), 0.6), 6).alias("recall"), F.round(F.avg(right), 6).alias("accuracy"))


@query(TX + """, g AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM b""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), []).select(F.round("auc", 6).alias("auc"))


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"]
_SQL_ORDER = "score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount"


@query(TX + f""", r AS (SELECT bank, y, row_number() OVER w AS n, sum(y) OVER (PARTITION BY bank ORDER BY {_SQL_ORDER} ROWS UNBOUNDED PRECEDING) AS tp FROM sc WINDOW w AS (PARTITION BY bank ORDER BY {_SQL_ORDER}))
SELECT bank, round(sum(tp / n) FILTER (y = 1) / sum(y), 6) AS average_precision FROM r GROUP BY bank""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_ranked(spark, sf_dir), ["bank"], _ORDER).withColumn("average_precision", F.round("average_precision", 6))


@query(TX + f""", r AS (SELECT y, row_number() OVER (ORDER BY {_SQL_ORDER}) AS n, count(*) OVER () AS c FROM sc)
SELECT round(count_if(n <= greatest(1, round_even(c * 0.05, 0)) AND y = 1) / count_if(y = 1), 6) AS recall_at_budget, any_value(greatest(1, round_even(c * 0.05, 0)))::BIGINT AS k FROM r""")
def recall_at_budget(spark, sf_dir):
    """Recall among the best 5 % of all rows."""
    out = metrics.recall_at_budget(_ranked(spark, sf_dir), [], _ORDER, 0.05, False, 1.0)
    return out.select(F.round("recall_at_budget", 6).alias("recall_at_budget"), "k")


@query(TX + f""", r AS (SELECT bank, y, row_number() OVER (PARTITION BY bank ORDER BY {_SQL_ORDER}) AS n, count(*) OVER (PARTITION BY bank) AS c FROM sc)
SELECT bank, round(coalesce(count_if(n <= greatest(1, ceil(c * 0.15)) AND y = 1) / nullif(count_if(y = 1), 0), 1), 6) AS recall_at_budget, max(greatest(1, ceil(c * 0.15)))::BIGINT AS k FROM r GROUP BY bank""")
def recall_at_budget_by_bank(spark, sf_dir):
    return metrics.recall_at_budget(_ranked(spark, sf_dir), ["bank"], _ORDER, 0.15, True, 1.0).withColumn("recall_at_budget", F.round("recall_at_budget", 6))


@query(TX + "SELECT bank, round((count(*) - sum(y)) / greatest(1, sum(y)), 6) AS pos_weight FROM tx GROUP BY bank")
def class_weights(spark, sf_dir):
    rows = features.transactions(spark, sf_dir)
    return rows.groupBy("bank").agg(F.round((F.count("*") - F.sum("y")) / F.greatest(F.lit(1), F.sum("y")), 6).alias("pos_weight"))


@query("""WITH p AS (SELECT event_id, value * 20 AS amount, (json_extract(props, '$.k'))::INT AS k, event_type FROM events),
f AS (SELECT *, k < 30 AS np, k % 7 = 0 AS ra, k % 5 = 0 AS ic, k / 100.0 AS an, round(k / 200.0, 4) AS score FROM p),
r AS (SELECT *, np AND amount >= 1000 AND (ra OR ic) AS combo,
 score + CASE WHEN np THEN 0.1 ELSE 0 END + CASE WHEN amount >= 5000 THEN 0.2 WHEN amount >= 1000 THEN 0.1 ELSE 0 END + CASE WHEN an >= 0.5 THEN 0.15 * an ELSE 0 END + CASE WHEN ra THEN 0.25 ELSE 0 END + CASE WHEN ic THEN 0.15 ELSE 0 END AS raw FROM f),
q AS (SELECT *, round(greatest(0, least(1, CASE WHEN combo THEN greatest(raw, 0.85) ELSE raw END)), 6) AS risk FROM r)
SELECT event_id, risk, CASE WHEN risk >= 0.8 THEN 'hold' WHEN risk >= 0.6 THEN 'step_up' WHEN risk >= 0.35 THEN 'review' ELSE 'allow' END AS action,
 concat_ws(',', CASE WHEN np THEN 'new_payee' END, CASE WHEN amount >= 5000 THEN 'very_high_amount' WHEN amount >= 1000 THEN 'high_amount' END, CASE WHEN an >= 0.5 THEN 'anomalous_session' END, CASE WHEN ra THEN 'remote_access_active' END, CASE WHEN ic THEN 'call_overlap' END, CASE WHEN combo THEN 'coercion_pattern' END) AS indicators FROM q""")
def scam_rule_verdicts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 20).alias("amount"), k.alias("k"))
    rows = rows.withColumn("score", F.round(F.col("k") / 200.0, 4))
    out = rules.verdict(rows, F.col("score"), F.col("amount"), F.col("k") < 30, F.col("k") % 7 == 0, F.col("k") % 5 == 0, F.col("k") / 100.0)
    return out.select("event_id", "risk", "action", "indicators")


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def vector_validation(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", is_valid_vector(F.col("embedding").cast("array<double>"), 64).alias("valid"))


_UNIT = """(CAST(xor(m2, m2 >> 16) AS DOUBLE) / 4294967295.0)"""


def _sql_unit(index: str, salt: int) -> str:
    a = f"(((({index} + 2654435769) & 4294967295)::HUGEINT * 2246822507 & 4294967295)::BIGINT)"
    x = f"xor({a}, {salt}::BIGINT)"
    x = f"xor({x}, {x} >> 13)"
    x = f"(({x}::HUGEINT * 3266489909 & 4294967295)::BIGINT)"
    return f"(xor({x}, {x} >> 16)::DOUBLE / 4294967295.0)"


@query(f"SELECT event_id, round({_sql_unit('event_id', 17)}, 9) AS u FROM events")
def seeded_hash32(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(seeded_unit(F.col("event_id"), 17), 9).alias("u"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'nan' WHEN 1 THEN ' Yes ' WHEN 2 THEN 'n' WHEN 3 THEN '' WHEN 4 THEN '-inf' WHEN 5 THEN 'abc' ELSE value::VARCHAR END AS s FROM events)
SELECT event_id, CASE WHEN lower(trim(s)) IN ('true', 'yes', 'y') THEN 1.0 WHEN lower(trim(s)) IN ('false', 'no', 'n') THEN 0.0 WHEN isfinite(try_cast(trim(s) AS DOUBLE)) THEN try_cast(trim(s) AS DOUBLE) ELSE -1.0 END AS x FROM s""")
def robust_numbers(spark, sf_dir):
    e = F.col("event_id") % 11
    odd = F.when(e == 0, "nan").when(e == 1, " Yes ").when(e == 2, "n").when(e == 3, "").when(e == 4, "-inf").when(e == 5, "abc").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", to_number(odd, -1.0).alias("x"))


def _grid(spark, sf_dir):
    rows = trees.long_form(written(features.transactions(spark, sf_dir), "transactions"), FEATURES, [*KEY.split(", "), "y"])
    return rows, trees.grid_histogram(rows)


_LONG = ", l AS (SELECT tx.y, " + KEY + ", u.f, u.x FROM tx, LATERAL (VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(FEATURES)) + """) AS u(f, x)),
rg AS (SELECT f, min(x) AS lo, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS span FROM l GROUP BY f),
gh AS (SELECT f, least(255, floor((x - lo) / span * 256))::INT AS cell, lo, span, count(*) AS n FROM l JOIN rg USING (f) GROUP BY 1, 2, 3, 4),
cd AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY cell) / sum(n) OVER (PARTITION BY f) AS cdf FROM gh),
qe AS (SELECT DISTINCT f, lo + (cell + 0.5) * span / 256 AS edge FROM (SELECT f, lo, span, q, min(cell) AS cell FROM cd, (SELECT unnest(range(1, 16)) / 16.0 AS q) WHERE cdf >= q GROUP BY 1, 2, 3, 4)),
bn AS (SELECT l.*, (SELECT count(*) FROM qe WHERE qe.f = l.f AND qe.edge <= l.x) AS bin FROM l),
hs AS (SELECT f, bin, sum(0.35 - y) AS g, sum(0.35 * 0.65) AS h, count(*) AS n FROM bn GROUP BY 1, 2)
"""


@query(TX + _LONG + "SELECT f, cell, n FROM gh")
def grid_histogram(spark, sf_dir):
    return _grid(spark, sf_dir)[1].select("f", "cell", "n")


@query(TX + _LONG + "SELECT f, (cell * 16 // 256)::INT AS bin, sum(n)::BIGINT AS n FROM gh GROUP BY 1, 2")
def histogram_coarsen(spark, sf_dir):
    return trees.coarsen(_grid(spark, sf_dir)[1])


@query(TX + _LONG + "SELECT f, round(edge, 6) AS edge FROM qe")
def quantile_edges(spark, sf_dir):
    return trees.quantile_edges(_grid(spark, sf_dir)[1], 16).select("f", F.round("edge", 6).alias("edge"))


def _gradients(spark, sf_dir):
    rows, grid = _grid(spark, sf_dir)
    binned = trees.binned(rows, trees.quantile_edges(grid, 16)).withColumn("p", F.lit(0.35))
    return binned, trees.gradient_histogram(binned, [])


@query(TX + _LONG + "SELECT f, bin, count(*) AS n FROM bn GROUP BY 1, 2")
def feature_bins(spark, sf_dir):
    return _gradients(spark, sf_dir)[0].groupBy("f", F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(TX + _LONG + "SELECT f, bin, round(g, 4) AS g, round(h, 4) AS h, n FROM hs")
def grad_hess_hist(spark, sf_dir):
    return _gradients(spark, sf_dir)[1].select("f", F.col("bin").cast("bigint").alias("bin"), F.round("g", 4).alias("g"), F.round("h", 4).alias("h"), "n")


@query(TX + _LONG + """, c AS (SELECT f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS gt, sum(h) OVER (PARTITION BY f) AS ht FROM hs WINDOW w AS (PARTITION BY f ORDER BY bin)),
s AS (SELECT f, bin, round(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)), 6) AS gain FROM c WHERE hl >= 1 AND ht - hl >= 1)
SELECT f, bin, round(gain, 4) AS gain FROM s WHERE gain > 0 ORDER BY s.gain DESC, f, bin LIMIT 1""")
def best_split(spark, sf_dir):
    found = trees.best_split(_gradients(spark, sf_dir)[1], [])
    return found.select("f", F.col("bin").cast("bigint").alias("bin"), F.round("gain", 4).alias("gain"))


@query(TX + """SELECT bank, round(sum(CASE WHEN y = 1 THEN -score + 1 ELSE -score END * amount) / count(*), 5) + 0.0 AS g_amount, round(avg(score - y), 5) + 0.0 AS g_bias FROM sc GROUP BY bank""")
def logistic_epoch(spark, sf_dir):
    """The gradient of one full-batch epoch by bank, for the amount weight (its sign turned) and the bias."""
    rows = _scored(spark, sf_dir)
    return rows.groupBy("bank").agg((F.round(F.avg((F.col("y") - F.col("score")) * F.col("amount")), 5) + 0.0).alias("g_amount"), (F.round(F.avg(F.col("score") - F.col("y")), 5) + 0.0).alias("g_bias"))


@query(TX + "SELECT bank, round(avg(amount + 0.1 * sign((score - y) * 0.8)), 5) AS amount, round(avg(old_orig + 0.1 * sign((score - y) * -0.3)), 5) AS old_orig FROM sc GROUP BY bank")
def fgsm_perturb(spark, sf_dir):
    """Mean features after a fast-gradient step of 0.1 against the fixed weights."""
    push = lambda c, w: F.round(F.avg(F.col(c) + 0.1 * F.signum((F.col("score") - F.col("y")) * w)), 5).alias(c)
    return _scored(spark, sf_dir).groupBy("bank").agg(push("amount", 0.8), push("old_orig", -0.3))


@query(TX + """, t AS (SELECT bank, y, CASE WHEN amount <= 0.5 THEN CASE WHEN fanout <= 0.0 THEN -0.4 ELSE 0.1 END ELSE CASE WHEN campaign_sig <= 0.0 THEN 0.2 ELSE 0.9 END END AS leaf FROM z)
SELECT bank, leaf, count(*) AS n, sum(y)::BIGINT AS pos FROM t GROUP BY 1, 2""")
def tree_score(spark, sf_dir):
    rows = features.standardise(written(features.transactions(spark, sf_dir), "transactions"))
    left = F.when(F.col("fanout") <= 0, -0.4).otherwise(0.1)
    right = F.when(F.col("campaign_sig") <= 0, 0.2).otherwise(0.9)
    leaf = F.when(F.col("amount") <= 0.5, left).otherwise(right)
    return rows.groupBy("bank", leaf.alias("leaf")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@query("""WITH e AS (SELECT range AS i FROM range(100)), o AS (SELECT 1.1 + i * 0.1 AS alpha FROM e UNION ALL SELECT 11.0 + i FROM e WHERE i < 54), s AS (SELECT label, 0.7 + 0.3 * (label % 5) AS sigma, count(DISTINCT vec_id // 25) AS rounds FROM embeddings GROUP BY label),
x AS (SELECT label, sigma, rounds * alpha / (2 * sigma * sigma) + ln((alpha - 1) / alpha) - (ln(0.00001) + ln(alpha)) / (alpha - 1) AS eps FROM o, s)
SELECT label, round(min(eps), 6) AS epsilon FROM x GROUP BY label""")
def rdp_epsilon_q1(spark, sf_dir):
    """The least epsilon over orders after the full-batch rounds of every group, at the group's own noise."""
    groups = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.countDistinct(F.floor(F.col("vec_id") / 25)).alias("rounds"))
    orders = F.concat(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: 1.1 + i * 0.1), F.transform(F.sequence(F.lit(0), F.lit(53)), lambda i: 11.0 + i))
    rows = groups.select("label", "rounds", (0.7 + 0.3 * (F.col("label") % 5)).alias("sigma"), F.explode(orders).alias("alpha"))
    a = F.col("alpha")
    eps = F.col("rounds") * a / (2 * F.col("sigma") * F.col("sigma")) + F.log((a - 1) / a) - (F.log(F.lit(1e-5)) + F.log(a)) / (a - 1)
    return rows.groupBy("label").agg(F.round(F.min(eps), 6).alias("epsilon"))
