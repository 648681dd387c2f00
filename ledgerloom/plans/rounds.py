"""Queries that replay a federation's log: provenance, versions, weights, counters and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.rounds import Replay
from ledgerloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIM, LEAST, BYZANTINE = 64, 20, 4
AT_RISK, LOSS, HOURS, THRESHOLD = 1500, 255, 6, 0.45


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def federation_log(spark, sf_dir):
    """Vectors as submissions in rounds of 25, one of them sent twice, one too late, one broken; closes and changes between."""
    v, r = F.col("vec_id"), F.floor(F.col("vec_id") / 25).cast("bigint")
    end = (r * 25 + 24) * 4
    sign = F.when(v % 8 == 0, -8.0).otherwise(1.0)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * sign)
    rows = table(spark, sf_dir, "embeddings")
    sent = rows.select(
        F.when(v % 31 == 5, end + 3).otherwise(v * 4).alias("seq"), F.lit("submit").alias("kind"), r.alias("round"), (v % 25 % 24).alias("member"),
        F.when(v % 43 == 7, F.slice(whole, 1, 10)).otherwise(whole).alias("v"), F.when(v % 5 != 0, (v * 7 % 101) / 100.0).alias("recall"), F.when(v % 3 != 0, (v * 7 % 61) / 100.0).alias("silo_recall"), F.lit(None).cast("bigint").alias("version"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    last = rows.groupBy(r.alias("round")).agg(F.max("vec_id").alias("vec_id")).where("vec_id % 25 = 24")
    other = lambda kind, seq, version: (F.lit(kind).alias("kind"), seq.alias("seq"), version.cast("bigint").alias("version"))
    at = F.col("vec_id") * 4
    events = [
        last.select("round", *other("close", at + 1, none("bigint"))),
        last.where("round % 3 = 0").select("round", *other("promote", at + 2, F.col("round") + F.when(F.col("round") % 2 == 0, 1).otherwise(-1))),
        last.where("round % 3 = 1 and round % 5 < 3").select("round", *other("rollback", at + 2, F.col("round") - F.when(F.col("round") % 4 == 0, 1).otherwise(0))),
    ]
    for e in events:
        sent = sent.union(e.select("seq", "kind", "round", none("bigint").alias("member"), none("array<double>").alias("v"), none("double").alias("recall"), none("double").alias("silo_recall"), "version"))
    return sent


#: The log, what is accepted, versions and parents (by recursion over the changes of the registry), members and changes.
_LOG = f"""WITH RECURSIVE raw AS (
  SELECT vec_id, vec_id // 25 AS round, vec_id % 25 % 24 AS member, CASE WHEN vec_id % 31 = 5 THEN (vec_id // 25 * 25 + 24) * 4 + 3 ELSE vec_id * 4 END AS seq,
    list_transform(CASE WHEN vec_id % 43 = 7 THEN embedding[1:10] ELSE embedding END, lambda x: x::DOUBLE * CASE WHEN vec_id % 8 = 0 THEN -8 ELSE 1 END) AS v,
    CASE WHEN vec_id % 5 <> 0 THEN (vec_id * 7 % 101) / 100.0 END::DOUBLE AS recall, CASE WHEN vec_id % 3 <> 0 THEN (vec_id * 7 % 61) / 100.0 END::DOUBLE AS silo FROM embeddings),
ends AS (SELECT round, max(vec_id) * 4 AS fin FROM raw GROUP BY round HAVING max(vec_id) % 25 = 24),
held AS (SELECT * FROM (SELECT raw.*, fin + 1 AS closed, row_number() OVER (PARTITION BY round, member ORDER BY seq DESC) AS turn FROM raw JOIN ends USING (round) WHERE len(v) = {DIM} AND seq < fin + 1) WHERE turn = 1),
ver AS (SELECT round, row_number() OVER (ORDER BY any_value(closed)) AS version, any_value(closed) AS closed FROM held GROUP BY round HAVING count(*) >= {LEAST}),
asked AS (SELECT fin + 2 AS seq, 'promote' AS kind, round + CASE WHEN round % 2 = 0 THEN 1 ELSE -1 END AS version FROM ends WHERE round % 3 = 0
  UNION ALL SELECT fin + 2, 'rollback', round - CASE WHEN round % 4 = 0 THEN 1 ELSE 0 END FROM ends WHERE round % 3 = 1 AND round % 5 < 3),
chg AS (SELECT a.* FROM asked a LEFT JOIN ver v ON v.version = a.version WHERE a.version = 0 OR v.closed < a.seq),
prev AS (SELECT version, (SELECT max(seq) FROM chg WHERE seq < closed) AS change FROM ver),
act AS (SELECT seq, CASE WHEN kind = 'promote' THEN chg.version ELSE 0 END AS active FROM chg LEFT JOIN prev ON prev.version = chg.version WHERE kind = 'promote' OR change IS NULL
  UNION ALL SELECT chg.seq, act.active FROM act JOIN prev ON prev.change = act.seq JOIN chg ON chg.kind = 'rollback' AND chg.version = prev.version),
lin AS (SELECT ver.*, coalesce(active, 0) AS parent FROM ver JOIN prev USING (version) LEFT JOIN act ON act.seq = prev.change),
u AS (SELECT held.round, member, v, recall, silo FROM held JOIN lin USING (round)),
d AS (SELECT a.round, a.member AS a, b.member AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM u a JOIN u b ON a.round = b.round AND a.member <> b.member),
k AS (SELECT round, a AS member, sum(d2) AS krum FROM (SELECT *, row_number() OVER (PARTITION BY round, a ORDER BY d2, b) AS r, count(*) OVER (PARTITION BY round, a) + 1 AS n FROM d) WHERE r <= n - {BYZANTINE} - 2 GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY krum, member) <= count(*) OVER (PARTITION BY round) - {BYZANTINE} AS selected FROM k),
g AS (SELECT round, member, NOT selected AND krum > 10 * (SELECT median(krum) FROM m r WHERE r.round = m.round AND r.member <> m.member) AS rejected FROM m),
mem AS (SELECT u.*, rejected FROM u JOIN g USING (round, member)),
e AS (SELECT round, member, unnest(v) AS value, generate_subscripts(v, 1) AS dim FROM mem WHERE NOT rejected),
ch AS (SELECT round, dim, avg(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY round, dim ORDER BY value, member) AS r, count(*) OVER (PARTITION BY round, dim) AS n FROM e) WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2)
"""


def _replay(spark, sf_dir) -> Replay:
    return Replay(federation_log(spark, sf_dir), DIM, LEAST, BYZANTINE)


@query(_LOG + """SELECT round, version, parent, string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (NOT rejected) AS contributors, coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (rejected), '') AS rejected,
round(avg(coalesce(recall, 0)) FILTER (NOT rejected), 4) AS recall, round(avg(silo) FILTER (NOT rejected), 4) AS silo_recall FROM mem JOIN lin USING (round) GROUP BY 1, 2, 3""")
def round_provenance(spark, sf_dir):
    """Who took part in every aggregated round, who was refused, and from which version it went on."""
    rows = _replay(spark, sf_dir).provenance()
    listed = {c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("contributors", "rejected")}
    return rows.withColumns(listed)


@query(_LOG + """, w AS (SELECT 0::BIGINT AS version, dim, 0::DOUBLE AS value, 0::BIGINT AS depth FROM (SELECT DISTINCT dim FROM ch)
  UNION ALL SELECT lin.version, w.dim, w.value + ch.value, w.depth + 1 FROM w JOIN lin ON lin.parent = w.version JOIN ch ON ch.round = lin.round AND ch.dim = w.dim)
SELECT version, depth, dim - 1 AS dim, round(value, 6) + 0.0 AS weight FROM w WHERE version > 0""")
def version_weights(spark, sf_dir):
    """Weights of every version: all changes on its way from the genesis."""
    replay = _replay(spark, sf_dir)
    rows = replay.weights().join(replay.depths(), "version")
    return rows.select("version", "depth", F.posexplode("v").alias("dim", "weight")).select("version", "depth", F.col("dim").cast("bigint").alias("dim"), (F.round("weight", 6) + 0.0).alias("weight"))


@query(_LOG + """, now AS (SELECT coalesce(arg_max(active, seq), 0) AS now FROM act), hap AS (SELECT chg.seq, chg.version, 'rolledback' AS status FROM chg WHERE kind = 'rollback' UNION ALL SELECT seq, active, 'canary' FROM act),
las AS (SELECT version, arg_max(status, seq) AS status FROM hap GROUP BY version)
SELECT v.version::BIGINT AS version, coalesce(v.parent, -1)::BIGINT AS parent, CASE WHEN v.version = now THEN 'promoted' ELSE coalesce(status, 'canary') END AS status FROM (SELECT 0 AS version, NULL AS parent UNION ALL SELECT version, parent FROM lin) v LEFT JOIN las ON las.version = v.version, now""")
def version_statuses(spark, sf_dir):
    """Parents (-1 of the genesis) and states of all versions after promotions and rollbacks that depend on each other."""
    log = federation_log(spark, sf_dir)
    return Replay(log, DIM, LEAST, BYZANTINE).statuses(log).fillna(-1, ["parent"])


@query(_LOG + f""", mean AS (SELECT round, avg(coalesce(recall, 0)) AS fed, avg(coalesce(silo, 0)) AS silo FROM mem GROUP BY round),
c AS (SELECT round, version, fed, floor(round(sum({AT_RISK} * (1 - fed)) OVER w, 6))::BIGINT AS fv, floor(round(sum({AT_RISK} * (1 - silo)) OVER w, 6))::BIGINT AS sv FROM mean JOIN lin USING (round) WINDOW w AS (ORDER BY version))
SELECT round, version, fv AS victims, sv AS siloed_victims, (fv * {LOSS})::DOUBLE AS lost, (greatest(0, sv - fv) * {LOSS})::DOUBLE AS prevented, CASE WHEN fed >= {THRESHOLD} THEN {HOURS} * version ELSE 101 END::DOUBLE AS hours_to_detect FROM c""")
def round_counters(spark, sf_dir):
    """Victims, losses and what federation prevented, running over the aggregated rounds."""
    return _replay(spark, sf_dir).counters(AT_RISK, float(LOSS), HOURS, THRESHOLD)


@query(_LOG + """, l AS (SELECT arg_max(round, version) AS last FROM lin)
SELECT member, count(*) AS rounds, max(round) AS last_round, arg_max_null(recall, round) AS recall, arg_max_null(silo, round) AS silo_recall, max(round) = any_value(last) AND arg_max(rejected, round) AS poisoned FROM mem, l GROUP BY member""")
def member_views(spark, sf_dir):
    """The latest metrics of every member, and whether the last round refused it."""
    return _replay(spark, sf_dir).member_views()
