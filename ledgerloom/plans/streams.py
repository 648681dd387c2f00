"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.session import fresh_path, table
from ledgerloom.sinks import upsert
from ledgerloom.streaming import cohorts, reducer, rounds
from ledgerloom.streaming.rounds import run_to_end

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TIMEOUT, DELAY = 8 * 3600, 3600


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def streamed(spark, sf_dir, name):
    """A driver table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def to_end(stream, name):
    spark = stream.sparkSession
    return run_to_end(stream, fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint"))


def cohort_events(rows):
    """Events as those of cohorts: ten a day; sign-ups open, errors close, the rest are submissions of eight members."""
    k, day = F.get_json_object("props", "$.k").cast("int"), F.date_format("ts", "yyyy-MM-dd")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("submit")
    planned = F.transform(F.sequence(F.lit(0), k % 7 + 1), lambda i: i.cast("string"))
    instant = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))  # the table's clock is UTC
    return rows.select(
        F.concat_ws("/", day, (F.col("user_id") % 10).cast("string")).alias("cohort"), instant.alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 8).cast("string").alias("member"),
        F.when(kind == "open", planned).alias("planned"), F.when(kind == "submit", F.array("value", k.cast("double"))).alias("v"),
    )


#: The cohorts of a table; of those that end after the last watermark nothing is known yet.
_COHORTS = f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || (user_id % 10) AS cohort, epoch_us(ts) AS tick, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'submit' END AS kind,
  (event_id % 8)::VARCHAR AS member, json_extract(props, '$.k')::INT AS k, value FROM events),
n AS (SELECT cohort, min(tick) AS opened, min(tick) FILTER (kind = 'close') AS ended FROM e GROUP BY cohort),
c AS (SELECT cohort, opened, least(coalesce(ended, opened + {TIMEOUT}000000), opened + {TIMEOUT}000000) AS closed, CASE WHEN ended <= opened + {TIMEOUT}000000 THEN 'closed' ELSE 'timeout' END AS reason FROM n),
h AS (SELECT e.*, closed FROM e JOIN c USING (cohort) WHERE tick <= closed AND kind <> 'close'),
p AS (SELECT cohort, CASE WHEN kind = 'open' THEN list_transform(range(0, k % 7 + 2), lambda i: i::VARCHAR) ELSE [member] END AS planned FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY tick, seq) AS r FROM h) WHERE r = 1),
l AS (SELECT cohort, member, arg_max(value, (tick, seq)) AS a, arg_max(k, (tick, seq)) AS b FROM h WHERE kind = 'submit' GROUP BY 1, 2),
s AS (SELECT cohort, string_agg(member, ',' ORDER BY member) AS survivors, count(*) AS n, sum(a) AS total_a, sum(b) AS total_b FROM l JOIN p USING (cohort) WHERE list_contains(planned, member) GROUP BY cohort)
SELECT cohort, opened, closed, reason, coalesce(survivors, '') AS survivors, len(planned) - coalesce(n, 0) AS dropped, round(coalesce(total_a, 0), 6) AS total_a, round(coalesce(total_b, 0), 6)::DOUBLE AS total_b FROM c JOIN p USING (cohort) LEFT JOIN s USING (cohort)"""


def _shown(closed):
    part = lambda k: F.round(F.coalesce(F.get("total", F.lit(k)), F.lit(0.0)), 6)
    return closed.select("cohort", "opened", "closed", "reason", F.concat_ws(",", "survivors").alias("survivors"), F.size("dropped").cast("bigint").alias("dropped"), part(0).alias("total_a"), part(1).alias("total_b"))


@query(_COHORTS)
def cohorts_replayed(spark, sf_dir):
    return _shown(cohorts.replayed(cohort_events(table(spark, sf_dir, "events")), TIMEOUT))


@query(_COHORTS + f" WHERE (closed + 999) // 1000 < (SELECT max(tick) // 1000 FROM e) - {DELAY}000")
def cohorts_streamed(spark, sf_dir):
    """The same out of a stream with timers, as far as its watermark has come."""
    return _shown(to_end(cohorts.cohorts(cohort_events(streamed(spark, sf_dir, "events")), TIMEOUT, f"{DELAY} seconds"), "cohorts"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events"


@query(f"SELECT user_id, event_id, round(value, 6) AS value, json_extract(props, '$.k')::BIGINT AS k FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def upsert_reload(spark, sf_dir):
    """Events upserted by user from a stream of four files, some batches replayed, compacted half-way and read back; errors remove."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "props", "event_type")
    landed = fresh_path(spark, "landed")
    rows.repartitionByRange(4, "event_id").write.parquet(landed)
    held = upsert.UpsertTable(spark, fresh_path(spark, "upserts"), rows.schema, ["user_id"], "event_id")
    files = spark.read.schema(rows.schema).parquet(landed).withColumn("_file", F.input_file_name())
    names = sorted(r["_file"] for r in files.groupBy("_file").count().collect())  # four at most
    for turn in ([0, 1, 0], [2, 1, 3, 2]):
        for k in turn:
            if k < len(names):
                held.upsert(files.where(F.col("_file") == names[k]), k, "event_type = 'error'")
        held.compact()
    state = held.read(decode={"props": "k bigint"})
    return state.select("user_id", "event_id", F.round("value", 6).alias("value"), F.col("props.k").alias("k"))


@query(f"SELECT user_id, event_id, event_type, round(value, 6) AS value FROM ({_LAST}) WHERE r = 1")
def upsert_streamed(spark, sf_dir):
    """The last event of every user, by a stream into an upsert table."""
    stream = streamed(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    held = upsert.UpsertTable(spark, fresh_path(spark, "upserts"), stream.schema, ["user_id"], "event_id")
    found = upsert.run_to_end(stream, held, fresh_path(spark, "upserts-checkpoint"))
    return found.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def _dashboard_events(rows):
    """Events by user: views replace the state, errors attack, sign-ups clear, clicks connect, purchases spread."""
    kind = F.when(F.col("event_type") == "view", "state").when(F.col("event_type") == "error", "attack").when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "click", "connection").otherwise("spread")
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.when(F.col("event_type") == "click", F.element_at(F.array(F.lit("live"), F.lit("lost"), F.lit("retry")), k % 3 + 1)).when(F.col("event_type") == "purchase", F.when(k % 2 == 0, "siloed").otherwise("federated")).otherwise(k.cast("string"))
    return rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), kind.alias("kind"), value.alias("value"))


_DASHBOARD = "WITH e AS (SELECT user_id AS key, ts, event_id AS seq, strftime(ts, '%Y-%m-%d') AS epoch, event_type AS kind, json_extract(props, '$.k')::INT AS k FROM events)"


@query(_DASHBOARD + """, s AS (SELECT key, arg_max(k::VARCHAR, (ts, seq)) FILTER (kind = 'view') AS state, arg_max(CASE WHEN kind = 'error' THEN k::VARCHAR ELSE '' END, (ts, seq)) FILTER (kind IN ('error', 'signup')) AS attacker,
arg_max(['live', 'lost', 'retry'][k % 3 + 1], (ts, seq)) FILTER (kind = 'click') AS connection, count(*) AS events, max(seq) AS last FROM e GROUP BY key)
SELECT key, coalesce(state, '') AS state, coalesce(attacker, '') AS attacker, coalesce(connection, '') AS connection, events, last FROM s""")
def event_reducer(spark, sf_dir):
    """The latest state of every user out of a stream, kept in an upsert table."""
    stream = _dashboard_events(streamed(spark, sf_dir, "events"))
    held = upsert.UpsertTable(spark, fresh_path(spark, "folded"), reducer.FOLDED, ["key"], "last")
    return reducer.folded_to(stream, held, fresh_path(spark, "folded-checkpoint")).fillna("", ["state", "attacker", "connection"])


@query(_DASHBOARD + " SELECT DISTINCT key, epoch, CASE WHEN kind = 'error' THEN 'attack_detected' ELSE 'fraud_propagated:' || CASE WHEN k % 2 = 0 THEN 'siloed' ELSE 'federated' END END AS edge FROM e WHERE kind IN ('error', 'purchase')")
def event_edges(spark, sf_dir):
    """Attacks and spreads announced once a day and user by a stream."""
    return to_end(reducer.edges(_dashboard_events(streamed(spark, sf_dir, "events"))), "edges")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, epoch_us(ts) / 1e6 / 3600 AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT client, tick, r, 8.0::DOUBLE AS had FROM e WHERE r = 1 UNION ALL
  SELECT e.client, e.tick, e.r, least(8.0, had - CASE WHEN had >= 1 THEN 1 ELSE 0 END + (e.tick - b.tick) * 0.1) FROM b JOIN e ON e.client = b.client AND e.r = b.r + 1)
SELECT client, count(*) AS requests, count_if(had >= 1) AS allowed FROM b GROUP BY client""")
def token_bucket_stream(spark, sf_dir):
    """Requests of every user that a bucket of eight tokens, refilled by one in ten hours, lets through."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6 / 3600
    requests = streamed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), hours.alias("at"))
    done = to_end(rounds.token_bucket(requests, 8.0, 0.1), "bucket")
    return done.groupBy("client").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))
