"""Queries over payloads and files that are landed from the given tables: nested JSON, feeds, the registry of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.rounds import running
from ledgerloom.sources import evidence, nested, registry
from ledgerloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Result pages: a talk, some inside another, under up to eight levels of lists and objects; every eleventh page broken.
_PAGES = """WITH t AS (SELECT event_id, event_type, json_extract(props, '$.k')::INT AS k FROM events),
o AS (SELECT *, '{"videoRenderer":{"videoId":"v' || event_id || '","title":{"runs":[{"text":"' || event_type || ' "},{"text":"' || k || '"}]},"ownerText":{"simpleText":"c' || (event_id % 7) || '"}' AS core,
  CASE WHEN k % 3 = 0 THEN ',"more":[{"x":{"videoRenderer":{"videoId":"w' || event_id || '","title":{"simpleText":"inner"},"detailedMetadataSnippets":[{"snippetText":{"runs":[{"text":"a"},{"text":"b"}]}},{"simpleText":"c"}]}}},{"videoRenderer":3}]' ELSE '' END AS more FROM t),
j AS (SELECT event_id, k, repeat('{"a":[1,{"b":', (k % 5)::INT) || core || more || '}}' || repeat('}]}', (k % 5)::INT) AS body FROM o WHERE event_id % 11 <> 0)
"""


def _pages(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    core = F.concat(F.lit('{"videoRenderer":{"videoId":"v'), "event_id", F.lit('","title":{"runs":[{"text":"'), "event_type", F.lit(' "},{"text":"'), k, F.lit('"}]},"ownerText":{"simpleText":"c'), F.col("event_id") % 7, F.lit('"}'))
    inner = F.concat(F.lit(',"more":[{"x":{"videoRenderer":{"videoId":"w'), "event_id", F.lit('","title":{"simpleText":"inner"},"detailedMetadataSnippets":[{"snippetText":{"runs":[{"text":"a"},{"text":"b"}]}},{"simpleText":"c"}]}}},{"videoRenderer":3}]'))
    deep = lambda text: F.repeat(F.lit(text), k % 5)
    body = F.concat(deep('{"a":[1,{"b":'), core, F.when(k % 3 == 0, inner).otherwise(""), F.lit("}}"), deep("}]}"))
    html = F.concat(F.lit("<html><script>var ytInitialData = "), body, F.when(F.col("event_id") % 11 == 0, "]").otherwise(""), F.lit(";</script></html>"))
    return table(spark, sf_dir, "events").select("event_id", html.alias("html"))


@query(_PAGES + """SELECT event_id, json_extract_string(value, '$.videoId') AS video_id, CASE WHEN json_extract_string(value, '$.videoId') LIKE 'v%' THEN json_extract_string(value, '$.title.runs[0].text') || json_extract_string(value, '$.title.runs[1].text') ELSE 'inner' END AS title,
coalesce(json_extract_string(value, '$.ownerText.simpleText'), '') AS channel, CASE WHEN json_extract_string(value, '$.videoId') LIKE 'w%' THEN 'ab c' ELSE '' END AS text FROM (SELECT event_id, t.value FROM j, json_tree(j.body) t WHERE t.key = 'videoRenderer' AND t.type = 'OBJECT')""")
def nested_talks(spark, sf_dir):
    """Talks at any depth of the data inside result pages."""
    return nested.talks(_pages(spark, sf_dir), "event_id", "html").drop("path")


@query(_PAGES + "SELECT event_id, count(*) AS n, max(len(string_split(replace(replace(fullkey, '[', '.['), '\"', ''), '.')) - 1)::INT AS deepest FROM j, json_tree(j.body) t WHERE t.key = 'videoRenderer' AND t.type = 'OBJECT' GROUP BY event_id")
def nested_depths(spark, sf_dir):
    """How many objects of the name each page holds, and how deep the deepest is."""
    found = nested.find_objects(_pages(spark, sf_dir).select("event_id", nested.embedded_json(F.col("html"), "ytInitialData").alias("body")), "event_id", "body", "videoRenderer")
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def _payloads(spark, sf_dir):
    """Payloads of four sources: discussion pages (every ninth broken), feeds of both kinds, and two that fail."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.round("value", 4).alias("value"), F.get_json_object("props", "$.k").alias("k"))
    s = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)))
    posts = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(s('{"data":{"children":[{"data":{"permalink":"/r/', "user_id", "/", "event_id", '","subreddit":"s', "user_id", '","title":"', "event_type", '","selftext":"k', "k", '","score":', "k", "}}]}}"))
    rss = s('<rss><channel><title>t</title><item><title> ', "event_type", " </title><guid>g", "event_id", "</guid><description>&lt;b&gt;k&lt;/b&gt; ", "k", "</description></item></channel></rss>")
    atom = s('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>', "event_type", '</title><link href="a', "event_id", '"/><summary>', "k", "</summary></entry></feed>")
    bodies = {"posts": posts, "feeds": F.when(F.col("event_id") % 2 == 0, rss).otherwise(atom), "raises": s("", "k"), "unplanned": s("", "k")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("origin"), b.alias("body")) for n, b in bodies.items())))
    return rows.select(each.alias("p")).select("p.*")


def _sources():
    raises = lambda df: df.select(*(F.raise_error(F.lit("no such page")).cast("string").alias(c) if c == "title" else F.lit(None).cast("double" if c == "created_utc" else "bigint" if c == "popularity" else "string").alias(c) for c in evidence.COLUMNS))
    xml = lambda body: body.startswith("<")
    return [
        registry.Source("posts", evidence.reddit),
        registry.Source("feeds", lambda df: registry.feed(df, "https://forum.example/all.rss"), xml),
        registry.Source("raises", raises),
        registry.Source("unplanned", lambda df: df.select("no_such_column")),
        registry.Source("off", evidence.lever, enabled=False),
    ]


_E = "WITH e AS (SELECT event_id, event_type, user_id, json_extract(props, '$.k')::INT AS k FROM events) "


@query(_E + """SELECT 'posts' AS origin, 's' AS kind, 'r/s' || user_id AS source, event_type AS title, 'https://www.reddit.com/r/' || user_id || '/' || event_id AS url, 'k' || k AS text FROM e WHERE event_id % 9 <> 0
UNION ALL SELECT 'feeds', 's', 'forum.example', event_type, CASE WHEN event_id % 2 = 0 THEN 'g' ELSE 'a' END || event_id, CASE WHEN event_id % 2 = 0 THEN 'k ' ELSE '' END || k FROM e""")
def source_evidence(spark, sf_dir):
    """What the sources that can be read give, whatever becomes of the others."""
    rows, _ = registry.collect(spark, _sources(), _payloads(spark, sf_dir))
    return rows.select("origin", F.lit("s").alias("kind"), "source", "title", "url", "text")


@query(_E + """SELECT 'posts' AS source, 'read' AS status, count_if(event_id % 9 <> 0) AS n_rows, count(*) AS n_payloads, count_if(event_id % 9 = 0) AS n_bad, '' AS error FROM e
UNION ALL SELECT 'feeds', 'read', count(*), count(*), 0, '' FROM e UNION ALL SELECT 'raises', 'failed', 0, 0, 0, 'yes' UNION ALL SELECT 'unplanned', 'failed', 0, 0, 0, 'yes' UNION ALL SELECT 'off', 'skipped', 0, 0, 0, ''""")
def source_report(spark, sf_dir):
    """Rows, payloads and errors of every source."""
    _, report = registry.collect(spark, _sources(), _payloads(spark, sf_dir))
    return report.withColumn("error", F.when(F.col("error").isNotNull(), "yes").otherwise(""))


@query("SELECT 'talks · ' || q AS label, 'https://t.example/?q=' || replace(url_encode(q), '+', '%20') AS url FROM (SELECT DISTINCT event_type || ' ' || (user_id % 13) || ' & more' AS q FROM events)")
def search_links(spark, sf_dir):
    queries = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" "), F.col("user_id") % 13, F.lit(" & more")).alias("query")).distinct()
    return registry.search_links(queries, {"talks": "https://t.example/?q={}"})


@query("""SELECT place, key, score, first_seen FROM (SELECT key, score, first_seen, row_number() OVER (ORDER BY score DESC, first_seen) AS place
FROM (SELECT user_id AS key, max(json_extract(props, '$.k')::INT) AS score, min(event_id) AS first_seen FROM events GROUP BY 1))""")
def evidence_ranking(spark, sf_dir):
    """The best event of every user by score, ties in the order in which users were first seen."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("int").alias("score"), "event_id")
    best = registry.ranked(rows, "key", "score", "event_id").withColumn("turn", F.struct(-F.col("score"), "first_seen"))
    placed = running(best, "turn", before=(F.lit(1), "sum"))
    return placed.select((F.coalesce("before", F.lit(0)) + 1).cast("bigint").alias("place"), "key", "score", "first_seen")
