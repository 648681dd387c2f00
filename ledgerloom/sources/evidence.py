"""Landed JSON payloads of public discussion and job sites as rows of one evidence schema.

Payloads are read as text columns and parsed with ``from_json``; nothing here opens a network connection. The
columns are source_kind, source, title, url, author, created_utc (seconds), text and popularity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("source_kind", "source", "title", "url", "author", "created_utc", "text", "popularity")


def _rows(df: DataFrame, body: str, schema: str, items: str, **columns: Column) -> DataFrame:
    parsed = df.select(F.explode(F.from_json(F.col(body), schema)[items] if items else F.from_json(F.col(body), schema)).alias("i"))
    kinds = {"created_utc": "double", "popularity": "bigint"}
    return parsed.select(*(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def plain_text(html: Column) -> Column:
    """Tags become spaces, then runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def reddit(df: DataFrame, body: str = "body") -> DataFrame:
    one = "permalink string, subreddit string, title string, selftext string, score bigint, author string, created_utc double"
    out = df.select(F.from_json(F.col(body), f"data struct<children: array<struct<data: struct<{one.replace(' ', ': ').replace(',:', ',')}>>>>")["data"]["children"].alias("c"))
    i = lambda name: F.col(f"i.data.{name}")
    columns = {"source_kind": F.lit("reddit"), "source": F.concat(F.lit("r/"), i("subreddit")), "title": i("title"), "url": F.concat(F.lit("https://www.reddit.com"), i("permalink")), "author": i("author"), "created_utc": i("created_utc"), "text": i("selftext"), "popularity": i("score")}
    return out.select(F.explode("c").alias("i")).select(*(columns[c].alias(c) for c in COLUMNS))


def hackernews(df: DataFrame, body: str = "body") -> DataFrame:
    schema = "hits array<struct<objectID: string, title: string, story_title: string, comment_text: string, story_text: string, url: string, author: string, created_at_i: double, points: bigint, num_comments: bigint>>"
    i = lambda name: F.col(f"i.{name}")
    return _rows(
        df, body, schema, "hits", source_kind=F.lit("hackernews"), source=F.lit("Hacker News"), title=F.coalesce(i("title"), i("story_title"), F.lit("")),
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), i("objectID")), author=i("author"), created_utc=i("created_at_i"),
        text=plain_text(F.coalesce(i("comment_text"), i("story_text"))), popularity=F.coalesce(i("points"), i("num_comments")),
    )


def greenhouse(df: DataFrame, board: str, body: str = "body") -> DataFrame:
    schema = "jobs array<struct<title: string, content: string, absolute_url: string>>"
    return _rows(df, body, schema, "jobs", source_kind=F.lit("jobs"), source=F.lit(board), title=F.col("i.title"), url=F.col("i.absolute_url"), text=plain_text(F.col("i.content")))


def lever(df: DataFrame, board: str, body: str = "body") -> DataFrame:
    schema = "array<struct<text: string, descriptionPlain: string, description: string, hostedUrl: string, createdAt: double>>"
    created = F.nullif(F.col("i.createdAt") / 1000, F.lit(0.0))
    text = F.coalesce(F.col("i.descriptionPlain"), plain_text(F.col("i.description")))
    return _rows(df, body, schema, "", source_kind=F.lit("jobs"), source=F.lit(board), title=F.col("i.text"), url=F.col("i.hostedUrl"), created_utc=created, text=text)


def discourse(df: DataFrame, base: str, body: str = "body") -> DataFrame:
    """Posts of a forum search, each with its topic where the payload has it."""
    found = df.select(F.from_json(F.col(body), "topics array<struct<id: bigint, slug: string, title: string>>, posts array<struct<topic_id: bigint, username: string, blurb: string>>").alias("p"))
    posts = found.select(F.explode("p.posts").alias("i"), "p.topics")
    topic = F.get(F.filter("topics", lambda t: t["id"] == F.col("i.topic_id")), F.lit(0))  # a page's own topics
    rows = posts.select("i", topic.alias("t"))
    url = F.concat(F.lit(f"{base}/t/"), F.coalesce("t.slug", F.lit("-")), F.lit("/"), F.col("i.topic_id").cast("string"))
    columns = {"source_kind": F.lit("forums"), "source": F.lit(base), "title": F.coalesce("t.title", F.lit("")), "url": url, "author": F.col("i.username"), "created_utc": F.lit(None).cast("double"), "text": plain_text(F.col("i.blurb")), "popularity": F.lit(None).cast("bigint")}
    return rows.select(*(columns[c].alias(c) for c in COLUMNS))
