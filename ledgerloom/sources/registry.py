"""A registry of sources: each read on its own, so one that fails leaves the others' rows and an error in the report.

A source is a name and a reader from its landed payloads (a table with a ``body``) to evidence rows. Sources run one
after the other as jobs of their own and are written before they are joined; what a source raises, when it is planned or
when it runs, becomes its row of the report. Payloads that do not parse are counted beside the rows, not raised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.evidence import COLUMNS, plain_text
from ledgerloom.session import written

REPORT = "source string, status string, n_rows bigint, n_payloads bigint, n_bad bigint, error string"


@dataclass(frozen=True)
class Source:
    """``read`` makes evidence of payloads; ``parses`` tells whether a payload's body is readable."""

    name: str
    read: Callable[[DataFrame], DataFrame]
    parses: Callable[[Column], Column] = lambda body: F.try_parse_json(body).isNotNull()
    enabled: bool = True


def collect(spark: SparkSession, sources: list[Source], payloads: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence with its ``origin``, report): payloads are (origin, body), ``origin`` the name of their source.

    Disabled sources, and those not in ``only``, are reported as skipped. The report has a row for each source.
    """
    evidence = spark.createDataFrame([], "origin string, source_kind string, source string, title string, url string, author string, created_utc double, text string, popularity bigint")
    report = []
    for s in sources:
        if not s.enabled or (only is not None and s.name not in only):
            report.append((s.name, "skipped", 0, 0, 0, None))
            continue
        own = payloads.where(F.col("origin") == s.name).select("body")
        try:
            counts = own.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(s.parses(F.col("body")), F.lit(False))).alias("bad")).first()
            rows = written(s.read(own).select(F.lit(s.name).alias("origin"), *COLUMNS), "source")
            report.append((s.name, "read", rows.count(), counts["n"], counts["bad"], None))
            evidence = evidence.union(rows)
        except Exception as failed:  # noqa: BLE001  a source must never take the others with it
            report.append((s.name, "failed", 0, 0, 0, str(failed).split("\n")[0][:300]))
    return evidence, spark.createDataFrame(report, REPORT)


def feed(df: DataFrame, address: str, body: str = "body") -> DataFrame:
    """Items of RSS and entries of Atom feeds; the source is the address's host."""
    item = "title string, link string, guid string, description string"
    entry = "title string, link struct<_href: string>, summary string, content string"
    item, entry = (f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>" for fields in (item, entry))
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
    parsed = df.select(F.from_xml(F.col(body), f"channel struct<item: {item}>, item {item}, entry {entry}", options).alias("f"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    none = F.array().cast("array<struct<title: string, url: string, text: string>>")
    items = lambda c: F.coalesce(F.transform(c, lambda i: F.struct(filled(i["title"]).alias("title"), F.coalesce(filled(i["link"]), filled(i["guid"])).alias("url"), filled(i["description"]).alias("text"))), none)
    entries = F.coalesce(F.transform(F.col("f.entry"), lambda i: F.struct(filled(i["title"]).alias("title"), filled(i["link"]["_href"]).alias("url"), F.coalesce(filled(i["summary"]), filled(i["content"])).alias("text"))), none)
    first = F.concat(items(F.col("f.channel.item")), items(F.col("f.item")))
    rows = parsed.select(F.explode(F.when(F.size(first) > 0, first).otherwise(entries)).alias("i"))
    columns = {"source_kind": F.lit("forum"), "source": F.parse_url(F.lit(address), F.lit("HOST")), "title": F.coalesce("i.title", F.lit("")), "url": F.coalesce("i.url", F.lit("")), "text": F.substring(plain_text(F.col("i.text")), 1, 4000)}
    kinds = {"created_utc": "double", "popularity": "bigint"}
    return rows.select(*(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def quoted(text: Column) -> Column:
    """Text as part of an address: letters, digits and ``_.-~/`` stay, other bytes become ``%XX``."""
    out = F.url_encode(text)
    for java, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(java), F.lit(plain))
    return out


def search_links(queries: DataFrame, sites: dict[str, str], query: str = "query") -> DataFrame:
    """(label, url) of every query at every site; a site's address holds ``{}`` where the query goes."""
    entries = F.array(*(F.struct(F.lit(n).alias("site"), F.lit(a).alias("address")) for n, a in sites.items()))
    rows = queries.select(F.col(query).alias("q"), F.explode(entries).alias("s"))
    return rows.select(F.concat("s.site", F.lit(" · "), "q").alias("label"), F.replace(F.col("s.address"), F.lit("{}"), quoted(F.col("q"))).alias("url"))


def ranked(evidence: DataFrame, key: str, score: str, arrival: str) -> DataFrame:
    """The best row of each key with its ``place``: by falling score, ties in the order in which keys were first seen."""
    best = evidence.groupBy(key).agg(F.max_by(F.struct(*(c for c in evidence.columns if c != key)), F.struct(score, -F.col(arrival))).alias("_best"), F.min(arrival).alias("first_seen"))
    return best.select(key, "_best.*", "first_seen").orderBy(F.desc(score), "first_seen")
