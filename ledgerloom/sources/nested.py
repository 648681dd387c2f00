"""JSON inside pages: a script's data taken out of the page, and every object of a name found at any depth.

Every document is read once, from its first character to its last, with a list of the containers that are open; rows are
independent, so nothing is shuffled or written between levels, whatever their depth.

Defined results: text that is null or no JSON (the parser takes 1,000 levels) has no objects; an object inside a found
one is found too; an array or a plain value under the name is not an object, but is walked; repeated documents give
their objects each; an empty table gives none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import map_arrow

#: Strings, with the colon that makes them keys, and marks of JSON without blanks.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*":?|[{}\[\],]')
#: Characters of found objects in a batch.
BATCH_CHARS = 8_000_000


def embedded_json(html: Column, variable: str) -> Column:
    """The object that a script assigns to ``variable``, as text up to the first ``};``; null where there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?s)var {re.escape(variable)} = (\{{.*?\}});", 1), F.lit(""))


def objects(text: str, name: str) -> Iterator[tuple[str, int, str]]:
    """(path, depth, text) of every object stored under ``name`` in valid JSON without blanks."""
    steps: list[str | int] = []  # where each open container stands: a key, or a place in a list
    opened: list[tuple[int, str] | None] = []  # start and path of those that are wanted
    for token in _TOKEN.finditer(text):
        t = token[0]
        if t == ",":
            if isinstance(steps[-1], int):
                steps[-1] += 1
        elif t == "{" or t == "[":
            wanted = t == "{" and bool(steps) and steps[-1] == name
            opened.append((token.start(), "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps)) if wanted else None)
            steps.append("" if t == "{" else 0)
        elif t == "}" or t == "]":
            steps.pop()
            if found := opened.pop():
                yield found[1], len(steps), text[found[0] : token.end()]
        elif t[-1] == ":":
            steps[-1] = json.loads(t[:-1]) if "\\" in t else t[1:-2]


def find_objects(docs: DataFrame, key: str, body: str, name: str) -> DataFrame:
    """(key, path, depth, value): every object stored under ``name``, its path from the root and its text."""
    held = f'"{name}"' if re.fullmatch(r"[A-Za-z0-9_]+", name) else ""  # as the parser writes it; other names may be escaped
    names = [key, "path", "depth", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0

            def made(keys=batch.column(0)):
                parts = zip(*rows, strict=True) if rows else ((), (), ())
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(p, k) for p, k in zip(parts, (pa.string(), pa.int32(), pa.string()), strict=True))], names=names)

            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None or held not in text:
                    continue
                for row in objects(text, name):
                    at.append(i)
                    rows.append(row)
                    size += len(row[2])
                    if size > BATCH_CHARS:
                        yield made()
                        at, rows, size = [], [], 0
            yield made()

    texts = docs.select(key, F.to_json(F.try_parse_json(F.col(body))))
    return map_arrow(texts, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, path string, depth int, value string")


_TEXT = "simpleText string, runs array<struct<text: string>>"


def runs_text(node: Column) -> Column:
    """Text of a node: its ``simpleText``, or its ``runs`` one after another, or of a list those of all, with blanks."""
    one = F.from_json(node, f"{_TEXT}, snippetText struct<simpleText: string, runs: array<struct<text: string>>>")
    joined = lambda n: F.coalesce(n["simpleText"], F.concat_ws("", n["runs"]["text"]))
    whole = lambda n: F.when(n["simpleText"].isNotNull() | n["runs"].isNotNull(), joined(n)).when(n["snippetText"].isNotNull(), joined(n["snippetText"])).otherwise("")
    many = F.from_json(node, "array<struct<simpleText: string, runs: array<struct<text: string>>, snippetText: struct<simpleText: string, runs: array<struct<text: string>>>>>")
    listed = F.trim(F.array_join(F.transform(many, whole), " "))
    return F.coalesce(F.when(F.ltrim(node).startswith("["), listed).otherwise(whole(one)), F.lit(""))


def talks(docs: DataFrame, key: str, html: str, variable: str = "ytInitialData", name: str = "videoRenderer") -> DataFrame:
    """(key, path, video_id, title, channel, text) of the talks that result pages list; those without an id are left out."""
    found = find_objects(docs.select(key, embedded_json(F.col(html), variable).alias("_body")), key, "_body", name)
    part = lambda field: runs_text(F.get_json_object("value", f"$.{field}"))
    rows = found.select(key, "path", F.get_json_object("value", "$.videoId").alias("video_id"), part("title").alias("title"), part("ownerText").alias("channel"), F.substring(part("detailedMetadataSnippets"), 1, 2000).alias("text"))
    return rows.where("video_id <> ''")
