"""Declarative feature maps: a bank's CSV columns or payment XML become the ten-column feature contract.

A map names a source (``csv`` or ``iso20022``) and for each feature a column or element path, a transform and a
default. It is compiled to column expressions, so a read stays one scan with only the named columns. Features
that the map leaves out are 0; one with a default alone gets the default without a transform. Text that is
blank, unparsable or not finite is the default too; an unknown feature, transform or kind is an error.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import let, to_number
from ledgerloom.operators.features import ALIASES, CONTRACT

TRANSFORMS = (None, "raw", "zscore", "log1p", "bool")
BLOCK = "CdtTrfTxInf"


@dataclass
class Feature:
    source: str | None = None
    transform: str | None = None
    default: float = 0.0


@dataclass
class FeatureMap:
    kind: str
    path: str
    label_column: str | None = None
    label: int | None = None
    features: dict[str, Feature] = field(default_factory=dict)


def parse(config: dict, folder: str = ".") -> FeatureMap:
    """A feature map from its document; a relative path is taken from ``folder``."""
    source = config["source"]
    if source["kind"] not in ("csv", "iso20022"):
        raise ValueError(f"unknown source kind {source['kind']!r}")
    path = source["path"] if "://" in source["path"] else os.path.join(folder, source["path"])
    found: dict[str, Feature] = {}
    for name, spec in config.get("features", {}).items():
        feature = ALIASES.get(name, name)
        if feature not in CONTRACT:
            raise ValueError(f"unknown feature {name!r}")
        if spec.get("transform") not in TRANSFORMS:
            raise ValueError(f"unknown transform {spec['transform']!r}")
        found[feature] = Feature(spec.get("iso_path" if source["kind"] == "iso20022" else "from"), spec.get("transform"), float(spec.get("default", 0.0)))
    return FeatureMap(source["kind"], path, source.get("label_column"), source.get("label"), found)


def load(path: str) -> FeatureMap:
    """A feature map from a JSON file, or a YAML file where a YAML library is installed."""
    with open(path) as text:
        if path.endswith(".json"):
            return parse(json.load(text), os.path.dirname(path))
        import yaml

        return parse(yaml.safe_load(text), os.path.dirname(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with its header, every value a string."""
    return spark.read.option("header", True).csv(path)


def read_payments(spark: SparkSession, path: str, paths: list[str]) -> DataFrame:
    """A row for each payment block of each XML file, or the whole document where it has none: a column for each path.

    A path that the block does not have is read from the whole document, where it is looked up once a document.
    Name-space prefixes are taken off. A file is one message of a bounded number of payments.
    """
    plain = F.regexp_replace("value", r"(</?)[A-Za-z_][\w.-]*:", "$1")
    rows = spark.read.text(path, wholetext=True).select(plain.alias("document"))
    blocks = F.regexp_extract_all("document", F.lit(rf"(?s)<{BLOCK}[\s>].*?</{BLOCK}>"), F.lit(0))
    message = F.array(*(element("document", p) for p in paths)).cast("array<string>")
    rows = rows.select("document", blocks.alias("blocks"), message.alias("message"))
    rows = rows.select(F.explode(F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(F.array("document"))).alias("block"), "message")
    return rows.select("block", *(F.coalesce(element("block", p), F.get("message", F.lit(i))).alias(p) for i, p in enumerate(paths)))


def element(text: str, path: str) -> Column:
    """The text at a path of element names in a column of XML; else its first attribute."""
    where = "/" + "".join(f"/descendant-or-self::{step}" for step in path.replace(".", "/").split("/"))
    return F.coalesce(*(let(F.trim(F.xpath_string(text, F.lit(at))), lambda found: F.when(found != "", found)) for at in (where, where + "/@*")))


def project(rows: DataFrame, fmap: FeatureMap) -> DataFrame:
    """The ten features as doubles and the label ``y``; z-scores take one aggregate over the whole source."""
    pick = lambda name: F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
    columns = []
    for name in CONTRACT:
        spec = fmap.features.get(name, Feature())
        columns.append((to_number(pick(spec.source), spec.default) if spec.source else F.lit(spec.default)).alias(name))
    if fmap.label_column and fmap.kind == "csv":
        label = F.bround(to_number(pick(fmap.label_column), 0.0)).cast("int")
    else:
        label = F.lit(int(fmap.label or 0))
    out = rows.select(*columns, label.alias("y"))
    scored = [c for c in CONTRACT if (s := fmap.features.get(c)) and s.source and s.transform == "zscore"]
    if scored:
        stats = out.agg(*(F.avg(c).alias(f"_m_{c}") for c in scored), *(F.stddev_pop(c).alias(f"_s_{c}") for c in scored))
        out = out.join(F.broadcast(stats))  # one row

    def changed(name: str) -> Column:
        spec = fmap.features.get(name, Feature())
        if not spec.source or spec.transform in (None, "raw"):
            return F.col(name)
        if spec.transform == "log1p":
            return F.log1p(F.greatest(F.col(name), F.lit(0.0)))
        if spec.transform == "bool":
            return (F.col(name) != 0).cast("double")
        spread = F.col(f"_s_{name}")
        return (F.col(name) - F.col(f"_m_{name}")) / F.when(spread > 1e-9, spread).otherwise(1.0)

    return out.select(*(changed(c).alias(c) for c in CONTRACT), "y")


def read(spark: SparkSession, fmap: FeatureMap) -> DataFrame:
    paths = sorted({f.source for f in fmap.features.values() if f.source})
    return project(read_csv(spark, fmap.path) if fmap.kind == "csv" else read_payments(spark, fmap.path, paths), fmap)


def read_cards(rows: DataFrame) -> DataFrame:
    """Card transactions of string columns Time, V1..V28, Amount, Class as 30 standardised doubles and ``y``."""
    number = lambda c: F.trim(F.regexp_replace(F.col(c), '"', "")).try_cast("double")
    names = [f"V{i}" for i in range(1, 29)]
    out = rows.select(*(number(c).alias(c) for c in names), F.log1p(F.greatest(number("Amount"), F.lit(0.0))).alias("Amount"), number("Time").alias("Time"), number("Class").cast("int").alias("y"))
    names += ["Amount", "Time"]
    # dividing Time by its maximum first leaves its z-score as it is
    stats = out.agg(*(F.avg(c).alias(f"_m_{c}") for c in names), *(F.stddev_pop(c).alias(f"_s_{c}") for c in names))
    spread = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.join(F.broadcast(stats)).select(*(((F.col(c) - F.col(f"_m_{c}")) / spread(c)).alias(c) for c in names), "y")
