"""Graph documents (JSON) and the versioned store (Parquet)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import DOCUMENT, VERSION, Graph


class GraphError(ValueError):
    """A graph that can't be loaded, with what to do about it."""


def load_graph(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph of a JSON document and its one row of metadata; refuses documents without a version or of a newer one."""
    document = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    version = document.select("version").first()
    if version is None or version[0] is None:
        raise GraphError(f"{path} has no schema version; scan again")
    if version[0] > VERSION:
        raise GraphError(f"{path} has schema version {version[0]}, newer than {VERSION}; upgrade")
    nodes = document.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", F.col("seq").cast("long").alias("seq"))
    nodes = nodes.select("*", F.col("loc.file").alias("file"), F.col("loc.line").alias("line"), F.col("loc.endLine").alias("end_line")).drop("loc")
    edges = document.select(F.posexplode("edges").alias("seq", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.via", "e.condition", F.col("seq").cast("long").alias("seq"))
    return Graph(nodes, edges), document.select("version", "root", "generatedAt", "generator", "meta")


def save_graph(graph: Graph, path: str, root: str = ".", generator: str = "weft") -> None:
    """One JSON document; for exchange, so of a size that one machine writes."""
    plain = lambda rows: [json.loads(r[0]) for r in rows.orderBy("seq").select(F.to_json(F.struct(*[c for c in rows.columns if c != "seq"]))).collect()]
    nodes = [{**{k: v for k, v in n.items() if k not in ("file", "line", "end_line")}, "loc": {"file": n.get("file"), "line": n.get("line"), "endLine": n.get("end_line")}} for n in plain(graph.nodes)]
    edges = [{("from" if k == "src" else "to" if k == "dst" else k): v for k, v in e.items()} for e in plain(graph.edges)]
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"version": VERSION, "root": root, "generatedAt": "", "generator": generator, "nodes": nodes, "edges": edges}, out, indent=2, ensure_ascii=False)


def save_version(graph: Graph, store: str, version: str) -> None:
    """A version's nodes and edges as Parquet partitions; writing it again replaces it, and it becomes the latest."""
    for name, rows in (("nodes", graph.nodes), ("edges", graph.edges)):
        rows.write.mode("overwrite").parquet(f"{store}/{name}/version={version}")
    rows.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{store}/latest")


def load_version(spark: SparkSession, store: str, version: str = "latest") -> Graph:
    if version == "latest":
        try:
            version = spark.read.schema("version string").json(f"{store}/latest").first()[0]
        except Exception as e:
            raise GraphError(f"{store} has no latest version; save one first") from e
    try:
        return Graph(*(spark.read.parquet(f"{store}/{name}/version={version}") for name in ("nodes", "edges")))
    except Exception as e:
        raise GraphError(f"{store} has no version {version}") from e


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(terms, component) lines; a missing file is an empty table."""
    schema = "terms array<string>, component string"
    if not os.path.exists(path) and "://" not in path:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def record_correction(spark: SparkSession, path: str, terms: list[str], component: str) -> None:
    spark.createDataFrame([(terms, component)], "terms array<string>, component string").coalesce(1).write.mode("append").json(path)


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, component) of a YAML map."""
    import yaml

    with open(path, encoding="utf-8") as text:
        return spark.createDataFrame([(str(k), str(v)) for k, v in (yaml.safe_load(text) or {}).items()], "phrase string, component string")
