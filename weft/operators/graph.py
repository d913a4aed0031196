"""The lineage graph as two tables, and the operators on them.

nodes: id, kind, name, file, line, end_line, flags, attributes of the kinds, seq (place in canonical order)
edges: src, dst, kind, via, condition, seq
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from pyspark.sql import types as T

VERSION = 2
NODE_KINDS = ("component", "instance", "hook", "data-source", "state", "event", "route", "external", "test")
#: Kinds of edges whose source depends on their target, and the other way round; the rest carry no dependence.
TO_RESOURCE = ("renders", "instance-of", "uses-hook", "fetches-from", "reads-state", "routes-to")
FROM_RESOURCE = ("provides-data", "writes-state", "covered-by")
UNDIRECTED = ("handles", "triggers", "navigates-to", "exits-app", "enters-at")

_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "source", "key", "locale", "branch")] + [T.StructField("template", T.BooleanType())])
_COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("table", "columns", "form", "input", "button", "link", "image", "heading", "list", "repeated")])
_FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))
NODE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "kind", "name")]
    + [T.StructField("loc", T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("endLine", T.IntegerType())]))]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("flags", "props", "rendersComponents", "guards")]
    + [T.StructField("renderedText", T.ArrayType(_TEXT)), T.StructField("structure", _COUNTS), T.StructField("staticProps", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("exportName", "definitionId", "parentInstanceId", "sourceKind", "method", "endpoint", "raw", "resolved", "queryKey", "stateKind", "event", "handler", "source", "path", "router", "layout", "url", "host", "framework")]
    + [T.StructField("responseType", T.StructType([T.StructField("name", T.StringType()), T.StructField("fields", _FIELDS), T.StructField("source", T.StringType())]))]
)
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("from", "to", "kind", "via")] + [T.StructField("condition", T.StructType([T.StructField("kind", T.StringType()), T.StructField("expression", T.StringType())]))])
META = T.StructType([T.StructField("commitSha", T.StringType()), T.StructField("dirty", T.BooleanType()), T.StructField("fileHashes", T.MapType(T.StringType(), T.StringType()))])
DOCUMENT = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("root", T.StringType()), T.StructField("generatedAt", T.StringType()), T.StructField("generator", T.StringType()), T.StructField("meta", META), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def keep_first(rows: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """One row per key, the first in order; as a partial aggregate, without a sort."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def keep_last(rows: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def canonical(graph: Graph) -> Graph:
    """With seq: nodes by id, edges by their full key."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "src", "dst", "via")]
    return Graph(numbered(graph.nodes.drop("seq"), "id"), numbered(graph.edges.drop("seq"), F.concat_ws(" ", *key)))


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def live_edges(graph: Graph) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = graph.nodes.select("id")
    return graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*graph.edges.columns)


def dangling_edges(graph: Graph) -> DataFrame:
    ids = graph.nodes.select("id")
    lost = [graph.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*graph.edges.columns) for end in ("src", "dst")]
    return lost[0].union(lost[1]).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def dependence(edges: DataFrame) -> DataFrame:
    """(resource, dependent, relation, seq): who is touched when a resource changes."""
    down, up = F.col("kind").isin(*TO_RESOURCE), F.col("kind").isin(*FROM_RESOURCE)
    return edges.where(down | up).select(F.when(down, F.col("dst")).otherwise(F.col("src")).alias("resource"), F.when(down, F.col("src")).otherwise(F.col("dst")).alias("dependent"), F.col("kind").alias("relation"), "seq")


def lookup(nodes: DataFrame, name: str, *columns: str) -> DataFrame:
    """The first node whose id, or else whose given columns in turn, equal the name."""
    rank = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(("id", *columns)))):
        rank = F.when(F.col(c) == name, F.lit(k)).otherwise(rank)
    return nodes.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "seq").limit(1).drop("_rank")


def label(nodes: DataFrame) -> Column:
    return F.expr("case kind when 'data-source' then coalesce(endpoint, name) when 'route' then coalesce(path, name) when 'external' then coalesce(host, name) else name end")


def view_model(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """What a viewer needs: trimmed nodes, and edges between nodes that exist."""
    return graph.nodes.select("id", "kind", "name"), live_edges(graph).select("src", "dst", "kind", "via")
