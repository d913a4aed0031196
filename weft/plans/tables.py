"""The driver tables as lineage graphs and component pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def sales_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions route to nations, which use customers, which render orders, which are instances of parts;
    suppliers feed the parts and hand data to the orders."""
    t = lambda n: load(spark, sf_dir, n)
    node = lambda df, prefix, key, kind, name: df.select(_id(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    nodes = (
        node(t("region"), "region", "r_regionkey", "route", "r_name")
        .unionAll(node(t("nation"), "nation", "n_nationkey", "component", "n_name"))
        .unionAll(node(t("customer"), "customer", "c_custkey", "hook", "c_name"))
        .unionAll(node(t("orders"), "order", "o_orderkey", "instance", "o_orderkey"))
        .unionAll(node(t("part"), "part", "p_partkey", "component", "p_name"))
        .unionAll(node(t("supplier"), "supplier", "s_suppkey", "data-source", "s_name"))
    )
    edge = lambda df, src, dst, kind, via=None: df.select(_id(*src).alias("src"), _id(*dst).alias("dst"), F.lit(kind).alias("kind"), (F.col(via).cast("string") if via else F.lit(None).cast("string")).alias("via"))
    lines = t("lineitem")
    edges = (
        edge(t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "routes-to")
        .unionAll(edge(t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "uses-hook"))
        .unionAll(edge(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "renders"))
        .unionAll(edge(lines, ("order", "l_orderkey"), ("part", "l_partkey"), "instance-of"))
        .unionAll(edge(lines, ("part", "l_partkey"), ("supplier", "l_suppkey"), "fetches-from"))
        .unionAll(edge(lines, ("supplier", "l_suppkey"), ("order", "l_orderkey"), "provides-data", "l_linenumber"))
    )
    once = edges.groupBy("src", "dst", "kind").agg(F.min("via").alias("via"))
    return Graph(nodes.withColumn("seq", F.xxhash64("id")), once.withColumn("seq", F.xxhash64("src", "dst", "kind")))


GRAPH_SQL = """
nodes as (
  select 'region:' || r_regionkey as id, 'route' as kind, r_name as name from region
  union all select 'nation:' || n_nationkey, 'component', n_name from nation
  union all select 'customer:' || c_custkey, 'hook', c_name from customer
  union all select 'order:' || o_orderkey, 'instance', o_orderkey::varchar from orders
  union all select 'part:' || p_partkey, 'component', p_name from part
  union all select 'supplier:' || s_suppkey, 'data-source', s_name from supplier
), edges as (
  select src, dst, kind, min(via) as via from (
    select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'routes-to' as kind, null as via from nation
    union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'uses-hook', null from customer
    union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'renders', null from orders
    union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'instance-of', null from lineitem
    union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'fetches-from', null from lineitem
    union all select 'supplier:' || l_suppkey, 'order:' || l_orderkey, 'provides-data', l_linenumber::varchar from lineitem
  ) group by src, dst, kind
), dep as (
  select distinct case when kind = 'provides-data' then src else dst end as resource, case when kind = 'provides-data' then dst else src end as dependent from edges
)"""


def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components: the name is shown, brand and type name the component."""
    from ..functions.text import identifier_tokens

    part = load(spark, sf_dir, "part")
    return part.select(_id("part", "p_partkey").alias("component_id"), F.col("p_name").alias("name"), F.array("p_name").alias("texts"), identifier_tokens(F.col("p_type"), F.col("p_brand")).alias("identifiers"), F.array().cast("array<string>").alias("flags"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, target) of event types that follow each other for a user."""
    from pyspark.sql import Window

    next_ = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("page"), next_.alias("target")).where("target is not null").distinct()


TRANSITIONS_SQL = "transitions as (select distinct page, target from (select event_type as page, lead(event_type) over (partition by user_id order by ts, event_id) as target from events) where target is not null)"


PARTS_A_TASK = 2048  # reading their files takes a core some seconds; the table is small, so its scan is one task or two


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): a component for each part, which renders that of half its number, and the files around them."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    part = part.repartition(part.count() // PARTS_A_TASK + 1, "p_partkey")
    key, half = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2)
    say = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    k, h = key.cast("string"), half.cast("string")
    text = say(
        "import { useState } from 'react';\nimport { BASE } from '../config';\nimport Part", h, " from './Part", h, "';\nconst ALL = '/api/all';\n",
        "function Part", k, "({ title, size }) {\n  const [open, setOpen] = useState(false);\n  const rows = fetch(BASE + '/parts/", k, "');\n  const all = fetch(ALL, { method: 'post' }); const names = all.slice(1);\n",
        "  return (\n    <section>\n      <h1>", F.col("p_name"), "</h1>\n      <p>{t('types.", (key % 5).cast("string"), "')}</p>\n      <Part", h, " title=\"", F.col("p_brand"), "\" rows={rows.first} names={names} onPick={() => all} />\n",
        "      <button onClick={() => setOpen(true)}>Open</button>\n      <a href=\"https://host", (key % 3).cast("string"), ".example.org/p\">more</a>\n    </section>\n  );\n}\nexport default Part", k, ";\n",
    )
    own = part.select(say("src/parts/Part", k, ".tsx").alias("file"), text.alias("text"))
    tests = part.where("p_partkey % 4 = 0").select(say("src/parts/Part", k, ".test.tsx").alias("file"), say("import Part", k, " from './Part", k, "';\ntest('shows', () => { render(<Part", k, " />); });\n").alias("text"))
    routes = say("import Part1 from './parts/Part1';\nexport function App() {\n  return <Routes><Route path=\"/parts\" element={<Part1 />} /><Route path=\"/oauthCallback\" element={<Part1 />} /></Routes>;\n}\n")
    other = spark.range(1).select(F.explode(F.array(F.struct(F.lit("src/config.ts").alias("file"), F.lit("export const BASE = '/api/v2';\n").alias("text")), F.struct(F.lit("src/App.tsx").alias("file"), routes.alias("text")))).alias("x")).select("x.*")
    return own.unionAll(tests).unionAll(other)


def source_locales(spark: SparkSession) -> DataFrame:
    """(key, locale, text) of the keys that the components of :func:`source_files` name."""
    return spark.createDataFrame([(f"types.{k}", locale, f"{word} {k}") for k in range(4) for locale, word in (("de", "Art"), ("en", "Kind"))], "key string, locale string, text string")
