"""Plans and results that must hold whatever the partitioning."""

from pyspark.sql import functions as F
from weft.operators import metrics, traverse, versions
from weft.plans import registry
from weft.plans.tables import part_components, sales_graph

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_functions_stay_in_the_jvm(spark):
    for name in ("text_normalize", "text_low_signal", "token_idf", "phrase_match", "structure_signature", "url_hosts", "ticket_classify", "manifest_diff"):
        shown = plan(registry.QUERIES[name](spark, SF))
        assert "Python" not in shown and "Arrow" not in shown, name


def test_scans_read_only_what_is_asked(spark):
    shown = plan(registry.QUERIES["untested"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in shown and "text:string" not in shown


def test_same_results_under_other_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    graph = sales_graph(spark, SF)
    targets = graph.nodes.where("id = 'part:3'").select(F.col("id").alias("origin"), F.col("id").alias("node"))
    ask = lambda: sorted(map(tuple, traverse.blast_radius(graph, targets).collect()))
    first = ask()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert ask() == first and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_in_nothing_out(spark):
    graph = sales_graph(spark, SF)
    none = graph.nodes.limit(0).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    assert traverse.blast_radius(graph, none).count() == 0
    empty = spark.createDataFrame([], "identity string, signature string")
    assert versions.rename_pairs(empty, empty).count() == 0
    assert metrics.coverage(graph.nodes.limit(0), graph.nodes.limit(0)).first().components == 0
    assert part_components(spark, SF).count() > 0


def test_source_files_are_read_by_many_tasks(spark, monkeypatch):
    from weft.plans import tables

    monkeypatch.setattr(tables, "PARTS_A_TASK", 20)
    files = tables.source_files(spark, SF)
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    most = files.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert files.count() > parts >= 100 and most <= 60


def test_a_trace_is_aggregated_once(spark):
    graph = sales_graph(spark, SF)
    starts = graph.nodes.where("id = 'customer:1'").select(F.col("id").alias("origin"), F.col("id").alias("node"))
    traced = traverse.trace_lineage(graph, starts)
    assert "Aggregate" not in plan(traced) and traced.count() > 1
