import pytest
from pyspark.sql import functions as F
from weft.functions import text as X
from weft.operators import graph as G
from weft.operators import match as M
from weft.operators import metrics, tickets, traverse, versions
from weft.sources import files, graphs


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, k, i.split("#")[-1], s) for s, (i, k) in enumerate(nodes)], "id string, kind string, name string, seq long")
    e = spark.createDataFrame([(a, b, k, v, s) for s, (a, b, k, v) in enumerate((*x, None)[:4] if len(x) == 3 else x for x in edges)], "src string, dst string, kind string, via string, seq long")
    return G.Graph(n, e)


@pytest.fixture(scope="module")
def app(spark):
    """Two pages with an instance each of a shared table, and two endpoints."""
    nodes = [("Users", "component"), ("Invoices", "component"), ("DataTable", "component"), ("t1", "instance"), ("t2", "instance"), ("/api/users", "data-source"), ("/api/invoices", "data-source")]
    edges = [("Users", "t1", "renders"), ("Invoices", "t2", "renders"), ("t1", "DataTable", "instance-of"), ("t2", "DataTable", "instance-of"), ("Users", "/api/users", "fetches-from"), ("Invoices", "/api/invoices", "fetches-from"), ("/api/users", "t1", "provides-data", "rows"), ("/api/invoices", "t2", "provides-data", "rows")]
    return make(spark, nodes, edges)


def start(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "origin string, node string")


def test_impact(spark, app):
    hit = {(r.origin, r.node): r.distance for r in traverse.blast_radius(app, start(spark, "DataTable", "/api/users")).collect()}
    assert {k[1]: v for k, v in hit.items() if k[0] == "DataTable"} == {"t1": 1, "t2": 1, "Users": 2, "Invoices": 2}
    assert {k[1]: v for k, v in hit.items() if k[0] == "/api/users"} == {"Users": 1, "t1": 1}
    near = traverse.blast_radius(app, start(spark, "DataTable"), depth=1)
    assert {r.node for r in near.collect()} == {"t1", "t2"}


def test_trace_is_per_instance(spark, app):
    got = {(r.origin, r.node) for r in traverse.trace_lineage(app, start(spark, "t1", "t2", "Users")).where("kind = 'data-source'").collect()}
    assert got == {("t1", "/api/users"), ("t2", "/api/invoices"), ("Users", "/api/users")}
    assert {(r.instance, r.source) for r in traverse.per_instance_sources(app).collect()} == {("t1", "/api/users"), ("t2", "/api/invoices")}


def test_trace_follows_state_to_its_writers_and_survives_cycles(spark):
    g = make(spark, [("A", "component"), ("B", "hook"), ("s", "state"), ("/w", "data-source"), ("e", "event"), ("/t", "data-source"), ("r", "route")], [("A", "B", "uses-hook"), ("B", "A", "uses-hook"), ("B", "s", "reads-state"), ("/w", "s", "writes-state"), ("A", "e", "handles"), ("e", "/t", "triggers"), ("e", "r", "navigates-to")])
    got = {(r.node, r.kind) for r in traverse.trace_lineage(g, start(spark, "A")).collect()}
    assert got == {("A", "component"), ("B", "hook"), ("s", "state"), ("/w", "data-source"), ("e", "event"), ("/t", "data-source")}


def paths(spark, pairs, first, depth, most=256):
    effects = spark.createDataFrame([(a, k, f"go {b}", b) for k, (a, b) in enumerate(pairs)], "page string, ord int, step string, target string")
    got = traverse.journeys(effects, spark.createDataFrame([(first,)], "start string"), depth, most)
    return sorted((">".join(r.pages), r.end) for r in got.collect())


def test_journeys(spark):
    assert paths(spark, [("/a", "/b"), ("/b", "/a"), ("/a", None)], "/a", 3) == [("/a", "terminal"), ("/a>/b>/a", "cycle")]
    assert paths(spark, [("/a", "/b"), ("/b", "/c"), ("/c", "/d")], "/a", 3) == [("/a>/b>/c", "depth-limit")]
    assert paths(spark, [("/a", "/b")], "/a", 1) == [("/a", "depth-limit")]
    assert paths(spark, [("/x", "/b")], "/a", 3) == [("/a", "terminal")]
    assert len(paths(spark, [("/a", f"/p{k}") for k in range(9)], "/a", 2, most=4)) == 4


def test_closure_with_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "parent string, child string")
    assert {(r.ancestor, r.node) for r in traverse.closure(pairs).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "b"), ("b", "c"), ("b", "d"), ("c", "b"), ("c", "c"), ("c", "d")}


def test_tables_of_the_graph(spark, app):
    assert {r.kind: r.n for r in G.kind_counts(app.nodes).collect()} == {"component": 3, "instance": 2, "data-source": 2}
    lost = G.Graph(app.nodes.where("id <> 't2'"), app.edges)
    assert G.live_edges(lost).count() == 5 and G.dangling_edges(lost).count() == 3
    assert {r.id: r.degree for r in G.degrees(app.edges).collect()}["DataTable"] == 2
    assert G.lookup(app.nodes, "DataTable", "name").first().id == "DataTable"
    twice = app.nodes.unionAll(app.nodes.withColumn("seq", F.col("seq") + 100).withColumn("name", F.lit("later")))
    assert G.keep_first(twice, "id").where("name = 'later'").count() == 0 and G.keep_last(twice, "id").where("name <> 'later'").count() == 0
    nodes, edges = G.view_model(app)
    assert nodes.columns == ["id", "kind", "name"] and edges.count() == 8


def test_graph_files_and_versions(spark, app, tmp_path):
    graph = G.Graph(app.nodes, app.edges.withColumn("condition", F.lit(None).cast("struct<kind:string,expression:string>")))
    graphs.save_graph(graph, f"{tmp_path}/g.json")
    loaded, meta = graphs.load_graph(spark, f"{tmp_path}/g.json")
    assert loaded.nodes.count() == 7 and loaded.edges.orderBy("seq").first().src == "Users" and meta.first().version == 2
    for text, said in (('{"nodes": []}', "no schema version"), ('{"version": 3, "nodes": []}', "newer")):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(graphs.GraphError, match=said):
            graphs.load_graph(spark, f"{tmp_path}/bad.json")
    graphs.save_version(graph, f"{tmp_path}/store", "abc")
    assert graphs.load_version(spark, f"{tmp_path}/store").edges.count() == 8
    with pytest.raises(graphs.GraphError):
        graphs.load_version(spark, f"{tmp_path}/store", "missing")
    assert graphs.corrections(spark, f"{tmp_path}/none").count() == 0
    graphs.record_correction(spark, f"{tmp_path}/fixes", ["a b"], "Thing")
    assert graphs.corrections(spark, f"{tmp_path}/fixes").first().terms == ["a b"]
    (tmp_path / "aliases.yaml").write_text("invoice widget: Billing\n")
    assert graphs.aliases(spark, f"{tmp_path}/aliases.yaml").first().component == "Billing"


def pool(spark, *rows):
    """(name, texts, identifiers)"""
    made = [(n, n, list(t), n, None) for n, t in rows]
    df = spark.createDataFrame(made, "component_id string, name string, texts array<string>, raw string, flags array<string>")
    return df.withColumn("identifiers", X.identifier_tokens(F.col("raw"))).drop("raw")


def ask(spark, components, *terms, **more):
    return [(r.name, round(r.score, 6), r.status, r.level) for r in M.match(components, M.terms_of(spark, list(terms)), **more).orderBy("rank").collect()]


def test_match_scores(spark):
    forms = pool(spark, ("NotifyForm", ["Save", "Notifications"]), ("ProfileForm", ["Save", "Display name"]), ("BillingForm", ["Save", "Card number"]))
    tie = ask(spark, forms, "Save")
    assert len(tie) == 3 and all(r[1:3] == (0.133531, "ambiguous") for r in tie)
    best = ask(spark, forms, "Save", "Card number")
    assert best[0] == ("BillingForm", 3.142785, "ok", "high")
    assert ask(spark, pool(spark, ("ReconciliationReport", ["Account Reconciliation"]), ("Other", ["Something"])), "Acount Reconcilliation")[0][:3] == ("ReconciliationReport", 2.079442, "ok")
    assert ask(spark, forms, "The") == [] and ask(spark, forms, "|") == []


def test_match_prefers_the_inner_of_equals(spark):
    cards = pool(spark, ("RevenueCard", ["Total revenue", "vs last month"]), ("RevenueSection", []), ("DashboardPage", ["Dashboard"]))
    below = spark.createDataFrame([("RevenueSection", "RevenueCard"), ("DashboardPage", "RevenueSection"), ("DashboardPage", "RevenueCard")], "ancestor string, node string")
    assert [r[0] for r in ask(spark, cards, "Total revenue", "vs last month", closure=below)] == ["RevenueCard"]


def test_match_by_name_and_structure(spark):
    cards = pool(spark, ("BillingSummaryCard", ["Invoices due"]), ("Other", ["Recent invoices"]))
    aliases = spark.createDataFrame([("invoice widget", "BillingSummaryCard")], "phrase string, component string")
    assert ask(spark, cards, "invoice widget") == []
    assert ask(spark, cards, "invoice widget", aliases=aliases)[0][:3] == ("BillingSummaryCard", 10.0, "ok")
    fixes = spark.createDataFrame([(["recent invoices"], "BillingSummaryCard")], "terms array<string>, component string")
    assert ask(spark, cards, "Recent invoices", corrections=fixes)[0][0] == "BillingSummaryCard"
    counts = spark.createDataFrame([("BillingSummaryCard", 2), ("Other", 0)], "component_id string, button int")
    fit = counts.select("component_id", M.structure_fit({"button": F.col("button")}, {"buttons": 2}).alias("fit"))
    got = ask(spark, cards, fit=fit)
    assert got[0][:3] == ("BillingSummaryCard", 3.0, "ok") and got[0][3] == "medium"


def test_generated_components_are_no_candidates(spark):
    both = pool(spark, ("A", ["Save card"]), ("B", ["Save card"])).withColumn("flags", F.when(F.col("name") == "B", F.array(F.lit("generated"))))
    assert [r[0] for r in ask(spark, both, "Save card")] == ["A"]


def test_renames(spark):
    side = lambda *x: spark.createDataFrame(list(x), "identity string, signature string")
    pairs = lambda a, b: [tuple(r)[:2] for r in versions.rename_pairs(a, b).collect()]
    assert pairs(side(("Old a", "s"), ("Same", "t")), side(("New a", "s"), ("Same", "t"))) == [("Old a", "New a")]
    assert pairs(side(("A", "s"), ("B", "s")), side(("C", "s"))) == []
    assert pairs(side(("A", None)), side(("C", None))) == []


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "file string, text string")
    got = {tuple(r) for r in versions.manifest_diff(versions.manifest(old), versions.manifest(new)).collect()}
    assert got == {("b", "changed"), ("c", "removed"), ("d", "added")}


@pytest.mark.parametrize("text, shots, link, kind", [("Nothing happens when I click Save", 0, None, "behavioral"), ("The Invoice table shows wrong totals", 0, None, "textual"), ("Redis is down", 0, None, "out-of-domain"), ("see it", 1, None, "visual"), ("see it", 1, "x/y.mp4?z", "unsupported"), ("a screen recording of it", 0, None, "unsupported"), (None, 0, None, "textual")])
def test_tickets(spark, text, shots, link, kind):
    row = spark.createDataFrame([(text, shots, [link] if link else None)], "text string, shots int, links array<string>")
    assert row.select(tickets.classify(F.col("text"), F.col("shots"), F.col("links"))).first()[0] == kind


def test_terms_of_tickets(spark):
    ask_ = lambda t: spark.range(1).select(tickets.terms(F.lit(t))).first()[0]
    assert ask_('the "Save all" button of `Card`') == ["Save all", "Card"]
    assert ask_("the Invoice Total is off in Billing") == ["Invoice Total", "Billing"]
    assert ask_("it is off") == ["it is off"]


def test_bundles_shrink_by_importance():
    bundle = {"match": ["a" * 100, "b" * 100], "lineage": ["l" * 400], "blastRadius": ["r" * 400], "journeys": ["j" * 400], "tests": ["t" * 400], "history": ["h" * 400]}
    got = tickets.trim(bundle, 450)
    assert got["history"] == [] and got["lineage"] and len(got["match"]) == 2 and got["budget"]["used"] <= 450
    least = tickets.trim(bundle, 10)
    assert len(least["match"]) == 1 and not least["lineage"] and len(least["warnings"]) == 6


def test_measures(spark):
    both = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["x"], ["x"])], "expected array<string>, got array<string>")
    assert tuple(metrics.tally(both).first()) == (2, 1, 1, 0.667, 0.667)
    curve = metrics.calibration(spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.5, False)], "score double, correct boolean")).collect()
    assert [(r.threshold, r.n, r.correct) for r in sorted(curve, key=lambda r: -r.threshold)] == [(0.9, 1, 1), (0.8, 3, 2), (0.5, 4, 2)]


def test_side_tables(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name in ("a.tsx", "b.d.ts", "c.js", "node_modules/d.ts"):
        (tmp_path / "src" / name).write_text("x")
    assert [r.file for r in files.source_tree(spark, f"{tmp_path}/src").collect()] == ["a.tsx"]
    texts = spark.createDataFrame([("l/en.json", '{"a": {"b": "x", "n": 1}}'), ("l/z/en.json", '{"a": {"b": "y"}}'), ("l/fr.json", "no")], "file string, text string")
    assert [tuple(r) for r in files.locale_table(texts).collect()] == [("a.b", "en", "y")]
    spec = '{"paths": {"/u/{id}": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/U"}}}}}}, "head": {}}}, "components": {"schemas": {"U": {"properties": {"id": {"type": "integer"}}}}}}'
    described = files.interface(spark, spec)
    assert tuple(described.first())[:3] == ("GET", "/u/:id", "U") and files.interface(spark, "{").count() == 0
    sources = spark.createDataFrame([(None, "/u/:id", None), ("POST", "/u/:id", None), ("GET", "/u/:id", "Own"), ("GET", "/v", None)], "method string, endpoint string, response string")
    assert sorted(map(str, (r.response for r in files.with_responses(sources, described).collect()))) == ["None", "Own", "U", "U"]
    assert files.history(spark, f"{tmp_path}", ["a"]).count() == 0 and files.provenance(f"{tmp_path}") == (None, False)


def test_scores_are_rounded_as_in_sql(spark):
    import duckdb

    want = dict(duckdb.sql("select i, round(i / 5000.0, 2) from range(0, 5001) r(i)").fetchall())
    got = {r.id: r.s for r in spark.range(5001).select("id", metrics.rounded(F.col("id") / 5000.0, 2).alias("s")).collect()}
    assert got == want and got[725] == 0.14
    answers = spark.range(640).select(F.lit(0.5).alias("score"), (F.col("id") < 41).alias("correct"))
    assert metrics.calibration(answers).first().precision == duckdb.sql("select round(41 / 640, 6)").fetchall()[0][0]
