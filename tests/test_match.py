"""Ranking, collapse and questions on small pools."""

import pytest
from weft.functions import graphql
from weft.operators import match as M
from weft.operators import metrics, traverse
from weft.operators.order import numbered

POOL = "component_id string, name string, texts array<string>, identifiers array<string>, flags array<string>"


def pool(spark, *rows):
    return spark.createDataFrame([(i, n, t, [], []) for i, n, t in rows], POOL)


def closure(spark, *pairs):
    return traverse.closure(spark.createDataFrame(list(pairs), "parent string, child string"))


def test_the_deepest_of_a_chain_stays_and_the_rest_is_its_context(spark):
    parts = pool(spark, ("p", "Page", []), ("s", "Section", []), ("c", "Card", ["Save draft"]))
    found = M.match(parts, M.terms_of(spark, ["save draft"]), closure=closure(spark, ("p", "s"), ("s", "c"))).collect()
    assert [(r.component_id, r.status, r.context) for r in found] == [("c", "ok", ["Section", "Page"])]


def test_components_that_render_each_other_leave_one(spark):
    parts = pool(spark, ("a", "A", ["Save draft"]), ("b", "B", ["Save draft"]))
    found = M.match(parts, M.terms_of(spark, ["save draft"]), closure=closure(spark, ("a", "b"), ("b", "a"))).collect()
    assert [(r.component_id, r.context) for r in found] == [("a", ["B"])]


def test_of_equal_scores_the_smaller_subtree_comes_first(spark):
    parts = pool(spark, ("1", "AaBig", ["Save draft"]), ("2", "Zz", ["Save draft"]), ("3", "Child", ["other thing"]))
    found = M.match(parts, M.terms_of(spark, ["save draft"]), closure=closure(spark, ("1", "3"))).orderBy("rank").collect()
    assert [r.name for r in found] == ["Zz", "AaBig"] and found[0].status == "ambiguous"


def test_a_question_names_what_only_one_of_the_leaders_shows(spark):
    parts = pool(spark, ("1", "A", ["Save draft", "Common", "Only here"]), ("2", "B", ["Save draft", "common"]))
    found = M.match(parts, M.terms_of(spark, ["save draft"]))
    assert sorted((r.name, r.distinctive) for r in M.question(found, parts).collect()) == [("A", "Only here"), ("B", None)]
    assert [r.name for r in M.top(found, 1).collect()] == ["A"]


def test_a_picture_of_something_else_is_declined(spark):
    parts = pool(spark, ("1", "A", ["Save draft"]))
    assert M.from_vision(spark, {"looksLikeApp": False, "terms": ["save draft"]}, parts) is None
    plain, marked = (M.from_vision(spark, {"terms": ["save draft"], "annotations": a}, parts).first().score for a in ([], [{"terms": ["save draft"]}]))
    assert marked == pytest.approx(3 * plain)


def test_places_hold_over_partitions(spark):
    rows = spark.range(1000).repartition(7).selectExpr("id % 17 as a", "id")
    got = [(r.a, r.id, r.seq) for r in numbered(rows, "a", "id").collect()]
    assert sorted(got, key=lambda r: r[2]) == [(a, i, k + 1) for k, (a, i) in enumerate(sorted((i % 17, i) for i in range(1000)))]
    assert numbered(rows.limit(0), "a").count() == 0


def test_operations_of_odd_documents():
    assert graphql.operation(None) is None and graphql.operation("fragment F on User { id }") is None
    assert graphql.operation("{ a, b: c }") == ("query", None, ["a", "b"])
    assert graphql.operation('`subscription S { # no { x }\n made(text: "} {") { id } ...on T { x } }`') == ("subscription", "S", ["made"])


def test_measures_of_nothing_are_null(spark):
    none = spark.createDataFrame([], "right boolean, ties int, status string, level string, outside boolean, declined boolean")
    assert list(metrics.honesty(none).first()) == [None] * 4
    curve = spark.createDataFrame([(0.9, 1.0), (0.8, 0.9), (0.7, 0.96)], "threshold double, precision double")
    assert tuple(metrics.thresholds(curve).first()) == (0.7, 0.9)
    same = metrics.determinism(curve, curve).first()
    assert (same.only_first, same.only_second, same.same) == (0, 0, True)
