"""Clashing columns, ties, null ids, deep and long pages: what each operator defines for them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import dom, quality, suffix, tiling

NAMES = "doc_id long, text string, row_key int, weft_n int, h string, list string, item_id string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, 777, 1, "h", "l", "x") for i, t in rows], NAMES)


LONG = " ".join(f"word{k}" for k in range(60))


def test_repeats_go_from_a_table_with_clashing_columns(spark):
    docs = with_clashes(spark, [(1, LONG + " one"), (2, "two " + LONG), (None, None), (None, "short")])
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).where("doc_id is not null").collect()}
    assert got[1].row_key == 777 and len(got[1].text) < 20 and len(got[2].text) < 20
    assert suffix.remove_repeats(docs).columns == docs.columns and suffix.remove_repeats(docs).count() == 4


@pytest.mark.parametrize("most", [tiling.BROADCAST_WORDS, 0])
def test_decontamination_keeps_clashing_columns(spark, most):
    items = spark.createDataFrame([(5, " ".join(f"item{k}" for k in range(20)), 9), (6, None, 9)], "item_id long, text string, item_key int")
    docs = with_clashes(spark, [(1, LONG), (2, LONG + " " + " ".join(f"item{k}" for k in range(20))), (None, None)])
    kept = tiling.decontaminate(docs, items, broadcast_words=most).collect()
    assert sorted((str(r.doc_id), r.row_key) for r in kept) == [("1", 777), ("None", 777)]


@pytest.mark.parametrize("most", [tiling.BROADCAST_WORDS, 0])
def test_contamination_of_tables_against_all_pairs(spark, most):
    """Every pair by brute force: tiles of all documents against all items, with reordered passages."""
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 24))) for k in range(12)] + [(12, "too short"), (13, None)]
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 80))) for k in range(20)]
    for k in range(12):
        own = items[k][1].split()
        docs.append((100 + k, " ".join([*own[12:], "between", *own[: 12 - k]])))
    docs += [docs[-1], (500, None), (501, "one " * 5000)]
    want = []
    for d, text in docs:
        for i, item in items:
            a, b = (np.unique((item or "").split(), return_inverse=True), (text or "").split())
            code = {w: k for k, w in enumerate(a[0].tolist())}
            x, y = np.array([code[w] for w in (item or "").split()], np.int64), np.array([code.get(w, -1) for w in b], np.int64)
            under = sum(t[2] for t in tiling.tile(x.astype(np.uint64), y.astype(np.uint64))) if len(x) >= tiling.SEED else 0
            if len(x) and under >= tiling.SHARE * len(x):
                want.append((d, i, len(x), under))
    found = tiling.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_words=most)
    assert sorted((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in found.collect()) == sorted(want) and len(want) > 8


@pytest.mark.parametrize("k", [2, 6])
def test_exactly_k_of_repeated_rows_and_null_ids(spark, k):
    rows = [(1, "the same text of some words")] * 3 + [(None, "another text of some words")] * 2 + [(2, "a third one of them"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels, k=k).where("kept").count() == min(k, 7)
    assert quality.keep(docs, labels, k=k).count() == min(k, 7)


def test_sampling_against_a_sort_by_key(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows = quality.classify(docs, labels, k=700).toPandas().sort_values(["sample_key", "doc_id"], ascending=[False, True])
    assert rows.kept.tolist() == [True] * 700 + [False] * 2300


def texts_of(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    return [r.text for r in dom.extract(df).orderBy("page_id").collect()]


def test_elements_without_an_end_hide_nothing(spark):
    body = "<html><body><nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>Title of it</h1><p>First long paragraph of words here.</p>{}<p>Second long paragraph of words here.</p></article></body></html>"
    want = "Title of it\nFirst long paragraph of words here.\nSecond long paragraph of words here."
    assert texts_of(spark, *(body.format(x) for x in ("", "<svg width='1'/>", "<svg><path d='x'></svg>", "<script>if (a < b) '</p>'</script>"))) == [want] * 4
    assert "Second long paragraph" in texts_of(spark, body.format("<iframe src='x'>"))[0]


@pytest.mark.parametrize("page", ["<nav>" * 20_000, "<a '" * 20_000, "<a '" * 20_000 + ">", "<p>" * 20_000, "</div>" * 20_000, "<li>x" * 20_000, "<div><svg>" * 10_000, "<!-- <" * 20_000, "<ul><li>" * 10_000 + "x"])
def test_pages_take_time_in_proportion_to_their_length(page):
    began = time.process_time()
    dom.describe(dom.parse(page))
    assert time.process_time() - began < 5
