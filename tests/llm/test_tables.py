import html
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import dom, queries, rabitq, urls

SF = "/root/testdata/sf0.001"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(sql).df()


def test_embeddings_match_sql_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    rows = []
    for k in range(240):
        v = base[k % 12] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.05, 0.2])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 12 < 6), "x"))
    rows += [(240, None, 1, "x"), (241, [], 1, "x"), (242, [0.0] * 16, 1, "x"), (243, [float("nan")] * 16, 1, "x"), (244, rows[0][1], None, "x"), (245, [None] * 16, 1, "x"), (246, rows[0][1][:8], rows[0][2], "x"), (247, [2 * x for x in rows[0][1]], rows[0][2], "x"), (248, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    got = rabitq.near_duplicates(df).toPandas().sort_values("vec_id").reset_index(drop=True)
    want = by_sql(rabitq.OP2_SQL, embeddings=df.toArrow()).sort_values("vec_id").reset_index(drop=True)
    assert got.astype("int64").equals(want[got.columns].astype("int64"))
    assert rabitq.near_duplicates(df.limit(0)).count() == 0


def test_estimates_decide_as_exact_products_do():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 64))
    x = np.concatenate([base, base + rng.standard_normal((40, 64)) * 0.2, base + rng.standard_normal((40, 64)) * 0.15])
    a, b = np.triu_indices(len(x), 1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = (unit @ unit.T)[a, b]
    sure = np.abs(exact - 0.98) > 1e-9
    assert (rabitq.near_pairs(x, a, b, 0.98)[sure] == (exact >= 0.98)[sure]).all()


@pytest.mark.parametrize("bits", [urls.MOST_BITS, 512])
def test_urls_match_sql(spark, bits):
    own = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/1", "http://example.com/en", "x://www.example.com/en/", "http://shop.net/es/1.html", "http://notexample.com/fr/", "http://b.org/fr/9/", "http://spam-farm.example.org/en/1/?a=b", "http://m.spam-farm.example.org/q", "http://www.spam-farm.example.org/en/1.html", "a://b://c.com/d", "http://x.com?u=/v", "http://casino-win.org/a", "http://x.org/q.html\n", "http://x.org/b7", "http://x.org/b7/", "http://x.org/b7.html\n", "http://spam-farm.example.org/en/1/?a=b"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(own)], "page_id long, url string, host string, maybe string")
    got = urls.judge(pages, urls.listing(pages), most_bits=bits).toPandas().sort_values("page_id").reset_index(drop=True)
    want = by_sql(urls.OP8_SQL, pages=pages.toArrow()).sort_values("page_id").reset_index(drop=True)
    assert got.fillna("-").astype(str).equals(want.fillna("-").astype(str))
    assert urls.judge(pages.limit(0), urls.listing(pages)).count() == 0
    assert urls.judge(pages, urls.listing(pages).limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(5000).selectExpr("concat('h.org/', id) as url")
    words = urls.bloom(listed)
    hashes = lambda lo, hi: np.array([r[0] for r in spark.range(lo, hi).selectExpr("xxhash64(concat('h.org/', id))").collect()])
    assert urls.possible(words, hashes(0, 5000)).all()
    assert urls.possible(words, hashes(5000, 10000)).mean() < 0.02


def test_spread_list_decides_pages_that_no_rule_does(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    listed = urls.listing(pages)
    for bits in (urls.MOST_BITS, 512):
        got = urls.judge(pages, listed, most_bits=bits).toPandas().sort_values("page_id").reset_index(drop=True)
        want = by_sql(urls.OP8_SQL, pages=pages.toArrow()).sort_values("page_id").reset_index(drop=True)
        assert got.fillna("-").astype(str).equals(want.fillna("-").astype(str))
    by_list = got[got["rule"].isna() & (got.verdict == "block")]
    assert len(by_list) >= 100
    words = urls.bloom(listed.distinct(), 512)
    clean = got[got["rule"].isna() & (got.verdict == "allow")].page_id.tolist()
    form = urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    hashes = np.array([r[0] for r in pages.where(F.col("page_id").isin(clean)).select(F.xxhash64(form)).collect()])
    assert urls.possible(words, hashes).any()  # false positives, which the join removed


def test_pages_held_out():
    model, rng, right = dom.train(), random.Random(123), 0
    for _ in range(200):
        page, kept = dom.write_page(rng)
        nodes, rows = dom.describe(dom.parse(page))
        right += dom.decode(nodes, model.score(np.array(rows, float))) == "\n".join(kept)
    assert right >= 190


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in dom.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    odd = [(1, None), (2, ""), (3, "<"), (4, "just text"), (5, "<html><body><nav>menu</nav></body></html>"), (6, "<article><p>A &amp; b&nbsp;c<p>D<script>x</article>"), (6, "<article><p>A &amp; b&nbsp;c<p>D<script>x</article>"), (7, "<div>" * 2000 + "deep")]
    df = spark.createDataFrame([(k, "u", h, "t") for k, h in odd], "page_id long, url string, html string, text string")
    got = dom.extract(df).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.page_id == 6] == ["A & b c\nD"] * 2
    assert dom.extract(df.limit(0)).count() == 0


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or (ids == before if name in ("suffix", "merges") else ids <= before)
        assert name == "merges" or docs.columns == documents.columns
        before = ids
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
