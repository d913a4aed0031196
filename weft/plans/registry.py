"""Every query of the graph and text operators over the driver tables, with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import link
from ..functions import graphql
from ..functions import paths as P
from ..functions import text as X
from ..operators import graph as G
from ..operators import match as M
from ..operators import metrics, tickets, traverse, versions
from ..streaming import counts as streams
from .tables import GRAPH_SQL, TRANSITIONS_SQL, load, part_components, sales_graph, source_files, source_locales, transitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- text -------------------------------------------------------------------------------------------

_FOLD = "case when length(t) > 4 and ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' when length(t) > 3 and ends_with(t, 's') and not ends_with(t, 'ss') then left(t, length(t) - 1) else t end"


def _tokens_sql(text: str) -> str:
    spaced = f"trim(regexp_replace(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}*\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"list_transform(list_filter(string_split({spaced}, ' '), lambda t: t <> ''), lambda t: {_FOLD})"


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _low_sql(normal: str) -> str:
    words = f"list_filter(string_split({normal}, ' '), lambda t: t <> '' and t <> '*')"
    return f"(length(regexp_replace({normal}, '[ *]', '', 'g')) < 2 or (len({words}) > 0 and len(list_filter({words}, lambda t: not list_contains({_STOP_SQL}, t))) = 0))"


def _fuzzy_sql(a: str, b: str) -> str:
    n = f"greatest(length({a}), length({b}))"
    return f"({a} = {b} or ({n} between 5 and 7 and levenshtein({a}, {b}) <= 1) or ({n} > 7 and levenshtein({a}, {b}) <= 2))"


@query(f"select doc_id, array_to_string({_tokens_sql('text')}, ' ') as normal from documents")
def text_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))


@query(f"select p_partkey, array_to_string({_tokens_sql('p_name || chr(32) || p_brand')}, '|') as tokens, len({_tokens_sql('p_name || chr(32) || p_brand')})::int as n_tokens from part")
def text_tokens(spark, sf_dir):
    both = X.tokens(F.concat_ws(" ", "p_name", "p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(both, "|").alias("tokens"), F.size(both).alias("n_tokens"))


@query(f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
n as (select doc_id, array_to_string({_tokens_sql('line')}, ' ') as normal from lines)
select doc_id, count(*) as n_lines, sum({_low_sql('normal')}::int)::bigint as n_low from n group by doc_id""")
def text_low_signal(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(X.low_signal(X.normalize(F.col("line"))).cast("int")).alias("n_low"))


@query(f"""with t as (select distinct doc_id, unnest({_tokens_sql('text')}) as token from documents),
n as (select greatest(count(*), 1) as n from documents)
select token, count(*) as df, round(ln((max(n.n) + 1) / (count(*) + 0.5)), 9) as idf from t, n group by token""")
def token_idf(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    df = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))).select("token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 0.5)), 9).alias("idf"))


_QUERY_TOKENS = ("widgit", "gizmos", "sprockett", "econmy", "blue", "bolt", "standart", "ring")


@query(f"""with v as (select distinct unnest({_tokens_sql("p_name || ' ' || p_type")}) as token from part),
q as (select unnest([{', '.join(repr(t) for t in _QUERY_TOKENS)}]) as wanted)
select wanted, token from q, v where {_fuzzy_sql('wanted', 'token')}""")
def fuzzy_tokens(spark, sf_dir):
    vocabulary = load(spark, sf_dir, "part").select(F.explode(X.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("token")).distinct()
    wanted = spark.createDataFrame([(t,) for t in _QUERY_TOKENS], "wanted string")
    return vocabulary.join(F.broadcast(wanted), X.fuzzy_equal(F.col("wanted"), F.col("token"))).select("wanted", "token")


@query(f"""with b as (select item_id, {_tokens_sql('text')} as h from benchmark), q as (select unnest([['the', 'heon'], ['of', 'the'], ['erest', 'thre'], ['de', 'la']]) as p)
select item_id, array_to_string(p, ' ') as phrase from b, q
where len(list_filter(range(0, greatest(len(h) - len(p) + 1, 0)), lambda i: len(list_filter(range(0, len(p)), lambda j: {_fuzzy_sql('h[i + j + 1]', 'p[j + 1]')})) = len(p))) > 0""")
def phrase_match(spark, sf_dir):
    phrases = spark.createDataFrame([(["the", "heon"],), (["of", "the"],), (["erest", "thre"],), (["de", "la"],)], "p array<string>")
    items = load(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("h"))
    return items.join(F.broadcast(phrases), X.contains_phrase(F.col("h"), F.col("p"))).select("item_id", F.array_join("p", " ").alias("phrase"))


@query(f"""with b as (select conv_id, turn, array_to_string({_tokens_sql('text')}, ' ') as h from conversations), q as (select unnest(['the re*', 'de la', 'and *ing']) as pattern)
select conv_id, turn, pattern from b, q where case when length(regexp_replace(pattern, '[ *]', '', 'g')) < 2 then false when instr(pattern, '*') > 0 then regexp_matches(h, replace(pattern, '*', '.*')) else contains(pattern, h) or contains(h, pattern) end""")
def wildcard_match(spark, sf_dir):
    patterns = spark.createDataFrame([("the re*",), ("de la",), ("and *ing",)], "pattern string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize(F.col("text")).alias("h"))
    return turns.join(F.broadcast(patterns), X.text_matches(F.col("pattern"), F.col("h"))).select("conv_id", "turn", "pattern")


# --- matching ---------------------------------------------------------------------------------------

_TERMS = ("Blue bolts", "economy widget", "Old Ring")


def _match_sql(boost: dict[str, float] | None = None, named: str = "0.0") -> str:
    terms = ", ".join(f"({k}, '{t}', {float((boost or {}).get(t, 1))}::double)" for k, t in enumerate(_TERMS))
    return f"""with q as (select term_id, {_tokens_sql('raw')} as tt, array_to_string({_tokens_sql('raw')}, ' ') as term, boost from (values {terms}) v(term_id, raw, boost)),
terms as (select * from q where length(term) > 1 and not {_low_sql('term')}),
pool as (select 'part:' || p_partkey as component_id, p_name as name, {_tokens_sql('p_name')} as tokens, list_distinct(list_concat({_tokens_sql("regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")}, {_tokens_sql("regexp_replace(p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")})) as ident from part),
shown as (select *, array_to_string(tokens, ' ') as normal from pool where not {_low_sql("array_to_string(tokens, ' ')")}),
df as (select token, count(*) as df from (select distinct component_id, unnest(tokens) as token from pool) group by token),
w as (select distinct unnest(tt) as token from terms),
idf as (select w.token, ln(((select greatest(count(*), 1) from pool) + 1) / (coalesce((select df from df where df.token = w.token), (select max(df) from df where {_fuzzy_sql('df.token', 'w.token')}), 0.5) + 0.5)) as idf from w),
weights as (select term_id, sum(idf) as w from (select term_id, unnest(tt) as token from terms) join idf using (token) group by term_id),
hits as (select component_id, name, ident, terms.term_id, tt, boost, w from shown, terms join weights using (term_id)
  where contains(normal, term) or contains(term, normal)
  or len(list_filter(range(0, greatest(len(tokens) - len(tt) + 1, 0)), lambda i: len(list_filter(range(0, len(tt)), lambda j: {_fuzzy_sql('tokens[i + j + 1]', 'tt[j + 1]')})) = len(tt))) > 0),
valued as (select *, w * boost * case when len(list_filter(tt, lambda t: len(list_filter(ident, lambda i: {_fuzzy_sql('t', 'i')})) > 0)) > 0 then 1.5 else 1.0 end as v from hits),
scored as (select component_id, name, sum(v) * (1 + 0.5 * (count(*) - 1)) as text, count(*)::int as n_covered from valued group by component_id, name),
auth as (select component_id, name, coalesce(text, 0) + authority as score, coalesce(n_covered, 0) as n_covered, authority from (select p.component_id, p.name, s.text, s.n_covered, {named} as authority from pool p left join scored s using (component_id)) where n_covered > 0 or authority > 0),
best as (select max(score) as best from auth), leaders as (select count(*) as n from auth, best where abs(score - best) < 1e-9)
select component_id, name, round(score, 6) as score, round(case when authority > 0 then 1.0 else n_covered / (select count(*) from terms) end, 6) as coverage, n_covered, (row_number() over (order by score desc, name, component_id))::int as rank, case when (select n from leaders) > 1 then 'ambiguous' else 'ok' end as status from auth"""


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("component_id", "name", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "n_covered", "rank", "status")


@query(_match_sql())
def match_rank(spark, sf_dir):
    return _ranked(M.match(part_components(spark, sf_dir), M.terms_of(spark, list(_TERMS))))


@query(_match_sql({"Old Ring": 3.0}))
def match_boosted(spark, sf_dir):
    return _ranked(M.match(part_components(spark, sf_dir), M.terms_of(spark, list(_TERMS), {"Old Ring": M.ANNOTATED})))


@query(_match_sql(named="case when lower(p.name) = 'small gear' then 10.0 when lower(p.name) = 'red widget' then 25.0 else 0.0 end"))
def match_named(spark, sf_dir):
    aliases = spark.createDataFrame([("blue bolt", "Small Gear"), ("nothing of it", "hot bolt")], "phrase string, component string")
    corrections = spark.createDataFrame([(["Old Ring", "blue bolts"], "red widgets"), (["old ring", "missing"], "hot gear")], "terms array<string>, component string")
    return _ranked(M.match(part_components(spark, sf_dir), M.terms_of(spark, list(_TERMS)), aliases=aliases, corrections=corrections))


def _rendered(spark, sf_dir):
    """Parts render the part of half their number; parts 1 and 2 render each other, so the graph has a cycle."""
    key = F.col("p_partkey")
    pairs = load(spark, sf_dir, "part").where("p_partkey > 1").select(F.concat(F.lit("part:"), key.cast("string")).alias("parent"), F.concat(F.lit("part:"), (key - F.floor(key / 2)).cast("string")).alias("child")).where("parent <> child")
    return traverse.closure(pairs.unionAll(spark.createDataFrame([("part:1", "part:2")], "parent string, child string")))


_COLLAPSE_SQL = f"""with recursive edge as (select 'part:' || p_partkey as a, 'part:' || (p_partkey - p_partkey // 2) as b from part where p_partkey > 1 union select 'part:1', 'part:2'),
up as (select a, b from edge where a <> b union select up.a, edge.b from up join edge on edge.a = up.b where edge.a <> edge.b), above as (select distinct a, b from up where a <> b),
pool as (select 'part:' || p_partkey as id, p_name as name, p_name ilike '%ring%' as own from part),
hit as (select distinct id from (select id from pool where own union all select above.a from above join pool on pool.id = above.b and pool.own)),
size as (select a as id, count(*) as size from above group by a),
ranked as (select pool.id, name, row_number() over (order by coalesce(size, 0), name, pool.id) as place from pool join hit using (id) left join size using (id)),
pair as (select n.id as n, x.id as x, n.place as n_place, x.name as x_name, x.place as x_place from above join ranked x on x.id = above.a join ranked n on n.id = above.b
  where n.place < x.place or not exists (select 1 from above back where back.a = n.id and back.b = x.id)),
heir as (select x, min_by(n, n_place) as n, any_value(x_name) as x_name, any_value(x_place) as x_place from pair group by x),
ctx as (select n, list(x_name order by x_place) as context from heir group by n)
select r.id as component_id, r.name, coalesce(len(context), 0)::int as n_context, coalesce(array_to_string(context[1:5], '|'), '') as context from ranked r left join ctx on ctx.n = r.id where r.id not in (select x from heir)"""


@query(_COLLAPSE_SQL)
def match_collapse(spark, sf_dir):
    """One term that many parts show, so that all candidates cover the same; who renders a match is its context (of which five are shown)."""
    parts = part_components(spark, sf_dir).withColumn("identifiers", F.array().cast("array<string>"))
    found = M.match(parts, M.terms_of(spark, ["ring"]), closure=_rendered(spark, sf_dir))
    return found.select("component_id", "name", F.size("context").alias("n_context"), F.array_join(F.slice("context", 1, 5), "|").alias("context"))


@query("""with f as (select 'part:' || p_partkey as component_id, p_name as name, (case when p_size >= 10 then 1 else 0 end + case when p_retailprice > 1500 then 1 else 0 end) / 2.0 as fit from part),
k as (select *, 3 * fit as score from f where fit > 0), b as (select max(score) as best from k)
select component_id, name, round(score, 6) as score, case when least(fit, 0.79) >= 0.5 then 'medium' else 'low' end as level, (row_number() over (order by score desc, name, component_id))::int as rank, case when (select count(*) from k, b where score = best) > 1 then 'ambiguous' else 'ok' end as status from k""")
def match_structure(spark, sf_dir):
    counts = {"input": F.when(F.col("p_size") >= 10, 3).otherwise(0), "table": F.when(F.col("p_retailprice") > 1500, 1).otherwise(0)}
    fit = load(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("component_id"), M.structure_fit(counts, {"inputs": 2, "table": True}).alias("fit"))
    found = M.match(part_components(spark, sf_dir), M.terms_of(spark, []), fit=fit)
    return found.select("component_id", "name", F.round("score", 6).alias("score"), "level", "rank", "status")


@query(f"""with found as ({_match_sql()}), tied as (select component_id, name, rank from found where status = 'ambiguous' and score = (select max(score) from found)),
n as (select component_id, name, array_to_string({_tokens_sql('name')}, ' ') as normal from tied), own as (select normal from n where normal <> '' group by normal having count(distinct component_id) = 1)
select t.component_id, t.name, rank as place, case when normal in (select normal from own) then t.name end as distinctive from tied t join n using (component_id)""")
def match_question(spark, sf_dir):
    parts = part_components(spark, sf_dir)
    return M.question(M.match(parts, M.terms_of(spark, list(_TERMS))), parts)


_TAGS = {"table": "table", "columns": "th", "form": "form", "input": "(?:input|select|textarea)", "button": "button", "link": "a", "image": "img", "heading": "h[1-6]", "list": "(?:ul|ol)", "repeated": "li"}
_COUNT_SQL = ", ".join(f"len(regexp_extract_all(html, '<{p}[ >]'))::int as \"{k}\"" for k, p in _TAGS.items())


def _signature(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *[F.regexp_count("html", F.lit(f"<{p}[ >]")).alias(k) for k, p in _TAGS.items()])


@query(f"select page_id, {_COUNT_SQL} from pages")
def structure_signature(spark, sf_dir):
    return _signature(load(spark, sf_dir, "pages"))


@query(f"""with s as (select page_id, {_COUNT_SQL} from pages)
select page_id, round((((("table" > 0) = false)::int + (("list" > 0) = true)::int + ("button" >= 1)::int + ("repeated" >= 5)::int + (abs("columns" - 3) <= 1)::int)) / 5.0, 6) as fit from s""")
def structure_fit(spark, sf_dir):
    counts = _signature(load(spark, sf_dir, "pages"))
    return counts.select("page_id", F.round(M.structure_fit({k: F.col(k) for k in _TAGS}, {"table": False, "list": True, "buttons": 2, "cards": 6, "columns": 3}), 6).alias("fit"))


# --- URLs and markup --------------------------------------------------------------------------------

@query("""select page_id, regexp_matches(url, '(?i)^((https?:)?//|(mailto|tel|sms):)') as external, regexp_extract(url, '(?i)^(?:https?:)?//([^/?#]*)', 1) as host from pages""")
def url_hosts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", P.is_external(F.col("url")).alias("external"), P.host(F.col("url")).alias("host"))


_PATH_SQL = "regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '(.)/$', '\\1')"
_SHAPE_SQL = f"regexp_replace({_PATH_SQL}, '/[0-9]+', '/:param', 'g')"


@query(f"""with routes(route, seq) as (values ('/en/:id', 1), ('/de/:doc', 2), ('/fr/:id.html', 3), ('/en/:other', 4)),
shapes as (select regexp_replace(route, ':[^/.]+', ':param', 'g') as shape, min_by(route, seq) as route from routes group by 1)
select page_id, {_PATH_SQL} as path, coalesce(r.route, s.route) as route from pages left join routes r on r.route = {_PATH_SQL} left join shapes s on s.shape = {_SHAPE_SQL}""")
def url_shape_join(spark, sf_dir):
    routes = spark.createDataFrame([("/en/:id", 1), ("/de/:doc", 2), ("/fr/:id.html", 3), ("/en/:other", 4)], "route string, seq int")
    shapes = G.keep_first(routes.select(F.regexp_replace("route", ":[^/.]+", ":param").alias("shape"), "route", "seq"), "shape").select("shape", F.col("route").alias("by_shape"))
    path = P.route_path(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1))
    pages = load(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("shape", F.regexp_replace("path", "/[0-9]+", "/:param"))
    both = pages.join(F.broadcast(routes.select("route")), F.col("path") == F.col("route"), "left").join(F.broadcast(shapes), "shape", "left")
    return both.select("page_id", "path", F.coalesce("route", "by_shape").alias("route"))


@query("""with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)
select page_id, count(*) as links, sum(regexp_matches(href, '(?i)^((https?:)?//|(mailto|tel|sms):)')::int)::bigint as external, count(distinct href) as targets from h group by page_id""")
def page_links(spark, sf_dir):
    links = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(P.is_external(F.col("href")).cast("int")).alias("external"), F.countDistinct("href").alias("targets"))


def _decoded_sql(text: str) -> str:
    """The names alone, &amp; last: the tables have no numbers, which tests hold against brute force."""
    for name, char in P.ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


@query(f"select page_id, {_decoded_sql('html')} as html from pages")
def entity_decode(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", P.decode_entities(F.col("html")).alias("html"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'query' when 1 then 'mutation' else 'query' end as type, case p_partkey % 3 when 2 then null else 'Part' || p_partkey end as name,
case p_partkey % 3 when 1 then 'save|then' else 'part|first|seller' end as root_fields from part""")
def graphql_operations(spark, sf_dir):
    """Documents written from each part: named, with arguments, aliases, fragments and comments."""
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("{ part(id: "), key, F.lit(") { name ...F } # {no\n first: parts(n: 1) @skip(if: true) { id } ... on Q seller { a { b } } part { x } }"))
    change = F.concat(F.lit("`mutation Part"), key, F.lit("($a: In!) { save(in: {a: $a}) { id } then }`"))
    kind = F.col("p_partkey") % 3
    document = F.when(kind == 0, F.concat(F.lit("query Part"), key, F.lit("($n: Int = 1) "), body)).when(kind == 1, change).otherwise(body)
    found = load(spark, sf_dir, "part").select("p_partkey", graphql.parse_operation(document).alias("o"))
    return found.select("p_partkey", "o.type", "o.name", F.array_join("o.root_fields", "|").alias("root_fields"))


@query("""with f as (select doc_id, 'src/' || source || '/' || lang || case doc_id % 4 when 0 then '/View.tsx' when 1 then '/types.d.ts' when 2 then '/a/b/hook.ts' else '.jsx' end as file from documents)
select doc_id, regexp_matches(file, '\\.(tsx|jsx)$') as scanned, regexp_matches(file, '^src/[^/]*/[^/]*\\.jsx$') as flat, regexp_matches(file, '/a/b/hook\\.ts$') as deep from f""")
def glob_files(spark, sf_dir):
    kind = F.col("doc_id") % 4
    file = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.when(kind == 0, "/View.tsx").when(kind == 1, "/types.d.ts").when(kind == 2, "/a/b/hook.ts").otherwise(".jsx"))
    return load(spark, sf_dir, "documents").select("doc_id", graphql.glob(file, "**/*.{tsx,jsx}").alias("scanned"), graphql.glob(file, "src/*/*.jsx").alias("flat"), graphql.glob(file, "src/**/a/?/hook.ts").alias("deep"))


@query("""select page_id, replace(to_json(html)::varchar, '<', '\\u003c') as json, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as markup from pages""")
def escapes(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('"'), graphql.escape_json(html), F.lit('"')).alias("json"), graphql.escape_markup(html).alias("markup"))


# --- graph ------------------------------------------------------------------------------------------

@query(f"with {GRAPH_SQL} select id, kind, name from nodes")
def graph_nodes(spark, sf_dir):
    return sales_graph(spark, sf_dir).nodes.select("id", "kind", "name")


@query(f"with {GRAPH_SQL} select src, dst, kind, via from edges")
def graph_edges(spark, sf_dir):
    return sales_graph(spark, sf_dir).edges.select("src", "dst", "kind", "via")


@query("""select l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as k from lineitem) where k = 1""")
def edge_dedup(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"))
    return G.keep_first(lines, "l_orderkey", "l_suppkey").drop("seq")


@query(f"with {GRAPH_SQL} select kind, count(*) as n from nodes group by kind")
def kind_counts(spark, sf_dir):
    return G.kind_counts(sales_graph(spark, sf_dir).nodes)


@query(f"with {GRAPH_SQL}, kept as (select id from nodes where not regexp_matches(id, '7$')) select src, dst, kind from edges where src not in (select id from kept) or dst not in (select id from kept)")
def dangling_edges(spark, sf_dir):
    graph = sales_graph(spark, sf_dir)
    return G.dangling_edges(G.Graph(graph.nodes.where(~F.col("id").endswith("7")), graph.edges)).select("src", "dst", "kind")


@query(f"with {GRAPH_SQL} select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id")
def node_degree(spark, sf_dir):
    return G.degrees(sales_graph(spark, sf_dir).edges)


@query(f"with {GRAPH_SQL}, kept as (select id from nodes where not regexp_matches(id, '7$')) select src, dst, kind, via from edges where src in (select id from kept) and dst in (select id from kept)")
def view_edges(spark, sf_dir):
    graph = sales_graph(spark, sf_dir)
    return G.view_model(G.Graph(graph.nodes.where(~F.col("id").endswith("7")), graph.edges))[1]


def _impact_sql(start: str, depth: int = 99) -> str:
    return f"""with recursive {GRAPH_SQL}, hit as (
  select id as origin, id as node, 0 as distance from nodes where starts_with(id, '{start}')
  union select hit.origin, dep.dependent, hit.distance + 1 from hit join dep on dep.resource = hit.node where hit.distance < {depth}
) select hit.origin, hit.node, any_value(nodes.kind) as kind, min(distance)::int as distance from hit join nodes on nodes.id = hit.node group by hit.origin, hit.node having min(distance) > 0"""


def _impact(spark, sf_dir, start: str, depth: int | None = None):
    graph = sales_graph(spark, sf_dir)
    targets = graph.nodes.where(F.col("id").startswith(start)).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return traverse.blast_radius(graph, targets, depth, relations=False)


@query(_impact_sql("part:"))
def impact_part(spark, sf_dir):
    return _impact(spark, sf_dir, "part:")


@query(_impact_sql("customer:"))
def impact_customer(spark, sf_dir):
    return _impact(spark, sf_dir, "customer:")


@query(_impact_sql("supplier:", 1))
def impact_depth_cap(spark, sf_dir):
    return _impact(spark, sf_dir, "supplier:", 1)


@query("""with d as (select distinct 'customer:' || o_custkey as origin, 'order:' || l_orderkey as o, 'part:' || l_partkey as p from orders join lineitem on l_orderkey = o_orderkey),
s as (select distinct 'part:' || l_partkey as p, 'supplier:' || l_suppkey as s from lineitem)
select 'customer:' || o_custkey as origin, 'order:' || o_orderkey as node, 'instance' as kind, 1 as distance from orders
union select origin, p, 'component', 2 from d where p in (select 'part:' || p_partkey from part)
union select origin, s, 'data-source', 3 from d join s using (p) where s in (select 'supplier:' || s_suppkey from supplier)""")
def trace_customer(spark, sf_dir):
    graph = sales_graph(spark, sf_dir)
    starts = graph.nodes.where("kind = 'hook'").select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return traverse.trace_lineage(graph, starts).where("distance > 0")


@query(f"with {GRAPH_SQL} select i.dst as definition, p.dst as instance, p.src as source, p.via from edges p join edges i on i.src = p.dst and i.kind = 'instance-of' where p.kind = 'provides-data'")
def per_instance_sources(spark, sf_dir):
    return traverse.per_instance_sources(sales_graph(spark, sf_dir))


@query("""select 'region:' || n_regionkey as ancestor, 'nation:' || n_nationkey as node from nation
union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer
union select 'region:' || n_regionkey, 'customer:' || c_custkey from customer join nation on n_nationkey = c_nationkey""")
def render_closure(spark, sf_dir):
    edges = sales_graph(spark, sf_dir).edges.where("kind in ('routes-to', 'uses-hook')")
    return traverse.closure(edges.select(F.col("src").alias("parent"), F.col("dst").alias("child")))


def _journey_sql(depth: int) -> str:
    return f"""with recursive {TRANSITIONS_SQL}, starts as (select distinct event_type as page from events), walk as (
  select page as start, [page] as pages, case when {depth} <= 1 then 'depth-limit' when page not in (select page from transitions) then 'terminal' end as "end" from starts
  union all
  select start, list_append(pages, target), case when list_contains(pages, target) then 'cycle' when len(pages) + 1 >= {depth} then 'depth-limit' when target not in (select page from transitions) then 'terminal' end
  from walk join transitions on transitions.page = pages[len(pages)] where "end" is null
) select start, array_to_string(pages, '>') as path, "end" from walk where "end" is not null"""


def _journeys(spark, sf_dir, depth: int, most: int | None = None):
    from pyspark.sql import Window

    steps = transitions(spark, sf_dir)
    effects = steps.select("page", F.row_number().over(Window.partitionBy("page").orderBy("target")).alias("ord"), F.concat(F.lit("go "), "target").alias("step"), "target")
    starts = load(spark, sf_dir, "events").select(F.col("event_type").alias("start")).distinct()
    return traverse.journeys(effects, starts, depth, most).select("start", F.array_join("pages", ">").alias("path"), "end")


@query(_journey_sql(3))
def journey_paths(spark, sf_dir):
    return _journeys(spark, sf_dir, 3)


@query(_journey_sql(6))
def journey_cycles(spark, sf_dir):
    return _journeys(spark, sf_dir, 6)


@query(f"select start, path, \"end\" from (select *, row_number() over (partition by start order by path) as k from ({_journey_sql(4)})) where k <= 20")
def journey_capped(spark, sf_dir):
    return _journeys(spark, sf_dir, 4, 20)


# --- versions ---------------------------------------------------------------------------------------

@query("""with old as (select s_name as identity, s_nationkey || '|' || s_acctbal::decimal(18,2) as signature from supplier),
new as (select case when s_suppkey % 3 = 0 then s_name || '-new' else s_name end as identity, s_nationkey || '|' || case when s_suppkey % 5 = 0 then 0.00 else s_acctbal::decimal(18,2) end as signature from supplier),
a as (select signature, min(identity) as old_id from old where identity not in (select identity from new) group by signature having count(*) = 1),
b as (select signature, min(identity) as new_id from new where identity not in (select identity from old) group by signature having count(*) = 1)
select old_id, new_id, signature from a join b using (signature)""")
def rename_pairs(spark, sf_dir):
    supplier, key = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    body = lambda money: F.concat_ws("|", F.col("s_nationkey").cast("string"), money.cast("decimal(18,2)").cast("string"))
    old = supplier.select(F.col("s_name").alias("identity"), body(F.col("s_acctbal")).alias("signature"))
    new = supplier.select(F.when(key % 3 == 0, F.concat("s_name", F.lit("-new"))).otherwise(F.col("s_name")).alias("identity"), body(F.when(key % 5 == 0, F.lit(0.0)).otherwise(F.col("s_acctbal"))).alias("signature"))
    return versions.rename_pairs(old, new)


@query("""with old as (select doc_id as file, sha256(text) as a from documents where doc_id % 11 <> 0), new as (select doc_id as file, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as b from documents where doc_id % 13 <> 0)
select file, case when a is null then 'added' when b is null then 'removed' else 'changed' end as change from old full join new using (file) where a is null or b is null or a <> b""")
def manifest_diff(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    later = docs.withColumn("text", F.when(F.col("file") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return versions.manifest_diff(versions.manifest(docs.where("file % 11 <> 0")), versions.manifest(later.where("file % 13 <> 0")))


@query("select doc_id, sha256(text) as sha256 from documents")
def content_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""select doc_id, (regexp_matches('src/' || source || '/' || doc_id || '.tsx', '(?i)(^|/)(__generated__|generated)(/|$)|\\.(generated|gen)\\.[jt]sx?$') or regexp_matches(substr(text, 1, 2000), '(?i)@generated\\b|do not edit|auto-?generated')
or coalesce(list_max(list_transform(string_split(text, chr(10)), lambda t: length(t))), 0) >= 3000) as generated from documents""")
def generated_flag(spark, sf_dir):
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tsx"))
    return load(spark, sf_dir, "documents").select("doc_id", P.is_generated(path, F.col("text")).alias("generated"))


# --- tickets and measures ---------------------------------------------------------------------------

#: The rules once more, word by word, so that the library's patterns are held against something else.
_OUTSIDE_SQL = "(?i)\\b(" + "|".join("database migration sql postgres mysql mongo redis kafka rabbitmq kubernetes k8s docker deploy deploys deployed deploying deployment deployments infra infrastructure terraform cron job[ ]queue background[ ]job worker latency throughput memory[ ]leak cpu[ ]usage webhook ci/cd pipeline nginx load[ ]balancer env[ ]variable environment[ ]variable api[ ]gateway microservice 502 503 504 gateway[ ]timeout connection[ ]pool".split()) + "|rate[- \\t\\n]?limit|rate[- \\t\\n]?limited|rate[- \\t\\n]?limiting|index (the )?table|indexing (the )?table)\\b"
_DOES_SQL = "|".join(f"{x} {y}" for x in ("doesn''?t", "does not") for y in ("work", "respond", "do anything", "fire", "trigger", "navigate", "submit", "save", "load", "open", "close"))
_WONT_SQL = "|".join(f"won''?t {y}" for y in ("submit", "save", "open", "close", "load", "work"))
_AFTER_SQL = "|".join(f"{x} {who}{y}" for x in ("after", "when") for who in ("", "i ", "you ", "we ") for y in ("click", "press", "tap", "submit", "hit"))
_ACTING_SQL = f"(?i)\\b(nothing happens|{_DOES_SQL}|no response|no reaction|no effect|not working|unresponsive|isn''?t working|{_WONT_SQL}|{_AFTER_SQL}|clicking .* (does|has) )"
_ENTRY_SQL = f"case when regexp_matches(coalesce(text, ''), '(?i)\\b(screencast|screen[- \\t\\n]?recording|video attached|video recording|video of)\\b') then 'unsupported' when shots > 0 then 'visual' when regexp_matches(coalesce(text, ''), '{_OUTSIDE_SQL}') then 'out-of-domain' when regexp_matches(coalesce(text, ''), '{_ACTING_SQL}') then 'behavioral' else 'textual' end"


def _tickets(spark, sf_dir):
    said = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    actions = F.array(*[F.lit(x) for x in ("", " after clicking Save", " when I clicked it", " when submitting", " the database migration", " the deployments", " see the screencast", " nothing happens", " won't save", " does not respond")])
    # tickets are turns with a phrase of each kind, and without one
    return said.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.get(actions, F.col("turn") % 10))).withColumn("screenshots", F.when(F.col("turn") % 9 == 8, 1).otherwise(0)).withColumn("links", F.array().cast("array<string>"))


_TICKETS_SQL = "tickets as (select conv_id, turn, coalesce(text, '') || (['', ' after clicking Save', ' when I clicked it', ' when submitting', ' the database migration', ' the deployments', ' see the screencast', ' nothing happens', ' won''t save', ' does not respond'])[turn % 10 + 1] as text, case when turn % 9 = 8 then 1 else 0 end as shots from conversations)"


@query(f"with {_TICKETS_SQL} select conv_id, turn, {_ENTRY_SQL} as entry_point from tickets")
def ticket_classify(spark, sf_dir):
    return _tickets(spark, sf_dir).select("conv_id", "turn", tickets.classify(F.col("text"), F.col("screenshots"), F.col("links")).alias("entry_point"))


_WIDE_SPACE = r"[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(rf"""with t as (select conv_id, turn, text, list_filter(regexp_extract_all(text, '["''`]([^"''`]{{2,}})["''`]', 1), lambda x: length(trim(x)) > 1) as a,
list_filter(regexp_extract_all(text, '\b([A-Z][a-z]+(?:{_WIDE_SPACE}+[A-Z][a-z0-9]+){{0,3}})\b', 1), lambda x: length(x) > 2) as b from conversations)
select conv_id, turn, array_to_string(case when len(a) > 0 then a when len(b) > 0 then b else [text] end, '|') as terms from t""")
def ticket_terms(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tickets.terms(F.col("text")), "|").alias("terms"))


@query(rf"""with {_TICKETS_SQL}, e as (select *, {_ENTRY_SQL} as entry_point from tickets), t as (select *, list_filter(regexp_extract_all(text, '["''`]([^"''`]{{2,}})["''`]', 1), lambda x: length(trim(x)) > 1) as a,
list_filter(regexp_extract_all(text, '\b([A-Z][a-z]+(?:{_WIDE_SPACE}+[A-Z][a-z0-9]+){{0,3}})\b', 1), lambda x: length(x) > 2) as b from e)
select conv_id, turn, entry_point, case entry_point when 'out-of-domain' then 'out-of-scope' when 'unsupported' then 'unsupported-input' end as declined,
case when entry_point not in ('out-of-domain', 'unsupported') then array_to_string(case when len(a) > 0 then a when len(b) > 0 then b else [text] end, '|') end as terms from t""")
def ticket_resolve(spark, sf_dir):
    return tickets.resolve(_tickets(spark, sf_dir)).select("conv_id", "turn", "entry_point", F.col("decline.reason").alias("declined"), F.array_join("terms", "|").alias("terms"))


@query("""select source, doc_id, (ceil(length(text) / 4.0))::bigint as size, (sum(ceil(length(text) / 4.0)) over (partition by source order by doc_id))::bigint as used, (sum(ceil(length(text) / 4.0)) over (partition by source order by doc_id)) <= 4000 as fits from documents""")
def token_budget(spark, sf_dir):
    sized = load(spark, sf_dir, "documents").select("source", "doc_id", tickets.tokens_of(F.col("text")).alias("size"))
    return tickets.within_budget(sized, 4000, "source", "doc_id", "size")


@query("select doc_id as id from documents where doc_id not in (select doc_id from labels)")
def untested(spark, sf_dir):
    return metrics.untested(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("select count(distinct d.doc_id) as components, count(distinct l.doc_id) as covered, round(count(distinct l.doc_id) / count(distinct d.doc_id), 6) as ratio from documents d left join labels l using (doc_id)")
def coverage_ratio(spark, sf_dir):
    return metrics.coverage(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""with s as (select l.doc_id, quality = 1 as correct, round(least(n_chars / 5000.0, 1), 2) as score from labels l join documents using (doc_id)),
g as (select score, count(*) as k, sum(correct::int) as c from s group by score)
select score as threshold, (sum(k) over (order by score desc))::bigint as n, (sum(c) over (order by score desc))::bigint as correct, round((sum(c) over (order by score desc)) / (sum(k) over (order by score desc)), 6) as precision from g""")
def calibration_curve(spark, sf_dir):
    both = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.calibration(both.select(metrics.rounded(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 2).alias("score"), (F.col("quality") == 1).alias("correct")))


_ANSWERS_SQL = "answers as (select l_quantity > 20 as \"right\", l_linenumber as ties, case when l_linenumber % 2 = 0 then 'ambiguous' else 'ok' end as status, case when l_tax > 0.04 then 'high' else 'low' end as level, l_returnflag = 'R' as outside, l_linestatus = 'O' as declined from lineitem)"


@query(f"""with {_ANSWERS_SQL}
select round(avg("right"::int) filter (not outside), 6) as accuracy, round(avg((status = 'ambiguous')::int) filter (not outside and ties > 1), 6) as ambiguity_honesty,
round(avg((not "right" and level = 'high')::int) filter (not outside), 6) as poison, round(avg(declined::int) filter (outside), 6) as ood_decline from answers""")
def eval_honesty(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return metrics.honesty(line.select((F.col("l_quantity") > 20).alias("right"), F.col("l_linenumber").alias("ties"), F.when(F.col("l_linenumber") % 2 == 0, "ambiguous").otherwise("ok").alias("status"), F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("level"), (F.col("l_returnflag") == "R").alias("outside"), (F.col("l_linestatus") == "O").alias("declined")))


@query("""with f as (select unnest(case when p_size > 40 then ['unscanned-events', 'incomplete'] when p_size > 20 then ['incomplete'] else [] end) as flag from part) select flag, count(*) as n from f group by flag""")
def incomplete_counts(spark, sf_dir):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    flags = F.when(size > 40, F.array(F.lit("unscanned-events"), F.lit("incomplete"))).when(size > 20, F.array(F.lit("incomplete"))).otherwise(none)
    return metrics.incomplete(load(spark, sf_dir, "part").select(flags.alias("flags")))


@query("""with e as (select l_orderkey, list_distinct(list(l_suppkey)) as expected, list_distinct(list(case when l_linenumber % 3 = 0 then l_suppkey + 1 else l_suppkey end)) as got from lineitem group by l_orderkey),
s as (select sum(len(list_intersect(expected, got)))::bigint as tp, sum(len(list_filter(got, lambda x: not list_contains(expected, x))))::bigint as fp, sum(len(list_filter(expected, lambda x: not list_contains(got, x))))::bigint as fn from e)
select tp, fp, fn, round(tp / (tp + fp), 3) as precision, round(tp / (tp + fn), 3) as recall from s""")
def eval_metrics(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    wrong = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))
    return metrics.tally(lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("expected"), F.collect_set(wrong).alias("got")))


@query("select source as key, lang as locale, max_by(text, doc_id) as text from documents group by source, lang")
def locale_lookup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("key"), F.col("lang").alias("locale")).agg(F.max_by("text", "doc_id").alias("text"))


# --- source files: written from the parts, read, linked ----------------------------------------------

_SOURCE_SQL = """p as (select p_partkey as k, p_partkey // 2 as h, p_name, p_brand, 'src/parts/Part' || p_partkey || '.tsx' as f from part),
c as (select *, 'component:' || f || '#Part' || k as id from p)"""


_graphs: dict[tuple[str, str], G.Graph] = {}


def _linked(spark, sf_dir):
    """The graph of the sources; its tables are checkpointed, so the queries of a session share them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = link.link(source_files(spark, sf_dir), source_locales(spark))
    return _graphs[key]


@query(f"""with {_SOURCE_SQL} select id, 'component' as kind, 5 as line from c union all select 'component:src/App.tsx#App', 'component', 2
union all select 'instance:' || f || ':13#Part' || h, 'instance', 13 from c where k <> h union all select unnest(['instance:src/App.tsx:3#Part1', 'instance:src/App.tsx:3#Part1~2']), 'instance', 3
union all select 'data-source:' || f || '#fetch:/api/v2/parts/' || k, 'data-source', 7 from c union all select 'data-source:' || f || '#fetch:/api/all', 'data-source', 8 from c
union all select 'state:' || f || '#Part' || k || '.open', 'state', 6 from c union all select 'event:' || f || '#Part' || k || '.click@14', 'event', 14 from c union all select 'event:' || f || '#Part' || k || '.pick@13', 'event', 13 from c
union all select distinct 'external:host' || (k % 3) || '.example.org', 'external', 15 from c union all select 'external:inbound', 'external', 3
union all select unnest(['route:src/App.tsx#/parts', 'route:src/App.tsx#/oauthCallback']), 'route', 3
union all select 'test:src/parts/Part' || k || '.test.tsx#Part' || k || '.test.tsx', 'test', 1 from c where k % 4 = 0""")
def extract_nodes(spark, sf_dir):
    return _linked(spark, sf_dir).nodes.select("id", "kind", "line")


@query(f"""with {_SOURCE_SQL}, i as (select unnest(['instance:src/App.tsx:3#Part1', 'instance:src/App.tsx:3#Part1~2']) as i)
select id as src, 'instance:' || f || ':13#Part' || h as dst, 'renders' as kind, null as via from c where k <> h union all select 'component:src/App.tsx#App', i, 'renders', null from i
union all select 'instance:' || f || ':13#Part' || h, 'component:src/parts/Part' || h || '.tsx#Part' || h, 'instance-of', null from c where k <> h union all select i, 'component:src/parts/Part1.tsx#Part1', 'instance-of', null from i
union all select 'data-source:' || f || '#fetch:/api/v2/parts/' || k, 'instance:' || f || ':13#Part' || h, 'provides-data', 'rows' from c where k <> h union all select 'data-source:' || f || '#fetch:/api/all', 'instance:' || f || ':13#Part' || h, 'provides-data', 'names' from c where k <> h
union all select id, 'data-source:' || f || '#fetch:/api/v2/parts/' || k, 'fetches-from', null from c union all select id, 'data-source:' || f || '#fetch:/api/all', 'fetches-from', null from c
union all select id, 'state:' || f || '#Part' || k || '.open', 'reads-state', null from c union all select id, 'event:' || f || '#Part' || k || '.click@14', 'handles', null from c union all select id, 'event:' || f || '#Part' || k || '.pick@13', 'handles', null from c
union all select 'event:' || f || '#Part' || k || '.click@14', 'state:' || f || '#Part' || k || '.open', 'writes-state', null from c
union all select id, 'external:host' || (k % 3) || '.example.org', 'exits-app', 'https://host' || (k % 3) || '.example.org/p' from c
union all select unnest(['route:src/App.tsx#/parts', 'route:src/App.tsx#/oauthCallback']), 'component:src/parts/Part1.tsx#Part1', 'routes-to', null union all select 'external:inbound', 'route:src/App.tsx#/oauthCallback', 'enters-at', null
union all select id, 'test:src/parts/Part' || k || '.test.tsx#Part' || k || '.test.tsx', 'covered-by', null from c where k % 4 = 0""")
def extract_edges(spark, sf_dir):
    return _linked(spark, sf_dir).edges.select("src", "dst", "kind", "via")


@query(f"""with {_SOURCE_SQL}, t as (select id, unnest([p_name, p_brand, 'Open', 'more']) as text, unnest(['jsx', 'attribute', 'jsx', 'jsx']) as source from c where k > 0
union all select id, unnest([p_name, p_brand, 'Open', 'more']), unnest(['jsx', 'attribute', 'jsx', 'jsx']) from c where k = 0
union all select id, unnest(['Art ' || (k % 5), 'Kind ' || (k % 5)]), 'i18n' from c where k % 5 < 4) select id, text, source from t""")
def extract_texts(spark, sf_dir):
    shown = _linked(spark, sf_dir).nodes.where("kind = 'component'").select("id", F.explode("renderedText").alias("t"))
    return shown.select("id", "t.text", "t.source")


@query(f"""with {_SOURCE_SQL} select 'data-source:' || f || '#fetch:/api/v2/parts/' || k as id, '/api/v2/parts/' || k as endpoint, 'GET' as method from c
union all select 'data-source:' || f || '#fetch:/api/all', '/api/all', 'POST' from c""")
def extract_sources(spark, sf_dir):
    return _linked(spark, sf_dir).nodes.where("kind = 'data-source'").select("id", "endpoint", "method")


@query(f"""with {_SOURCE_SQL} select id, 18 as end_line, 'title|size' as props, 1 as buttons, 1 as links, 1 as headings, 'Part' || h as renders from c
union all select 'component:src/App.tsx#App', 4, '', 0, 0, 0, 'Routes|Route|Part1'""")
def extract_components(spark, sf_dir):
    own = _linked(spark, sf_dir).nodes.where("kind = 'component'")
    return own.select("id", "end_line", F.array_join("props", "|").alias("props"), *[F.coalesce(f"structure.{c}", F.lit(0)).alias(f"{c}s") for c in ("button", "link", "heading")], F.array_join("rendersComponents", "|").alias("renders"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def stream_events_count(spark, sf_dir):
    return streams.event_counts(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matches for the terms, and everything that depends on them."""
    found = _ranked(M.match(part_components(spark, sf_dir), M.terms_of(spark, list(_TERMS))))
    graph = sales_graph(spark, sf_dir)
    best = found.join(F.broadcast(found.agg(F.max("score").alias("best"))), F.col("score") == F.col("best")).select(F.col("component_id").alias("origin"), F.col("component_id").alias("node"))
    return traverse.blast_radius(graph, best).select("origin", "node", "kind", "distance")
