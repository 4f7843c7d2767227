"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import keywords, quantised, search
from sparkloom.plans import bindings as B
from sparkloom.plans.registry import query

TOK = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), lambda w: w <> '')"
_WORDS = f"""words AS (SELECT doc_id::VARCHAR AS id, {TOK.format(c='text')} AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _bm25(k: int, queries: str) -> str:
    return f"""{_WORDS}, {queries},
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TOK.format(c='query')}) AS term FROM q)),
hits AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))::DOUBLE AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits) WHERE rank <= {k})"""


_BENCH = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query("token_stats", f"WITH {_WORDS} SELECT term, df FROM df")
def token_stats(spark, d):
    return search.term_statistics(B.chunk_cards(spark, d))[0]


@query("corpus_stats", f"WITH {_WORDS} SELECT n, round(mean, 6) AS mean_length FROM corpus")
def corpus_stats(spark, d):
    return search.term_statistics(B.chunk_cards(spark, d))[1].select("n", F.round("mean_length", 6).alias("mean_length"))


@query("bm25_topk", f"WITH {_bm25(10, _BENCH)} SELECT query_id, id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return keywords.search(B.keyword_index(spark, d), B.keyword_queries(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("search_code", f"WITH {_bm25(10, _BENCH)} SELECT query_id, bm.id, rank, source || '/' || doc_id || '.md' AS source, text AS content FROM bm JOIN documents ON doc_id::VARCHAR = bm.id")
def search_code(spark, d):
    return search.search_code(B.chunk_cards(spark, d), B.keyword_queries(spark, d), index=B.keyword_index(spark, d)).select("query_id", "id", "rank", "source", "content")


_VEC = """vq AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
dist AS (SELECT query_id, vec_id::VARCHAR AS id, list_sum(list_transform(list_zip(embedding, qv), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings, vq),
vec AS (SELECT *, 1 / (1 + distance) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= {k})"""


@query("vector_topk", f"WITH {_VEC.format(k=10)} SELECT query_id, id, round(distance, 6) AS distance, round(score, 6) AS score, rank FROM vec")
def vector_topk(spark, d):
    hits = search.vector_search(B.vectors(spark, d), B.vector_queries(spark, d), 10)
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@query("vector_cells")
def vector_cells(spark, d):
    """The inverted file: every vector indexed, every vector whose id is divisible by 20 asked."""
    rows = B.vectors(spark, d)
    centres = search.fit_cells(rows)
    hits = search.cell_search(search.index_cells(rows, centres), centres, B.vector_queries(spark, d), 10)
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_codes")
def vector_codes(spark, d):
    """Product-quantised codes: every vector encoded, every vector whose id is divisible by 20 asked, 200 full vectors read for each."""
    rows = B.vectors(spark, d)
    book = quantised.fit(rows)
    hits = quantised.search(quantised.encode(rows, book), rows, book, B.vector_queries(spark, d), 10)
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("score_threshold", f"WITH {_VEC.format(k=30)} SELECT query_id, id, round(score, 6) AS score FROM vec WHERE score >= 0.35")
def score_threshold(spark, d):
    hits = search.vector_search(B.vectors(spark, d), B.vector_queries(spark, d), 30)
    return search.above(hits, 0.35).select("query_id", "id", F.round("score", 6).alias("score"))


_HQ = "q AS (SELECT vec_id AS query_id, text AS query FROM embeddings JOIN benchmark ON item_id = vec_id // 20 WHERE vec_id % 20 = 0)"


def _hybrid_inputs(spark, d):
    words = B.keyword_queries(spark, d).select((F.col("query_id") * 20).alias("query_id"), "query")
    return B.vector_queries(spark, d).join(words, "query_id", "left")


@query(
    "rrf_hybrid",
    f"""WITH {_VEC.format(k=20)}, {_bm25(20, _HQ)},
fused AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS fused, v.distance FROM vec v FULL JOIN bm b USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, id) AS rank FROM fused)
SELECT query_id, id, rank, round(fused, 9) AS fused, round(1 / (1 + coalesce(distance, 0)), 6) AS score FROM r WHERE rank <= 20""",
)
def rrf_hybrid(spark, d):
    q = _hybrid_inputs(spark, d)
    v = search.vector_search(B.vectors(spark, d), q, 20)
    t = keywords.search(B.keyword_index(spark, d), q.filter("query is not null"), 20)
    return search.hybrid(v, t, 20).select("query_id", "id", "rank", F.round("fused", 9).alias("fused"), F.round("score", 6).alias("score"))


def _synonyms() -> str:
    return "syn(word, k, syn) AS (VALUES " + ", ".join(f"('{w}', {k}, '{s}')" for w, k, s in search.synonym_rows()) + ")"


_PARTS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[\s_-]+'), lambda w: w <> '')"
_EXPAND_PARTS = rf"""{_synonyms()},
q0 AS (SELECT item_id AS query_id, 'getUserAuth db-config rate limit ' || text AS query FROM benchmark),
w AS (SELECT query_id, query, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM (SELECT *, list_filter(regexp_split_to_array(trim(query), '\s+'), lambda x: x <> '') AS t FROM q0)),
c AS (SELECT *, regexp_replace(token, '^[^\w-]+|[^\w-]+$', '', 'g') AS core FROM w),
pt AS (SELECT query_id, p, lower(unnest(l)) AS part, generate_subscripts(l, 1) AS i FROM (SELECT query_id, p, {_PARTS.format(c='core')} AS l FROM c WHERE regexp_matches(core, '[_-]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]'))),
new AS (SELECT query_id, part AS n, [p, 0, i, 0] AS place FROM pt
  UNION ALL SELECT query_id, syn, [p, 1, k, 0] FROM c JOIN syn ON word = lower(core)
  UNION ALL SELECT query_id, syn, [p, 2, i, k] FROM pt JOIN syn ON word = part
  UNION ALL SELECT query_id, syn, [1000000000, 0, k, 0] FROM q0 JOIN syn ON contains(word, ' ') AND contains(lower(query), word)),

f AS (SELECT query_id, n, min(place) AS place FROM new GROUP BY ALL),
g AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = f.query_id AND lower(w.token) = f.n))"""
_EXPAND = f"""WITH {_EXPAND_PARTS} SELECT query_id, query || coalesce(' ' || string_agg(n, ' ' ORDER BY place), '') AS expanded FROM q0 LEFT JOIN g USING (query_id) GROUP BY query_id, query"""


@query("expand_query", _EXPAND)
def expand_query(spark, d):
    q = B.keyword_queries(spark, d)
    q = q.withColumn("query", F.concat(F.lit("getUserAuth db-config rate limit "), "query"))
    return search.expand_queries(q).select("query_id", "expanded")


def _mmr(pool: str, k: int, last: str = "picked") -> str:
    """SQL for greedy diversity: ``pool`` has query_id, id, score, rank and w (distinct words); one step of the recursion picks one row for each query."""
    return f"""like_ AS MATERIALIZED (SELECT a.query_id, a.id AS a, b.id AS b, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS s
  FROM {pool} a JOIN {pool} b ON a.query_id = b.query_id AND a.id <> b.id),
step AS (SELECT query_id, 1 AS pick, arg_min(id, [-round(0.6::DOUBLE * score, 9), rank]) AS id, [arg_min(id, [-round(0.6::DOUBLE * score, 9), rank])] AS done FROM {pool} GROUP BY query_id
  UNION ALL SELECT query_id, pick, id, list_append(done, id) FROM (SELECT c.query_id, c.pick + 1 AS pick, p.id, c.done,
    row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.6::DOUBLE * p.score - (1 - 0.6::DOUBLE) * (SELECT max(l.s) FROM like_ l WHERE l.query_id = c.query_id AND l.a = p.id AND list_contains(c.done, l.b)), 9) DESC, p.rank) AS k
    FROM step c JOIN {pool} p ON p.query_id = c.query_id AND NOT list_contains(c.done, p.id) WHERE c.pick < {k}) WHERE k = 1),
{last} AS (SELECT s.query_id, s.id, s.pick, p.score FROM step s JOIN {pool} p USING (query_id, id))"""


_POOL = f"pool AS MATERIALIZED (SELECT query_id, bm.id, score, rank, list_distinct({TOK.format(c='text')}) AS w FROM bm JOIN documents ON doc_id::VARCHAR = bm.id)"


@query("mmr_rerank", f"WITH RECURSIVE {_bm25(30, _BENCH)}, {_POOL}, {_mmr('pool', 10)} SELECT query_id, id, round(score, 6) AS score, pick FROM picked")
def mmr_rerank(spark, d):
    cards = B.chunk_cards(spark, d)
    pool = keywords.search(B.keyword_index(spark, d), B.keyword_queries(spark, d), 30).join(cards.select("id", "content"), "id")
    return search.diversify(pool, 10).select("query_id", "id", F.round("score", 6).alias("score"), "pick")


_FILL = f"""
WITH RECURSIVE {_bm25(10, _BENCH)},
s AS (SELECT query_id, bm.id, rank, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS snippet, substring(string_split(text, chr(10))[1], 1, 160) AS signature FROM bm JOIN documents ON doc_id::VARCHAR = bm.id),
c AS (SELECT *, (ceil(length(snippet) / 4) + ceil(length(signature) / 4) + 10)::INT AS cost FROM s),
f AS (SELECT query_id, 0::BIGINT AS rank, 0 AS spent, false AS taken FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT c.query_id, c.rank, CASE WHEN f.spent + c.cost <= 300 THEN f.spent + c.cost ELSE f.spent END, f.spent + c.cost <= 300 FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1)
SELECT query_id, id AS chunk_id, rank AS pick, snippet, cost FROM f JOIN c USING (query_id, rank) WHERE taken
"""


@query("budget_fill", _FILL)
def budget_fill(spark, d):
    cards = B.chunk_cards(spark, d)
    hits = keywords.search(B.keyword_index(spark, d), B.keyword_queries(spark, d), 10).join(cards, "id").withColumn("pick", F.col("rank").cast("long"))
    return search.fill_budget(hits, 300).select("query_id", "chunk_id", "pick", "snippet", "cost")


@query("search_context")
def search_context(spark, d):
    cards = B.chunk_cards(spark, d)
    both = cards.join(B.vectors(spark, d).select("id", "vector"), "id", "left")
    return search.search_context(both, _hybrid_inputs(spark, d).filter("query is not null"), index=B.keyword_index(spark, d))


# Expansion, keyword search, threshold, diversity and budget, each in SQL as above.
_DEGRADED = f"""WITH RECURSIVE {_EXPAND_PARTS.replace("'getUserAuth db-config rate limit ' || text", "text")}, e AS (SELECT query_id, query || coalesce(' ' || string_agg(n, ' ' ORDER BY place), '') AS query FROM q0 LEFT JOIN g USING (query_id) GROUP BY query_id, query),
{_bm25(30, "q AS (SELECT * FROM e)")}, pool AS MATERIALIZED (SELECT query_id, bm.id, score, rank, list_distinct({TOK.format(c='text')}) AS w FROM bm JOIN documents ON doc_id::VARCHAR = bm.id WHERE score >= 0.2),
{_mmr('pool', 10)},
shown AS (SELECT query_id, p.id, pick, score, source || '/' || doc_id || '.md' AS source, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS snippet, substring(string_split(text, chr(10))[1], 1, 160) AS signature, len(string_split(text, chr(10)))::INT AS end_line FROM picked p JOIN documents ON doc_id::VARCHAR = p.id),
costs AS (SELECT *, (ceil(length(snippet) / 4) + ceil(length(signature) / 4) + 10)::INT AS cost FROM shown),
fill AS (SELECT query_id, 0 AS pick, 0 AS spent, false AS taken FROM (SELECT DISTINCT query_id FROM costs)
  UNION ALL SELECT c.query_id, c.pick, CASE WHEN f.spent + c.cost <= 1200 THEN f.spent + c.cost ELSE f.spent END, f.spent + c.cost <= 1200 FROM fill f JOIN costs c ON c.query_id = f.query_id AND c.pick = f.pick + 1)
SELECT query_id, pick, id AS chunk_id, source, '' AS symbol, signature, snippet, round(score, 3) AS score, 1 AS start_line, end_line, cost, true AS degraded, 'lexical' AS mode FROM fill JOIN costs USING (query_id, pick) WHERE taken"""


@query("search_context_degraded", _DEGRADED)
def search_context_degraded(spark, d):
    return search.search_context_degraded(B.chunk_cards(spark, d), B.keyword_queries(spark, d), index=B.keyword_index(spark, d))


@query("expand_context", "SELECT doc_id::VARCHAR AS id, source || '/' || doc_id || '.md' AS source, text AS content FROM documents WHERE doc_id = 7")
def expand_context(spark, d):
    return B.chunk_cards(spark, d).filter(F.col("id") == "7").select("id", "source", "content")


@query(
    "jaccard_neighbours",
    f"""WITH t AS (SELECT item_id, list_distinct({TOK.format(c='text')}) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS likeness FROM t a, t b WHERE a.item_id % 20 = 0""",
)
def jaccard_neighbours(spark, d):
    t = B.table(spark, d, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w"))
    a = t.filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("a"), F.col("w").alias("_a"))  # the stated query set
    if a.limit(search.MOST_QUERIES + 1).count() > search.MOST_QUERIES:
        raise ValueError("too many queries to broadcast; ask in slices")
    both = t.select(F.col("item_id").alias("b"), "w").join(F.broadcast(a))
    return both.select("a", "b", F.round(X.jaccard(F.col("_a"), F.col("w")), 6).alias("likeness"))
