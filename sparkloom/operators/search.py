"""Retrieval over chunks: exact vectors, BM25, rank fusion, diversity, token budget, and the searches composed of them.

A query is a row, so a job answers any number of queries. The lexical leg reads all chunks against a block of queries whose size is checked: in each Arrow batch the
weights of the queries' terms are multiplied with the queries, and a task gives no more than the best k hits of each query, so no hit is shuffled that cannot be among them.
A larger set, or a stored index, goes by postings: queries' terms meet them in an equality join. The vector leg is a scan of all vectors against a checked number of queries at a time, with a top-k
per query that each task takes before the shuffle; an inverted file of cells, fitted on a bounded sample, saves most of that scan where less than all of the nearest will do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.operators import keywords
from sparkloom.operators.keywords import K1, B, Best
from sparkloom.operators.ordering import global_position
from sparkloom.session import bounded, stage, width

FUSION = 60
SCORE_THRESHOLD, MMR_LAMBDA = 0.2, 0.6
TOKEN_BUDGET, SNIPPET_LINES = 1200, 5
#: Most queries whose vectors are broadcast in one job (times the dimension, some tens of MB).
MOST_QUERIES = 50_000
#: Queries that meet all vectors in one pass, and vectors that meet them as one block, which then takes some tens of MB.
SLICE, BLOCK = 8192, 512
#: Most queries, and most of their terms, that meet all chunks as one block; a block of ``ROWS`` chunks then takes some tens of MB.
BLOCK_QUERIES, BLOCK_TERMS, ROWS = 2048, 32768, 128


def search_limit(limit: int) -> int:
    return min(max(limit, 1), 50)


def fan_out(limit: int) -> int:
    return max(3 * search_limit(limit), 20)


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query in ``order``, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)


def squared_distance(a: Column, b: Column) -> Column:
    """The squared Euclidean distance of two arrays of floats, summed in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """query_id, id, distance, score, rank of the ``k`` nearest chunks of each query (``query_id``, ``query_vector``). Exact."""
    return _in_slices(queries.select("query_id", "query_vector"), lambda q: _nearest(chunks.select("id", F.col(vector).alias("vector")), q, k))


def _in_slices(queries: DataFrame, search) -> DataFrame:
    """``search`` of all queries, or of slices of them that may be held by every task, each against all rows."""
    if queries.limit(SLICE + 1).count() <= SLICE:
        return search(queries)
    placed = stage(global_position(queries, [F.col("query_id")], "_at", "_all").withColumn("_slice", F.floor(F.col("_at") / SLICE)).drop("_at", "_all"), "slices")
    parts = [search(placed.filter(F.col("_slice") == i).drop("_slice")) for i in range(placed.agg(F.max("_slice")).first()[0] + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length without nulls: their places, and the vectors as doubles. Others have no distance to any."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(at)).flatten()
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), n).all(axis=1)
        yield at[whole], pc.cast(flat.fill_null(0), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)[whole]


class Nearest:
    """The ``k`` nearest rows of each query among blocks of vectors, by distance and id.

    A matrix product tells which rows cannot be among them, with room for its rounding; only the others' distances are taken, summed in the order of the vector."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.q, self.d, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.most = np.full(queries, np.inf)

    def add(self, which: np.ndarray, y: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``x`` meet the vectors ``y`` of the queries ``which``."""
        with np.errstate(all="ignore"):
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            room = 1e-9 * (xx[:, None] + yy[None, :])
            about = np.nan_to_num(xx[:, None] + yy[None, :] - 2 * (x @ y.T) - room, nan=-np.inf)
            if len(ids) > self.k and np.isinf(self.most[which]).any():
                self.most[which] = np.minimum(self.most[which], np.partition(about + 2 * room, self.k - 1, axis=0)[self.k - 1])
            row, q = np.nonzero(~(about > self.most[which][None, :]))
            for a in range(0, len(row), 1 << 16):
                r, c = row[a : a + (1 << 16)], q[a : a + (1 << 16)]
                gaps = x[r] - y[c]
                far = np.cumsum(gaps * gaps, axis=1)[:, -1] if gaps.shape[1] else np.zeros(len(r))
                self.q, self.d, self.i = np.concatenate((self.q, which[c])), np.concatenate((self.d, far)), np.concatenate((self.i, ids[r]))
                if len(self.q) > 4 * self.k * self.queries:
                    self._cut()

    def _cut(self) -> None:
        names = {v: n for n, v in enumerate(sorted(set(self.i.tolist()), key=lambda v: (v is not None, v)))}
        order = np.lexsort((np.array([names[v] for v in self.i.tolist()], np.int64), self.d, self.q))
        q = self.q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(self.queries))[q]
        full = np.flatnonzero(rank == self.k - 1)
        last = np.where(np.isnan(self.d[order][full]), np.inf, self.d[order][full])
        self.most[q[full]] = np.minimum(self.most[q[full]], last)
        keep = order[rank < self.k]
        self.q, self.d, self.i = self.q[keep], self.d[keep], self.i[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.q, self.i, self.d


def _nearest(chunks: DataFrame, queries: DataFrame, k: int, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The queries, a slice at most, go to every task; ``chunks`` (id, vector, and cell where only the ``probes`` nearest ``centres`` of a query are looked at) are dealt out, for few bytes of vectors are much work."""
    spark = chunks.sparkSession
    asked = queries.select("query_id", "query_vector").toArrow().combine_chunks()
    column = lambda name: asked.column(name).combine_chunks() if asked.num_rows else pa.array([], asked.schema.field(name).type)
    held = [(at, y, None if centres is None or not y.shape[1] == centres.shape[1] else cell_of(y.astype(np.float32), centres, probes)) for at, y in _by_length(column("query_vector"))]
    shared = spark.sparkContext.broadcast((column("query_id"), held))
    kind, name = chunks.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", name), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sides = shared.value
        best, of = Nearest(len(names), k), pa.string()
        for batch in batches:
            of = batch.column("id").type
            ids, vectors = np.array(batch.column("id").to_pylist(), object), batch.column("vector")
            cells = batch.column("cell").to_numpy() if centres is not None else None
            for at, x in _by_length(vectors):
                for which, y, near in sides:
                    if y.shape[1] != x.shape[1]:
                        continue
                    if near is None:
                        best.add(which, y, x, ids[at])
                        continue
                    for cell in np.unique(cells[at]).tolist():
                        rows, some = np.flatnonzero(cells[at] == cell), np.flatnonzero((near == cell).any(axis=1))
                        if len(some):
                            best.add(which[some], y[some], x[rows], ids[at[rows]])
        q, i, d = best.rows()
        if len(q):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i.tolist(), of), pa.array(d)], names=["query_id", "id", "distance"])

    near = chunks.repartition(width(spark)).mapInArrow(bounded(run, BLOCK), schema)
    return top(near, k, F.col("distance"), F.col("id")).withColumn("score", X.closeness(F.col("distance")))


def fit_cells(chunks: DataFrame, cells: int = 128, sample: int = 20_000, rounds: int = 12, vector: str = "vector") -> np.ndarray:
    """Centres of an inverted file, by k-means on the ``sample`` vectors with the least hash of their id (a documented bound; every row is indexed afterwards)."""
    rows = chunks.filter(F.col(vector).isNotNull()).select("id", vector).orderBy(F.xxhash64("id")).limit(sample).collect()
    x = np.array([r[vector] for r in rows], np.float32)
    if not len(x):
        return np.zeros((0, 0), np.float32)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = cell_of(x, centres, 1)[:, 0]
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def cell_of(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    far = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def index_cells(chunks: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """``chunks`` with ``cell``, for every row that has a vector; to be stored by cell."""
    shared = chunks.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_of(np.stack(v.to_numpy()).astype(np.float32), shared.value, 1)[:, 0]) if len(v) else pd.Series([], dtype="int32")

    return chunks.filter(F.col(vector).isNotNull()).withColumn("cell", cell(vector))


def cell_search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 64, vector: str = "vector") -> DataFrame:
    """As ``vector_search``, over the ``probes`` nearest cells of each query only; distances are exact. A hot cell is spread over the tasks, for the queries go to the rows."""
    rows = indexed.select("id", F.col(vector).alias("vector"), "cell")
    return _in_slices(queries.select("query_id", "query_vector"), lambda q: _nearest(rows, q, k, centres, probes))


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """id, term, tf, length: one row for each distinct term of a chunk."""
    words = chunks.select("id", X.all_tokens(F.col(text)).alias("_w")).withColumn("length", F.size("_w"))
    return words.select("id", "length", F.explode("_w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(chunks: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row with the number of chunks and their mean length in terms."""
    words = chunks.select("id", X.all_tokens(F.col(text)).alias("_w"))
    df = words.select(F.explode(F.array_distinct("_w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("_w")).alias("mean_length"))
    return df, corpus


def bm25(chunks: DataFrame, queries: DataFrame, k: int, text: str = "content") -> DataFrame:
    """query_id, id, score, rank of the ``k`` best chunks for each query (``query_id``, ``query``); any term may match. A null text has no words."""
    asked = queries.select("query_id", X.tokens(F.coalesce("query", F.lit(""))).alias("_t")).limit(BLOCK_QUERIES + 1).collect()
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["_t"]}))}
    if len(asked) > BLOCK_QUERIES or len(vocabulary) > BLOCK_TERMS:
        return bm25_of_postings(postings(chunks, text), chunks.agg(F.count("*").alias("n"), F.avg(F.size(X.all_tokens(F.coalesce(text, F.lit(""))))).alias("mean_length")), queries, k)
    return _bm25_in_blocks(chunks, queries, asked, vocabulary, k, text)


_WORDS = re.compile("[a-z0-9_]+")


def _bm25_in_blocks(chunks: DataFrame, queries: DataFrame, asked: list, vocabulary: dict[str, int], k: int, text: str) -> DataFrame:
    spark = chunks.sparkSession
    named = chunks.select("id", F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    words = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many chunks of a task have each word; under -1 and -2 the chunks and all their words."""
        known, have, n, length = words.value, Counter(), 0, 0
        for batch in batches:
            for t in batch.column("_text").to_pylist():
                found = _WORDS.findall(t)
                n, length = n + 1, length + len(found)
                have.update(known[w] for w in set(found) if w in known)
        have.update({-1: n, -2: length})
        yield pa.RecordBatch.from_arrays([pa.array(list(have.keys()), pa.int32()), pa.array(list(have.values()), pa.int64())], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in named.select("_text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = counted.get(-1, 0)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {chunks.schema['id'].dataType.simpleString()}, score double"
    if not n or not vocabulary:
        return top(spark.createDataFrame([], schema), k, F.col("score"))
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = counted.get(-2, 0) / n
    cells = [(vocabulary[t], j) for j, r in enumerate(asked) for t in r["_t"]]
    shared = spark.sparkContext.broadcast((vocabulary, idf, mean, np.array(cells, np.int32).reshape(-1, 2), [r["query_id"] for r in asked]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, average, pairs, names = shared.value
        matrix = np.zeros((len(known), len(names)))
        matrix[pairs[:, 0], pairs[:, 1]] = weight[pairs[:, 0]]
        best = Best(len(names), k)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("_text").to_pylist()
            for a in range(0, len(ids), ROWS):
                part = texts[a : a + ROWS]
                tf = np.zeros((len(part), len(known)))
                length = np.zeros(len(part))
                for i, t in enumerate(part):
                    found = _WORDS.findall(t)
                    length[i] = len(found)
                    for w, m in Counter(found).items():
                        if (at := known.get(w)) is not None:
                            tf[i, at] = m
                has = np.flatnonzero(tf.any(axis=0))
                tf = tf[:, has]
                tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[:, None] / average)) if average else tf
                best.add(tf @ matrix[has], np.array(ids[a : a + ROWS], object))
        q, i, s = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q], types[0]), pa.array(i.tolist(), types[1]), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    types = [pa.string() if f == "string" else pa.int64() if f == "bigint" else pa.int32() for f in (schema.split()[1].rstrip(","), schema.split()[3].rstrip(","))]
    hits = named.mapInArrow(score, schema)
    return top(hits, k, F.round("score", 9).desc(), F.col("id"))


def bm25_of_postings(index: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``bm25``, from postings (id, term, tf, length) and one row with n and mean_length. Stored in the order of terms, few of an index's row groups are read for a query."""
    terms = queries.select("query_id", F.explode(X.tokens(F.coalesce("query", F.lit("")))).alias("term"))
    tf = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("length") / F.col("mean_length")))
    scored = tf.join(df, "term").join(F.broadcast(corpus)).select("id", "term", weight.alias("_s"))
    hits = scored.join(terms, "term").groupBy("query_id", "id").agg(F.sum("_s").alias("score"))
    return top(hits, k, F.round("score", 9).desc(), F.col("id"))


def hybrid(vectors: DataFrame, lexical: DataFrame, k: int, faithful: bool = True) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs: query_id, id, fused, distance, score, rank.

    The reported score is the closeness in the vector leg; a hit of the lexical leg alone has no distance and
    scores 1.0. ``faithful=False`` reports the fused score instead.
    """
    v = vectors.select("query_id", "id", "distance", F.col("rank").alias("_v"))
    t = lexical.select("query_id", "id", F.col("rank").alias("_t"))
    part = lambda c: F.coalesce(1.0 / (F.lit(FUSION) + F.col(c)), F.lit(0.0))
    both = v.join(t, ["query_id", "id"], "full_outer").withColumn("fused", part("_v") + part("_t"))
    fused = top(both, k, F.round("fused", 12).desc(), F.col("id"))
    score = X.closeness(F.coalesce("distance", F.lit(0.0))) if faithful else F.col("fused")
    return fused.withColumn("score", score).drop("_v", "_t")


def above(df: DataFrame, least: float = SCORE_THRESHOLD) -> DataFrame:
    return df.filter(F.col("score") >= least)


def diversify(pool: DataFrame, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance: of each query's ``pool`` (query_id, id, score, rank, content) picks ``k``.

    A pool is bounded by the fan-out, so a group in Pandas is small. Ties (to nine digits) go to the better input rank.
    """
    schema = "query_id long, id string, score double, content string, pick int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        words = [set(w) for w in pdf["_tokens"]]
        scores, like = pdf["score"].tolist(), [0.0] * len(pdf)
        left, order = list(range(len(pdf))), []
        while left and len(order) < k:
            best = max(left, key=lambda i: (round(weight * scores[i] - (1 - weight) * like[i], 9), -i))
            left.remove(best)
            order.append(best)
            for i in left:
                union = len(words[i] | words[best])
                like[i] = max(like[i], len(words[i] & words[best]) / union if union else 1.0)
        out = pdf.iloc[order][["query_id", "id", "score", "content"]].copy()
        out["pick"] = range(1, len(order) + 1)
        return out

    typed = pool.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("string").alias("id"), "score", "rank", "content", X.tokens(F.col("content")).alias("_tokens"))
    return typed.groupBy("query_id").applyInPandas(pick, schema)


def fill_budget(picked: DataFrame, budget: int = TOKEN_BUDGET, lines: int = SNIPPET_LINES) -> DataFrame:
    """Takes each query's picks in order while they fit; one too large is skipped and the next tried.

    ``picked``: query_id, id, source, symbol_name, signature, content, score, start_line, end_line, pick. A fold over a bounded array, in the JVM.
    """
    snip = X.snippet(F.col("content"), lines)
    cost = X.estimated_tokens(snip) + X.estimated_tokens(F.col("signature")) + 10
    row = F.struct(
        "pick", F.col("id").alias("chunk_id"), "source", F.col("symbol_name").alias("symbol"), "signature", snip.alias("snippet"),
        F.round("score", 3).alias("score"), "start_line", "end_line", cost.cast("int").alias("cost"),
    )
    grouped = picked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kept = F.aggregate(
        F.col("_rows"),
        F.struct(F.lit(0).alias("spent"), F.slice(F.col("_rows"), 1, 0).alias("out")),
        lambda acc, x: F.when(
            acc["spent"] + x["cost"] <= budget, F.struct((acc["spent"] + x["cost"]).alias("spent"), F.concat(acc["out"], F.array(x)).alias("out"))
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    return grouped.select("query_id", F.explode(kept).alias("_x")).select("query_id", "_x.*")


def of_module(chunks: DataFrame, module: str | None) -> DataFrame:
    """The chunks to search, before any top-k is taken of them."""
    return chunks if module is None else chunks.filter(F.col("module") == module)


def _finish(hits: DataFrame, chunks: DataFrame, limit: int, weight: float, budget: int, lines: int) -> DataFrame:
    cards = chunks.select("id", "content", "source", "module", "symbol_name", "signature", "start_line", "end_line")
    pool = above(hits).select("query_id", "id", "score", "rank").join(cards, "id")
    picked = diversify(pool, search_limit(limit), weight)
    cards = pool.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("string").alias("id"), "source", "symbol_name", "signature", "start_line", "end_line")
    return fill_budget(picked.join(cards, ["query_id", "id"]), budget, lines)


def keyword_leg(chunks: DataFrame, queries: DataFrame, k: int, module: str | None = None, index: keywords.Index | None = None) -> DataFrame:
    """BM25 from the stored index of ``chunks`` where there is one; within a module by a scan of it, for its own counts decide there."""
    return keywords.search(index, queries, k) if index is not None and module is None else bm25(of_module(chunks, module), queries, k)


def search_context(chunks: DataFrame, queries: DataFrame, limit: int = 10, module: str | None = None, faithful: bool = True, index: keywords.Index | None = None) -> DataFrame:
    """Hybrid search with threshold, diversity and budget. Queries need query_id, query and query_vector. ``module`` filters; it is off by default.
    Chunks without a vector are found by their words alone."""
    k = fan_out(limit)
    words, chunks = keyword_leg(chunks, queries, k, module, index), of_module(chunks, module)
    legs = hybrid(vector_search(chunks, queries, k), words, k, faithful)
    return _finish(legs, chunks, limit, MMR_LAMBDA, TOKEN_BUDGET, SNIPPET_LINES)


def search_context_degraded(chunks: DataFrame, queries: DataFrame, limit: int = 10, module: str | None = None, index: keywords.Index | None = None) -> DataFrame:
    """Without vectors: BM25 on the expanded query, then threshold (on the raw score), diversity and budget; flagged."""
    expanded = expand_queries(queries).select("query_id", F.col("expanded").alias("query"))
    out = _finish(keyword_leg(chunks, expanded, fan_out(limit), module, index), of_module(chunks, module), limit, MMR_LAMBDA, TOKEN_BUDGET, SNIPPET_LINES)
    return out.withColumn("degraded", F.lit(True)).withColumn("mode", F.lit("lexical"))


def search_code(chunks: DataFrame, queries: DataFrame, limit: int = 10, index: keywords.Index | None = None) -> DataFrame:
    """BM25 on the query as it is; whole content, no threshold."""
    return keyword_leg(chunks, queries, search_limit(limit), None, index).join(chunks.select("id", "source", "content"), "id")


#: Abbreviations and what they stand for; each pair works both ways.
SYNONYMS = [
    ("auth", "authentication"), ("cfg", "config"), ("config", "configuration"), ("btn", "button"), ("throttle", "rate limit"), ("db", "database"),
    ("msg", "message"), ("err", "error"), ("fn", "function"), ("func", "function"), ("repo", "repository"), ("dir", "directory"),
    ("init", "initialize"), ("async", "asynchronous"), ("sync", "synchronous"), ("impl", "implementation"), ("ctx", "context"),
    ("env", "environment"), ("req", "request"), ("res", "response"), ("resp", "response"), ("arg", "argument"), ("param", "parameter"),
    ("auth", "authorization"), ("pkg", "package"), ("dep", "dependency"), ("deps", "dependencies"), ("util", "utility"), ("utils", "utilities"),
    ("lib", "library"), ("src", "source"), ("dest", "destination"), ("idx", "index"), ("obj", "object"), ("arr", "array"), ("str", "string"),
    ("num", "number"), ("bool", "boolean"), ("temp", "temporary"),
]


def synonym_rows() -> list[tuple[str, int, str]]:
    """(word, order among its synonyms, synonym), both ways."""
    out: list[tuple[str, int, str]] = []
    count: dict[str, int] = {}
    for pair in SYNONYMS:
        for word, other in (pair, pair[::-1]):
            out.append((word, count.setdefault(word, 0), other))
            count[word] += 1
    return out


def expand_queries(queries: DataFrame) -> DataFrame:
    """Adds ``expanded``: the query, then the parts of its identifiers and synonyms, each once, in order of appearance.

    Relational: words of a query are rows, parts and synonyms are joined to them, and each new word's first place decides.
    """
    spark = queries.sparkSession
    pairs = spark.createDataFrame(synonym_rows(), "_word string, _k int, _syn string")
    raw = X.trimmed(F.coalesce("query", F.lit("")))
    words = queries.select("query_id", "query", F.posexplode(F.filter(F.split(raw, r"(?U)\s+"), lambda w: w != "")).alias("_p", "_token"))
    core = words.withColumn("_core", X.strip_edges(F.col("_token"))).filter("_core <> ''")
    parts = core.filter(X.has_boundary(F.col("_core"))).select("query_id", "_p", F.posexplode(X.identifier_words(F.col("_core"))).alias("_i", "_part"))
    parts = parts.withColumn("_part", F.lower("_part"))
    place = lambda *p: F.struct(*(x.cast("int").alias(f"p{k}") for k, x in enumerate(p))).alias("_at")
    one = parts.select("query_id", F.col("_part").alias("_new"), place(F.col("_p"), F.lit(0), F.col("_i"), F.lit(0)))
    own = core.withColumn("_word", F.lower("_core")).join(F.broadcast(pairs), "_word")
    two = own.select("query_id", F.col("_syn").alias("_new"), place(F.col("_p"), F.lit(1), F.col("_k"), F.lit(0)))
    deep = parts.join(F.broadcast(pairs), F.col("_part") == F.col("_word"))
    three = deep.select("query_id", F.col("_syn").alias("_new"), place(F.col("_p"), F.lit(2), F.col("_i"), F.col("_k")))
    phrases = pairs.filter(F.col("_word").contains(" "))
    whole = queries.select("query_id", F.lower(raw).alias("_all")).join(F.broadcast(phrases), F.col("_all").contains(F.col("_word")))
    four = whole.select("query_id", F.col("_syn").alias("_new"), place(F.lit(1 << 30), F.lit(0), F.col("_k"), F.lit(0)))
    new = one.unionByName(two).unionByName(three).unionByName(four).groupBy("query_id", "_new").agg(F.min("_at").alias("_at"))
    known = words.select("query_id", F.lower("_token").alias("_new")).distinct()
    fresh = new.join(known, ["query_id", "_new"], "left_anti")
    tail = fresh.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_new"))), lambda x: x["_new"]), " ").alias("_tail"))
    joined = queries.join(tail, "query_id", "left")
    return joined.withColumn("expanded", F.when(F.col("_tail").isNull(), F.coalesce("query", F.lit(""))).otherwise(F.concat("query", F.lit(" "), F.col("_tail")))).drop("_tail")
