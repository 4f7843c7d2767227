"""A stored keyword index: postings in blocks of chunks, with what bounds a block's scores, and BM25 over it.

The index is four tables. ``postings`` has one row for each term of a block of up to ``CHUNKS`` chunks: the places of the chunks that have it, how often, and for the
bound the most often and the shortest of them. ``members`` has the ids and lengths of a block's chunks, ``terms`` the document counts and ``corpus`` the sizes. Postings are
written in the order of (bucket, term, block), a bucket being a hash of the term, so a scan filtered by the buckets of a search's own words skips the files, row groups and pages of all others.

A search knows its words' counts, and so every block's greatest possible score, before it has read any posting list: only ``most`` and ``least`` are needed for that. For few queries the most
promising blocks are scored first; the k-th score found there is a floor, and blocks that cannot reach it are never read. What is left is scored block by block: the posting rows of
a block meet its members in one task, each row moves once however many queries have its term, and a task passes on no more than the best k hits of each query. Results are those of a scan.

The index grows by segments: new chunks are indexed as blocks of their own, counts are sums of differences, and chunks that went are named in ``gone`` with the last segment in
which they count no more. ``gone`` is bounded by ``MOST_GONE``: whoever maintains an index builds it anew before there are more (``changed`` says when).

Defined cases: a null text has no words, but counts as a chunk; a query without words finds nothing; equal scores (to nine digits) go to the smaller id; a chunk of any length is one member; repeated ids in one segment are members of
their own, each with its score; an empty table gives an empty index that finds nothing.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.ordering import global_position
from sparkloom.session import bounded, drop, stage, width

K1, B = 1.2, 0.75
#: Chunks of a block, buckets of terms, segments and gone chunks up to which an index is kept.
CHUNKS, BUCKETS, MOST_SEGMENTS, MOST_GONE = 128, 64, 16, 50_000
#: Queries whose words are sent to the tasks at once, and words in all; queries up to which blocks are pruned; blocks scored first for each of them.
SLICE, SLICE_WORDS, PRUNED, SEEDS = 2048, 1_000_000, 64, 8
#: Blocks up to which the ones to read are written into the filter of the scan.
NAMED_BLOCKS = 2000
SCHEMAS = {
    "postings": "bucket int, term string, segment long, block long, most int, least int, slots array<int>, tfs array<int>",
    "members": "segment long, block long, ids array<string>, lengths array<int>",
    "terms": "bucket int, term string, df long",
    "corpus": "n long, words long",
    "gone": "id string, upto long",
}
_WORDS = re.compile("[a-z0-9_]+")
_RAW = "term string, block long, most int, least int, slots array<int>, tfs array<int>, ids array<string>, lengths array<int>"


@dataclass(frozen=True)
class Index:
    """The tables of an index."""

    postings: DataFrame
    members: DataFrame
    terms: DataFrame
    corpus: DataFrame
    gone: DataFrame | None = None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of their task, ``CHUNKS`` to a block: one row of members (its term null), then one for each term."""
    block = TaskContext.get().partitionId() << 33
    ids: list[str] = []
    lengths: list[int] = []
    have: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

    def made() -> pa.RecordBatch:
        names = sorted(have)
        slots, tfs = [have[t][0] for t in names], [have[t][1] for t in names]
        columns = [
            [None, *names],
            [block] * (len(names) + 1),
            [0, *map(max, tfs)],
            [0, *(min(lengths[s] for s in own) for own in slots)],
            [None, *slots],
            [None, *tfs],
            [ids, *[None] * len(names)],
            [lengths, *[None] * len(names)],
        ]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _RAW.split(", ")])

    for batch in batches:
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            words = _WORDS.findall(text)
            for t, m in Counter(words).items():
                own = have[t]
                own[0].append(len(ids))
                own[1].append(m)
            ids.append(name)
            lengths.append(len(words))
            if len(ids) == CHUNKS:
                yield made()
                ids, lengths, have, block = [], [], defaultdict(lambda: ([], [])), block + 1
    if ids:
        yield made()


def bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def segment(chunks: DataFrame, number: int = 0, text: str = "content") -> dict[str, DataFrame]:
    """The rows that ``chunks`` (id and a text) add to each table of an index."""
    rows = chunks.select(F.col("id").cast("string").alias("id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    raw = stage(rows.mapInArrow(bounded(_blocks, 2000, 8 << 20), _RAW), "postings")
    of, members = raw.filter("term is not null"), raw.filter("term is null")
    own = F.lit(number).cast("long").alias("segment")
    return {
        "postings": of.select(bucket("term"), "term", own, "block", "most", "least", "slots", "tfs"),
        "members": members.select(own, "block", "ids", "lengths"),
        "terms": of.groupBy("term").agg(F.sum(F.size("slots")).cast("long").alias("df")).select(bucket("term"), "term", "df"),
        "corpus": members.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0)).cast("long").alias("words")),
    }


def removal(chunks: DataFrame, upto: int, text: str = "content") -> dict[str, DataFrame]:
    """The rows that take ``chunks`` (as they were indexed, in segments up to ``upto``) out of an index."""
    words = chunks.select(F.col("id").cast("string").alias("id"), X.all_tokens(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_w"))
    each = words.select(F.explode(F.array_distinct("_w")).alias("term"))
    return {
        "gone": words.select("id", F.lit(upto).cast("long").alias("upto")).distinct(),
        "terms": each.groupBy("term").agg((-F.count("*")).alias("df")).select(bucket("term"), "term", "df"),
        "corpus": words.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum(F.size("_w")), F.lit(0)).cast("long").alias("words")),
    }


def changed(index: Index | None, number: int, before: DataFrame, after: DataFrame, whole: DataFrame) -> tuple[dict[str, DataFrame], bool]:
    """What to write when chunks ``before`` give way to ``after`` in segment ``number``, and whether it replaces the index (built from ``whole``) instead of being added to it.

    Chunks whose id and content stay are not indexed again."""
    if index is not None and number % MOST_SEGMENTS:
        same = ["id", "content"]
        fresh, old = after.join(before.select(same), same, "left_anti"), before.join(after.select(same), same, "left_anti")
        if index.gone.count() + old.count() <= MOST_GONE:
            new, less = segment(fresh, number), removal(old, number - 1)
            return {t: less[t] if t not in new else new[t].unionByName(less[t]) if t in less else new[t] for t in SCHEMAS}, False
    made = segment(whole, 0)
    return made | {"gone": whole.sparkSession.createDataFrame([], SCHEMAS["gone"])}, True


def laid_out(name: str, rows: DataFrame) -> DataFrame:
    """Rows of a table of an index in the order in which scans skip best; a common term's blocks are spread over files."""
    order = {"postings": ["bucket", "term", "segment", "block"], "terms": ["bucket", "term"], "members": ["segment", "block"]}.get(name)
    return rows.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order) if order else rows


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, rows in tables.items():
        laid_out(name, rows).write.option("compression", "zstd").parquet(f"{folder}/{name}")


def of_buckets(rows: DataFrame, buckets: list[int]) -> DataFrame:
    """Rows of some buckets, by a filter that reaches the scan value by value, however many they are."""
    return rows.filter(functools.reduce(lambda a, b: a | b, [F.col("bucket") == x for x in buckets], F.lit(False))) if len(buckets) < BUCKETS else rows


def read(spark: SparkSession, folder: str) -> Index:
    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

    return Index(table("postings"), table("members"), table("terms"), table("corpus"))


def build(chunks: DataFrame, folder: str, text: str = "content") -> Index:
    """An index of all ``chunks`` stored below ``folder``."""
    write(segment(chunks, 0, text), folder)
    return read(chunks.sparkSession, folder)


class Best:
    """The best ``k`` rows of each query among blocks of scores: by score to nine digits, then by id. Rows without a score are no hits."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.least = np.zeros(queries)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        rounded = np.round(scores, 9)
        if len(ids) > self.k:
            self.least = np.maximum(self.least, np.partition(rounded, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, q = np.nonzero((scores > 0) & (rounded >= self.least[None, :]))
        if len(row):
            self.q, self.s, self.i = np.concatenate((self.q, q)), np.concatenate((self.s, scores[row, q])), np.concatenate((self.i, ids[row]))
            if len(self.q) > 4 * self.k * self.queries:
                self._cut()

    def _cut(self) -> None:
        rounded = np.round(self.s, 9)
        place = np.empty(len(self.i), np.int64)
        place[np.argsort(self.i, kind="stable")] = np.arange(len(self.i))
        order = np.lexsort((place, -rounded, self.q))
        q = self.q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(self.queries))[q]
        full = np.flatnonzero(rank == self.k - 1)
        self.least[q[full]] = np.maximum(self.least[q[full]], rounded[order][full])
        keep = order[rank < self.k]
        self.q, self.s, self.i = self.q[keep], self.s[keep], self.i[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.q, self.i, self.s


def _scorer(shared, k: int):
    """Posting rows and members, sorted by block, as the best k hits of each query that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mean, gone, queries = shared.value
        best = Best(queries, k)
        at, rows, ids, lengths = None, [], None, None

        def settle() -> None:
            if ids is None or not rows:
                return
            norm = K1 * (1 - B + B * np.array(lengths, float) / mean)
            # Queries of this block's terms only, so a block's scores are small however many queries there are.
            asked = np.unique(np.concatenate([known[t][1] for t, _, _ in rows]))
            scores = np.zeros((len(ids), len(asked)))
            for t, slots, tfs in rows:
                idf, qs = known[t]
                slots, tf = np.array(slots), np.array(tfs, float)
                scores[np.ix_(slots, np.searchsorted(asked, qs))] += (idf * tf * (K1 + 1) / (tf + norm[slots]))[:, None]
            if gone:
                scores[[i for i, x in enumerate(ids) if gone.get(x, -1) >= at[0]]] = 0.0
            full = np.zeros((len(ids), queries))
            full[:, asked] = scores
            best.add(full, np.array(ids, object))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("segment", "block", "term", "slots", "tfs", "ids", "lengths"))
            for s, b, term, slots, tfs, own, sizes in zip(*columns):
                if (s, b) != at:
                    settle()
                    at, rows, ids, lengths = (s, b), [], None, None
                if term is None:
                    ids, lengths = own, sizes
                else:
                    rows.append((term, slots, tfs))
        settle()
        q, i, x = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i.tolist(), pa.string()), pa.array(x, pa.float64())], names=["_q", "id", "score"])

    return run


def _scored(index: Index, words: DataFrame, buckets: list[int], blocks: DataFrame | None, shared, k: int) -> DataFrame:
    """(_q, id, score): hits in ``blocks`` (segment, block; all if None), no more than k of a query from each task."""
    postings, members = of_buckets(index.postings, buckets).drop("bucket"), index.members
    if blocks is not None:
        few = blocks.limit(NAMED_BLOCKS + 1).collect()
        if len(few) <= NAMED_BLOCKS:  # then scans can skip row groups by them
            named = F.col("block").isin([r["block"] for r in few])
            postings, members = postings.filter(named), members.filter(named)
        postings, members = postings.join(blocks, ["segment", "block"], "left_semi"), members.join(blocks, ["segment", "block"], "left_semi")
    own = postings.join(F.broadcast(words), "term", "left_semi").select("segment", "block", "term", "slots", "tfs")
    both = own.unionByName(members.select("segment", "block", "ids", "lengths"), allowMissingColumns=True)
    spread = both.repartition(width(both.sparkSession), "segment", "block").sortWithinPartitions("segment", "block")
    return spread.mapInArrow(bounded(_scorer(shared, k), 4000, 8 << 20), "_q long, id string, score double")


def _promising(index: Index, asked: list, weights: dict, mean: float, buckets: list[int], words: DataFrame, shared, k: int) -> DataFrame:
    """The blocks that may hold one of the best k hits of some query."""
    spark = words.sparkSession
    pairs = spark.createDataFrame([(j, t, weights[t][0]) for j, r in enumerate(asked) for t in r["_t"] if t in weights], "_q long, term string, idf double")
    brief = of_buckets(index.postings, buckets).select("term", "segment", "block", "most", "least").join(F.broadcast(pairs), "term")
    part = F.col("idf") * F.col("most") * (K1 + 1) / (F.col("most") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("least") / F.lit(mean)))
    bounds = stage(brief.groupBy("_q", "segment", "block").agg(F.sum(part).alias("bound")), "bounds")
    best = F.slice(F.sort_array(F.collect_list(F.struct("bound", "segment", "block")), False), 1, SEEDS)
    first = bounds.groupBy("_q").agg(best.alias("b")).select(F.explode("b").alias("b")).select("b.segment", "b.block").distinct()
    hits = _scored(index, words, buckets, first, shared, k)
    found = hits.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("s"))
    floors = found.select("_q", F.when(F.size("s") >= k, F.element_at("s", -1)).otherwise(F.lit(0.0)).alias("floor"))
    left = bounds.join(F.broadcast(floors), "_q", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 1e-6)
    out = stage(left.select("segment", "block").distinct(), "blocks")
    drop(bounds)
    return out


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of the ``k`` best chunks for each query (``query_id``, ``query``); any word may match."""
    worded = queries.select("query_id", X.tokens(F.coalesce("query", F.lit(""))).alias("_t"))
    size = worded.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_t")), F.lit(0)).alias("w")).first()
    parts = max(-(-size["n"] // SLICE), -(-size["w"] // SLICE_WORDS), 1)
    if parts == 1:
        return _slice(index, worded, k)
    placed = stage(global_position(worded, [F.col("query_id")], "_at", "_all").withColumn("_part", F.pmod("_at", F.lit(parts))).drop("_at", "_all"), "queries")
    out = [_slice(index, placed.filter(F.col("_part") == i).drop("_part"), k) for i in range(parts)]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _slice(index: Index, worded: DataFrame, k: int) -> DataFrame:
    spark, kind = worded.sparkSession, worded.schema["query_id"].dataType.simpleString()
    asked = worded.collect()  # a slice is bounded
    of: dict[str, list[int]] = defaultdict(list)
    for j, r in enumerate(asked):
        for t in r["_t"]:
            of[t].append(j)
    words = spark.createDataFrame([(t,) for t in of], "term string")
    buckets = sorted({r["bucket"] for r in words.select(bucket("term")).distinct().collect()})
    total = index.corpus.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    counts = of_buckets(index.terms, buckets).join(F.broadcast(words), "term").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").collect() if total["n"] else []
    if not counts:
        return spark.createDataFrame([], f"query_id {kind}, id string, score double, rank int")
    n, mean = total["n"], total["words"] / total["n"]
    weights = {r["term"]: (float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))), np.array(of[r["term"]])) for r in counts}
    gone = {}
    for r in index.gone.groupBy("id").agg(F.max("upto").alias("upto")).collect() if index.gone is not None else ():  # bounded by MOST_GONE
        gone[r["id"]] = r["upto"]
    shared = spark.sparkContext.broadcast((weights, mean, gone, len(asked)))
    words = spark.createDataFrame([(t,) for t in weights], "term string")
    blocks = _promising(index, asked, weights, mean, buckets, words, shared, k) if len(asked) <= PRUNED else None
    hits = _scored(index, words, buckets, blocks, shared, k)
    names = spark.createDataFrame([(j, r["query_id"]) for j, r in enumerate(asked)], f"_q long, query_id {kind}")
    order = F.struct((-F.round("score", 9)).alias("s"), "id", "score")
    best = hits.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("b"))
    ranked = best.select("_q", F.posexplode("b").alias("p", "b")).select("_q", "b.id", "b.score", (F.col("p") + 1).cast("int").alias("rank"))
    return ranked.join(F.broadcast(names), "_q").select("query_id", "id", "score", "rank")
