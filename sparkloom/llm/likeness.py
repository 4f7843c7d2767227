"""Texts whose sets of five-word shingles have a Jaccard likeness of at least 0.8, by an exact prefix-filter join.

All shingles are put in one order, common ones last (any order gives the same result). Two texts that are alike
share one of the first n - ceil(0.8 n) + 1 shingles of each, so they meet in an equality join on these; length and place rule out
most of the rest and the full sets decide. Shingles that the same texts have among their first are one, with the least place of each text, so two texts meet
once and not once for each shingle. Words are lowered as in the fingerprints; one to four words form one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.flattext import U, Words, pieces, rolling
from sparkloom.session import bounded, dealt, drop, release, stage

#: A shingle counts as common from COMMON documents on, the MOST commonest of these are put last; one that more than CROWD documents have among their first is a crowd.
SHINGLE, COMMON, MOST, CROWD = 5, 8, 200000, 8
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, raw, offsets in pieces(column):
        words = Words(_LOWER[raw], offsets)
        h = words.hashes()
        runs = rolling(h, SHINGLE)
        for a, b in zip(words.word_at[:-1].tolist(), words.word_at[1:].tolist()):
            yield np.unique(runs[a : b - SHINGLE + 1] if b - a >= SHINGLE else rolling(h[a:b], b - a) if b > a else np.zeros(0, U))


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingles(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["token"])


def _first(common):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for batch in batches:
            t, out = batch.column("t").to_numpy(), []
            for key, s in zip(t.tolist(), shingles(batch.column("text"))):
                n = len(s)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                s = s[: n - (4 * n + 4) // 5 + 1] if n else s
                out.append((s.view(np.int64), np.full(len(s), key), np.full(len(s), n, np.int32), np.arange(len(s), dtype=np.int32)))
            kinds = (np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *(o[i] for o in out)])) for i, k in enumerate(kinds)], names=["token", "t", "n", "at"])

    return first


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(shingles(batch.column("x")), shingles(batch.column("y")))
        met = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in both]
        yield batch.select(["a", "b"]).filter(pa.array([9 * m >= 4 * n for m, n in met], pa.bool_()))


def seeds(texts: DataFrame) -> DataFrame:
    """(token, t, n, at, many): the first shingles of every distinct text that another text has among its first, and by how many. A token stands for all shingles of the same texts."""
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(bounded(_all), "token long").groupBy("token").agg(F.count("*").alias("n"))
    common = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST).toArrow()
    known, often = common.column("token").to_numpy().view(U), common.column("n").to_numpy()
    order = np.argsort(known)
    release(spark)
    first = texts.mapInArrow(bounded(_first(spark.sparkContext.broadcast((known[order], often[order])))), "token long, t long, n int, at int")
    # Sums over the rows tell sets of texts apart: all copies of a text have its first shingles. Sets taken for one would only be joined, which loses no pair.
    sums = [F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("many"), F.sum(F.pmod("t", F.lit(2147483647))).alias("sum"), F.bit_xor("t").alias("xor")]
    shared = first.groupBy("token").agg(*sums).filter("a <> b").select("token", F.xxhash64("a", "b", "many", "sum", "xor").alias("same"), "many")
    shared = stage(shared, "shared")
    release(spark)
    met = first.join(dealt(shared), "token").groupBy("same", "t").agg(F.min("n").alias("n"), F.min("at").alias("at"), F.max("many").alias("many"))
    out = stage(met.withColumnRenamed("same", "token"), "shingles")
    drop(shared)
    release(spark)
    return out


def _reaching(rows: DataFrame) -> DataFrame:
    """``rows`` of tokens with several components, without those that are too far back or too long to be like any text of their token."""
    reach = F.expr("(5 * n - 9 * at) / 4")
    ends = rows.groupBy("token").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.min("n").alias("_least"), F.max(reach).alias("_reach")).filter("_lo <> _hi")
    return stage(rows.join(dealt(ends.drop("_lo", "_hi")), "token").filter((reach >= F.col("_least")) & (F.col("n") <= F.col("_reach"))).select(*rows.columns), "mixed")


def links(rows: DataFrame, texts: DataFrame, prints: DataFrame, star: int | None) -> DataFrame:
    """(a, b): fingerprints (``prints``: t, fp) of texts that are alike and of two components. ``rows`` are seeds with _root.

    Tokens whose texts are all in one component are left out first; where copies abound these are most.
    With ``star``, each token's texts meet only one of them, which joins a crowd without its pairs: first that with the fewest rarer shingles
    before the token, which has least of its own, then any."""
    cells = F.struct("t", "n", "at", "_root")
    rows = rows.select("token", "t", "n", "at", "_root")
    if star is None:
        wide = _reaching(rows)
        shown = _reaching(wide)
        drop(wide)
        # Alike sets differ in size by a fifth at most, that is by less than one class; a common token's texts meet those of their own and the class below only.
        left = shown.withColumn("_size", F.floor(F.log("n") / F.lit(-math.log(0.79))).cast("int"))
        on, other = ["token", "_size"], left.select("token", F.posexplode(F.array(F.col("_size"), F.col("_size") + 1)).alias("_up", "_size"), cells.alias("o"))
        apart = F.when(F.col("_up") == 0, F.col("_root") < F.col("o._root")).otherwise(F.col("_root") != F.col("o._root"))
    else:
        best = F.struct(F.col("at") / F.col("n") if star == 1 else F.lit(0.0), F.xxhash64("t", F.lit(star)))
        ends = [F.min("_root").alias("_lo"), F.max("_root").alias("_hi")]
        left, on, other = rows, ["token"], rows.groupBy("token").agg(F.min_by(cells, best).alias("o"), *ends).filter("_lo <> _hi")
        apart = F.col("_root") != F.col("o._root")
    rest = F.least(F.col("n") - F.col("at"), F.col("o.n") - F.col("o.at"))
    near = (9 * rest >= 4 * (F.col("n") + F.col("o.n"))) & (5 * F.least("n", "o.n") >= 4 * F.greatest("n", "o.n"))
    pairs = stage(left.join(dealt(other), on).filter(apart & near).select("t", F.col("o.t").alias("u")).distinct(), "candidates")
    if star is None:
        drop(shown)
    release(texts.sparkSession)
    needed = pairs.select("t").unionByName(pairs.select(F.col("u").alias("t"))).distinct().join(dealt(prints), "t")
    used = stage(texts.join(dealt(needed), "t").dropDuplicates(["t"]), "compared")
    release(texts.sparkSession)
    x, y = used.select("t", F.col("fp").alias("a"), F.col("text").alias("x")), used.select(F.col("t").alias("u"), F.col("fp").alias("b"), F.col("text").alias("y"))
    both = pairs.join(dealt(x), "t").join(dealt(y), "u").select("a", "b", "x", "y")
    found = stage(both.mapInArrow(bounded(_alike), "a long, b long").distinct(), "alike")
    drop(pairs, used)
    return found
