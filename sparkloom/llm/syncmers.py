"""Document fingerprints from closed syncmers (operator 4).

A run of ``K`` code points is selected if its least inner run of ``S`` code points lies at one of its two edges. Whether it is depends on
nothing outside the run, so a text keeps its anchors wherever it is copied to, and anchors of two texts can be matched with their places.
The fingerprint is the distinct anchor hashes (32 bits each, in hexadecimal, ascending) below ``LINE``, about one in sixteen whatever the text's length, and the ``KEEP`` least ones
where fewer lie there: it grows with the text, so that a passage that two long texts share shows in both. Each fingerprint is complete up to its own line; the likeness of two is the
share of common values of all values up to the lower line, an estimate of the Jaccard likeness of the anchor sets, exact where both have fewer than ``KEEP``.
Anchors also tell where a text stands in another: each common anchor, at its first place in both, votes for the distance between the two places.

Defined cases: a null text is empty; an empty text has an empty fingerprint, like any other empty one; a text without any selected run (a
short one) has one anchor, the hash of the whole text; rows with equal doc_id follow each other in the order of their texts; a null doc_id
comes after all others; the next document of the only one is itself; a text of any length is read whole; an empty table stays empty; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.flattext import U, mix, rolling, sliding_min
from sparkloom.session import bounded, width

K, S, KEEP = 16, 8, 64
#: Hashes below are in every fingerprint.
LINE = 1 << 28
#: Code points of a text that tell rows of one doc_id apart when documents are put in order.
BEGINS = 24
SEED = U(0x27D4EB2F165667C5)


def syncmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of several texts: text, place (code point) and 64-bit hash, in order."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = rolling(mix(points.astype(U) + SEED), S)
    least = sliding_min(inner, K - S + 1)
    n = len(least)
    first = np.cumsum(lengths) - lengths
    at = np.zeros(0, np.int64)
    if n:
        at = np.flatnonzero((inner[:n] == least) | (inner[K - S : K - S + n] == least))
        row = np.searchsorted(first, at, "right") - 1
        inside = at + K <= first[row] + lengths[row]
        at, row = at[inside], row[inside]
        h = mix(inner[at] * U(0x9FB21C651E98DF25) + inner[at + K - S])
        place = at - first[row]
    else:
        row = place = at
        h = np.zeros(0, U)
    bare = np.flatnonzero((np.bincount(row, minlength=len(texts)) == 0) & (lengths > 0))
    if len(bare):
        more = np.array([xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"), K) for i in bare], U)
        row, place, h = np.concatenate((row, bare)), np.concatenate((place, np.zeros(len(bare), np.int64))), np.concatenate((h, more))
        order = np.argsort(row, kind="stable")
        row, place, h = row[order], place[order], h[order]
    return row, place, h


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as ascending 32-bit numbers."""
    row, _, h = syncmers(texts)
    return _least(row, h, len(texts))


def _least(row: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    both = np.unique((row.astype(U) << U(32)) | (h >> U(32)))
    rows = np.arange(n, dtype=U) << U(32)
    starts, lines = np.searchsorted(both, rows), np.searchsorted(both, rows | U(LINE))
    ends = np.append(starts[1:], len(both))
    low = (both & U(0xFFFFFFFF)).astype(">u4")
    return [low[a : max(m, min(b, a + KEEP))] for a, m, b in zip(starts, lines, ends)]


def line(a: np.ndarray) -> int:
    """Up to where (exclusive) a fingerprint is complete."""
    return 1 << 32 if len(a) < KEEP else max(LINE, int(a[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    # Ascending, so the values below the lower line are a beginning of each.
    to = min(line(a), line(b))
    a, b = a[: np.searchsorted(a, to)], b[: np.searchsorted(b, to)]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def alignment(place: np.ndarray, h: np.ndarray, other_place: np.ndarray, other_h: np.ndarray) -> tuple[int | None, int]:
    """How far the other text's anchors stand behind this one's, by the most votes (ties: the least distance, then the smaller), and the votes. Anchors come in order of place."""
    (mine, i), (theirs, j) = np.unique(h, return_index=True), np.unique(other_h, return_index=True)
    _, a, b = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
    if not len(a):
        return None, 0
    shift, votes = np.unique(other_place[j[b]] - place[i[a]], return_counts=True)
    best = np.lexsort((shift, np.abs(shift), -votes))[0]
    return int(shift[best]), int(votes[best])


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and order; the last row of each bucket is only there to follow."""
    held: tuple | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_shift", "edited_votes"]

    def out(rows: list[tuple], nexts: list[str]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, nexts)]
        row, place, h = syncmers([*texts, nexts[-1], *changed])
        all_ = _least(row, h, 2 * len(texts) + 1)
        own, then, other = all_[: len(texts)], all_[1 : len(texts) + 1], all_[len(texts) + 1 :]
        ends = np.searchsorted(row, np.arange(2 * len(texts) + 2))
        each = [(place[a:b], h[a:b]) for a, b in zip(ends, ends[1:])]
        moved = [alignment(*a, *b) for a, b in zip(each, each[len(texts) + 1 :])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([x.tobytes().hex() for x in own]),
                pa.array([x.tobytes().hex() for x in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, then)], pa.float64()),
                pa.array([m for m, _ in moved], pa.int64()),
                pa.array([v for _, v in moved], pa.int64()),
            ],
            names=names,
        )

    for batch in batches:
        rows = list(zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
        rows = ([held] if held else []) + rows
        run: list[tuple] = []
        size = 0
        for row, following in zip(rows, rows[1:]):
            if row[0] != following[0]:  # the follower of a bucket
                if run:
                    yield out(run, [*(r[2] for r in run[1:]), row[2]])
                run, size = [], 0
                continue
            run.append(row)
            size += len(row[2])
            if size > 1 << 18:
                yield out(run, [*(r[2] for r in run[1:]), following[2]])
                run, size = [], 0
        held = rows[-1] if rows else held
        if run:
            yield out(run, [*(r[2] for r in run[1:]), held[2]])


def _bucket(starts: list[str]) -> Column:
    """The place, from 0, of the last of the ascending ``starts`` that is not above _key: found among every m-th, then among m."""
    m = math.isqrt(len(starts) - 1) + 1
    parts = [starts[i : i + m] for i in range(0, len(starts), m)]
    held = F.from_json(F.lit(json.dumps(parts)), "array<array<string>>")
    tops = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<string>")
    below = F.greatest(F.size(F.filter(tops, lambda a: a <= F.col("_key"))), F.lit(1))
    return (below - 1) * m + F.size(F.filter(F.element_at(held, below), lambda a: a <= F.col("_key"))) - 1


def compared(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every document beside its edited text and the next document, descending doc_id, then by text; ``edited_shift`` and ``edited_votes`` tell where its anchors went in the edited text.

    Texts move once: ranges of (doc_id, how the text begins) become buckets, their first keys, one per range, are read by the driver,
    and the first document of the next range is added to each bucket as a follower, so that no order over all rows is needed.
    Rows of one doc_id, null ids included, are spread by their texts; those that also begin alike share a bucket.
    """
    spark = docs.sparkSession
    # Ids as hexadecimal digits whose order is turned round (the complement cannot overflow), null after them; then the bytes the text begins with.
    digits = F.lpad(F.hex(F.bitwise_not(F.col("doc_id").cast("long")).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat(F.coalesce(digits, F.lit("G")), F.hex(F.substring(text, 1, BEGINS))).alias("_key")
    ranges = docs.select(key).repartitionByRange(buckets or 4 * width(spark), "_key").groupBy(F.spark_partition_id().alias("_p"))
    starts = sorted(r["a"] for r in ranges.agg(F.min("_key").alias("a")).select("a").collect())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_shift long, edited_votes long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, text.alias("text"))
    if not starts:
        return texts.select("doc_id", "text").mapInArrow(lambda batches: iter(()), schema)
    placed = texts.select(_bucket(starts).alias("bucket"), F.lit(0).alias("last"), "_key", "doc_id", "text")
    # A range begins with the least text of its first key; the last range is followed by the first.
    heads = texts.filter(F.col("_key").isin(starts)).groupBy("_key").agg(F.min("text").alias("text"))
    before = F.pmod(_bucket(starts) - 1, F.lit(len(starts)))
    followers = heads.select(before.alias("bucket"), F.lit(1).alias("last"), "_key", F.lit(None).cast("long").alias("doc_id"), "text")
    spread = placed.unionByName(followers).repartition(width(spark), "bucket").sortWithinPartitions("bucket", "last", "_key", "text")
    return spread.select("bucket", "doc_id", "text").mapInArrow(bounded(_compared), schema)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (code point) and hash of every anchor, for matching positions across documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, h = syncmers([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(place), pa.array(h.view(np.int64))], names=["doc_id", "place", "hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(bounded(of, 200, 1 << 20), "doc_id long, place long, hash long")


def op4_query(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
