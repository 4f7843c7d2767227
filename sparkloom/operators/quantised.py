"""Vectors as product-quantised codes: a short scan that proposes, and full vectors that decide.

A vector is cut into parts, and each part is replaced by the number of the nearest of up to 256 centres, one byte a part. The centres are fitted on a bounded sample; every vector is encoded. A query
has one table for each part, with its squared distance to every centre, so its distance to a code is a sum of looked-up entries and no vector is read for it. Each task keeps the
best ``keep`` codes of each query; the best ``keep`` of all tasks are looked up by id among the full vectors, and these exact distances give the answer.

Codes are stored by cell (the nearest of the coarse centres of an inverted file) below one folder a cell; with ``probes`` a search reads the folders of its nearest cells only. Without it
all codes are read, which for 64 floats in 16 parts is a sixteenth of the vectors' bytes.

Defined cases: null vectors are not indexed; vectors of another length than the codebook's raise; fewer distinct vectors than centres give fewer centres; equal distances go to the smaller id; rows that repeat are hits of
their own only in the exact answer's sense (one id, one hit); an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.ordering import global_position
from sparkloom.session import bounded, stage

#: Queries whose tables (parts x 256 floats each) go to the tasks at once, and codes that are summed at once.
SLICE, ROWS = 2048, 4096
CODES = "id string, cell int, code binary"


@dataclass(frozen=True)
class Codebook:
    """Coarse centres (cells x dimension) and the centres of each part (parts x centres x part's dimension)."""

    cells: np.ndarray
    centres: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first; of equally near ones the first."""
    far = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    if n == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows; a centre that loses all rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres, np.float64)
        np.add.at(total, own, x)
        centres[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


def fit(rows: DataFrame, parts: int = 16, cells: int = 64, sample: int = 20_000, rounds: int = 10, vector: str = "vector") -> Codebook:
    """A codebook from the ``sample`` rows with the least hash of their id (a documented bound; all rows are encoded afterwards)."""
    taken = rows.filter(F.col(vector).isNotNull()).select("id", vector).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not taken:
        return Codebook(np.zeros((1, 0), np.float32), np.zeros((0, 1, 0), np.float32))
    x = np.array([r[vector] for r in taken], np.float32)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions do not divide into {parts} parts")
    size = x.shape[1] // parts
    centres = [means(x[:, p * size : (p + 1) * size], 256, rounds) for p in range(parts)]
    return Codebook(means(x, cells, rounds), np.stack(centres))


def encode(rows: DataFrame, book: Codebook, vector: str = "vector") -> DataFrame:
    """id, cell and code of every row that has a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        parts, size = b.centres.shape[0], b.centres.shape[2]
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            if len(lengths) and (lengths != b.dimension).any():
                raise ValueError(f"a vector of {int(lengths[lengths != b.dimension][0])} dimensions where the codebook has {b.dimension}")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, b.dimension) if batch.num_rows else np.zeros((0, b.dimension), np.float32)
            codes = np.stack([nearest(x[:, p * size : (p + 1) * size], b.centres[p])[:, 0] for p in range(parts)], 1).astype(np.uint8) if parts else np.zeros((len(x), 0), np.uint8)
            cell = nearest(x, b.cells)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    typed = rows.filter(F.col(vector).isNotNull()).select(F.col("id").cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    return typed.mapInArrow(bounded(run, 4096, 8 << 20), CODES)


def write(codes: DataFrame, folder: str) -> None:
    """Codes below one folder a cell. A cell's rows stay in the files of the tasks that had them, so a hot cell is many files."""
    codes.sortWithinPartitions("cell").write.option("compression", "zstd").partitionBy("cell").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CODES).parquet(folder)


def tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each part of each query to the centres of that part: queries x parts x centres."""
    parts, _, size = book.centres.shape
    cut = queries.reshape(len(queries), parts, size)
    return ((cut[:, :, None, :] - book.centres[None]) ** 2).sum(3).astype(np.float32)


def _proposed(shared, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, probed = shared.value
        n, parts, _ = looked.shape
        flat = looked.reshape(n, -1)
        base = np.arange(parts) * looked.shape[2]
        # Per query the best so far: distances, and the place of their ids among those held.
        far, at, held = np.full((n, 0), np.inf, np.float32), np.zeros((n, 0), np.int64), np.zeros(0, object)
        for batch in batches:
            names, cells = np.array(batch.column("id").to_pylist(), object), batch.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(names), parts)
            for a in range(0, len(names), ROWS):
                part = codes[a : a + ROWS].astype(np.int64) + base
                d = np.zeros((n, len(part)), np.float32)
                for p in range(parts):
                    d += flat[:, part[:, p]]
                if probed is not None:
                    d[~probed[:, cells[a : a + ROWS]]] = np.inf
                far, at = np.concatenate((far, d), 1), np.concatenate((at, np.broadcast_to(len(held) + np.arange(len(part)), d.shape)), 1)
                held = np.concatenate((held, names[a : a + ROWS]))
                if far.shape[1] > keep:
                    best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
                    far, at = np.take_along_axis(far, best, 1), np.take_along_axis(at, best, 1)
                    used, place = np.unique(at, return_inverse=True)
                    held, at = held[used], place.reshape(at.shape)
        q, i = np.nonzero(np.isfinite(far))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(held[at[q, i]].tolist() if len(q) else [], pa.string()), pa.array(far[q, i], pa.float32())], names=["_q", "id", "near"])

    return run


def search(codes: DataFrame, rows: DataFrame, book: Codebook, queries: DataFrame, k: int, keep: int = 200, probes: int | None = None, vector: str = "vector") -> DataFrame:
    """query_id, id, distance, score, rank: the ``k`` nearest of the ``keep`` rows that codes propose, by exact distance to ``vector`` of ``rows``."""
    asked = queries.select("query_id", F.col("query_vector").cast("array<float>").alias("query_vector")).filter("query_vector is not null")
    n = asked.count()
    if n <= SLICE:
        return _slice(codes, rows, book, asked, k, keep, probes, vector)
    placed = stage(global_position(asked, [F.col("query_id")], "_at", "_all").withColumn("_part", F.floor(F.col("_at") / SLICE)).drop("_at", "_all"), "queries")
    parts = [_slice(codes, rows, book, placed.filter(F.col("_part") == i).drop("_part"), k, keep, probes, vector) for i in range(-(-n // SLICE))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _slice(codes: DataFrame, rows: DataFrame, book: Codebook, asked: DataFrame, k: int, keep: int, probes: int | None, vector: str) -> DataFrame:
    spark, kind = asked.sparkSession, asked.schema["query_id"].dataType.simpleString()
    taken = asked.collect()  # a slice is bounded
    if not taken or not book.dimension:
        return spark.createDataFrame([], f"query_id {kind}, id string, distance double, score double, rank int")
    if any(len(r["query_vector"]) != book.dimension for r in taken):
        raise ValueError(f"queries need {book.dimension} dimensions")
    x = np.array([r["query_vector"] for r in taken], np.float32)
    probed = None
    if probes is not None and probes < len(book.cells):
        near = nearest(x, book.cells, probes)
        probed = np.zeros((len(x), len(book.cells)), bool)
        np.put_along_axis(probed, near.reshape(len(x), -1), True, 1)
        codes = codes.filter(F.col("cell").isin(np.flatnonzero(probed.any(0)).tolist()))
    shared = spark.sparkContext.broadcast((tables(book, x), probed))
    proposed = codes.select("id", "cell", "code").mapInArrow(bounded(_proposed(shared, keep), 1 << 16, 16 << 20), "_q long, id string, near float")
    # No more than ``keep`` rows of each query and task come together here.
    best = proposed.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "id"))), 1, keep).alias("b")).select("_q", F.explode("b.id").alias("id"))
    full = rows.select(F.col("id").cast("string").alias("id"), F.col(vector).alias("_v")).join(best.groupBy("id").agg(F.collect_list("_q").alias("_qs")), "id")
    named = spark.createDataFrame([(j, r["query_id"], r["query_vector"]) for j, r in enumerate(taken)], f"_q long, query_id {kind}, _w array<float>")
    each = full.select("id", "_v", F.explode("_qs").alias("_q")).join(F.broadcast(named), "_q")
    gaps = F.zip_with("_v", "_w", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    measured = each.select("query_id", F.struct(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g).alias("distance"), F.col("id")).alias("h"))
    order = measured.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("b")).select("query_id", F.posexplode("b").alias("p", "b"))
    return order.select("query_id", "b.id", "b.distance", X.closeness(F.col("b.distance")).alias("score"), (F.col("p") + 1).cast("int").alias("rank"))
