"""Token counts by a separator scan over flat token files (operator 1).

A flat token file is a run of ids of fixed width in which an end-of-document id closes each document; nothing says where documents begin. The
scan reads blocks of such files, finds the separators of a block in one vectorised search, and needs of each block only its length, how many separators
it has and where the last one is. A prefix scan over these summaries gives every block its first position, the number of documents closed before
it and the place of the last separator before it, with which the documents that cross block borders are stitched together.

The prefix scan has two levels: over blocks inside runs of ``RUN`` blocks, then over the runs of a file; so no window holds more than the blocks
of one run or the runs of one file.

Defined cases: a null or empty text has no tokens; an unclosed end of a file is a document of its own, if not empty; an empty file has
no documents; separators that follow each other close empty documents; repeated rows are documents of their own; an empty table
stays empty; columns besides doc_id and text are not read; a null doc_id stays null; a text, and a file, of any length is scanned whole, over as many blocks as it takes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import bounded, drop, stage
from sparkloom.session import width as parts

RUN = 1024
#: Ids of a block at most; a block of 16-bit ids then has half a megabyte, one of 32-bit ids a whole.
BLOCK_IDS = 1 << 18
BLOCKS = "file string, block long, payload binary"


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The default vocabulary; set SPARKLOOM_RANKS to use another."""
    return os.environ.get("SPARKLOOM_RANKS") or f"/opt/tokenizers/{name}"


_ENCODERS: dict[str, object] = {}


def _encoder(path: str, lines: list[bytes]):
    if path not in _ENCODERS:
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(lines), special_tokens={})
    return _ENCODERS[path]


def _ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def end_of(lines: list[bytes]) -> int:
    """The end-of-document id: the first behind all ids of the vocabulary."""
    return max((int(line.split()[1]) for line in lines), default=-1) + 1


def id_width(end: int) -> int:
    """Bytes of an id: two where the vocabulary and its end-of-document id fit into them."""
    return 2 if end < 1 << 16 else 4


def token_blocks(docs: DataFrame, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Flat token files from documents, one file per task, cut into blocks: file, block, payload (little-endian ids of ``id_width`` bytes) and
    the doc_ids of the documents closed in the block, in order, which name documents but do not tell where they are."""
    spark = docs.sparkSession
    path = path or ranks_path()
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read().splitlines())
    end = end_of(shared.value)
    kind = f"<u{id_width(end)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        name, block = f"part-{TaskContext.get().partitionId():06d}", 0
        held, size, closed = [], 0, []

        def made(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block, closed
            flat = np.concatenate(held) if held else np.zeros(0, kind)
            a = 0
            while size - a >= n and size > a:
                part = flat[a : a + n]
                here = [d for at, d in closed if a <= at < a + len(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([part.astype(kind).tobytes()], pa.binary()), pa.array([here], pa.list_(pa.int64()))],
                    names=["file", "block", "payload", "doc_ids"],
                )
                block += 1
                a += len(part)
            closed = [(at - a, d) for at, d in closed if at >= a]
            held, size = [flat[a:]], size - a

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encoder.encode_ordinary(t or ""), end], kind)
                held.append(ids)
                size += len(ids)
                closed.append((size - 1, d))
                if size >= 4 * block_ids:
                    yield from made(block_ids)
        yield from made(block_ids)
        if size:
            block_end = size
            yield from made(block_end)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(bounded(write, 1000, 2 << 20), BLOCKS + ", doc_ids array<long>")


def flat_blocks(spark: SparkSession, paths: str | list[str], width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of flat binary token files of any size. Only names and lengths are listed; each task reads the bytes of its own blocks, by the file system that pyarrow knows for the path."""
    step = width * block_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for batch in batches:
            for path, k in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                if path != name:
                    files, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))
                    name, file = path, files.open_input_file(at)
                file.seek(k * step)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([file.read(step)], pa.binary())], names=["file", "block", "payload"])

    listed = spark.read.format("binaryFile").load(paths).filter("length > 0").select("path", F.ceil(F.col("length") / step).alias("n"))
    each = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    near = each.repartition(parts(spark), "path", F.floor(F.col("block") / 16)).sortWithinPartitions("path", "block")
    return near.mapInArrow(bounded(cut), BLOCKS)


def separator_scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """file, document (place in the file, from 0), start (its first id's place), n_tokens, and doc_id where the blocks carry doc_ids."""
    named = "doc_ids" in blocks.columns
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for x in batch.column("payload"):
                ids = np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            columns = [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            names = ["file", "block", "n", "ends"]
            if named:
                columns.append(batch.column("doc_ids"))
                names.append("doc_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = stage(
        blocks.mapInArrow(bounded(search, 8, 16 << 20), "file string, block long, n long, ends array<long>" + (", doc_ids array<long>" if named else "")), "separators"
    )
    tail = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    brief = found.select("file", "block", F.floor(F.col("block") / RUN).alias("run"), "n", F.size("ends").cast("long").alias("k"), tail.alias("tail"))
    # Inside a run of blocks: what lies before each block in the run.
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = brief.withColumn("_n", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("_k", F.coalesce(F.sum("k").over(inner), F.lit(0)))
    at = at.withColumn("_t", F.col("_n") + F.col("tail")).withColumn("_last", F.last("_t", ignorenulls=True).over(inner))
    at = at.withColumn("_upto", F.last("_t", ignorenulls=True).over(upto))
    # Over the runs of a file.
    runs = at.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.sum("k").alias("rk"), F.max("_upto").alias("rt"))
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_rn", F.coalesce(F.sum("rn").over(outer), F.lit(0))).withColumn("_rk", F.coalesce(F.sum("rk").over(outer), F.lit(0)))
    runs = runs.withColumn("_rt", F.last(F.col("_rn") + F.col("rt"), ignorenulls=True).over(outer))
    place = at.join(runs.select("file", "run", "_rn", "_rk", "_rt"), ["file", "run"]).select(
        "file",
        "block",
        (F.col("_rn") + F.col("_n")).alias("first"),
        (F.col("_rk") + F.col("_k")).alias("closed"),
        # The place behind the last separator before the block, where its first document began.
        (F.coalesce(F.col("_rn") + F.col("_last"), F.col("_rt"), F.lit(-1)) + 1).alias("open"),
    )
    both = found.join(place, ["file", "block"])
    item = F.arrays_zip("ends", "doc_ids") if named else F.transform("ends", lambda e: F.struct(e.alias("ends")))
    each = both.select(
        "file", "closed", "open", "first", "ends", F.posexplode(item).alias("i", "x")
    ).select(
        "file",
        (F.col("closed") + F.col("i")).alias("document"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("first") + F.get("ends", F.col("i") - 1) + 1).alias("start"),
        (F.col("first") + F.col("x.ends")).alias("_end"),
        *([F.col("x.doc_ids").alias("doc_id")] if named else []),
    )
    closed = each.withColumn("n_tokens", F.col("_end") - F.col("start")).drop("_end")
    # What stands behind the last separator of a file.
    whole = runs.groupBy("file").agg(F.sum("rn").alias("n"), F.sum("rk").alias("k"), F.max(F.col("_rn") + F.col("rt")).alias("t"))
    start = F.coalesce(F.col("t"), F.lit(-1)) + 1
    left = whole.select("file", F.col("k").alias("document"), start.alias("start"), (F.col("n") - start).alias("n_tokens")).filter("n_tokens > 0")
    if named:
        left = left.withColumn("doc_id", F.lit(None).cast("long")).select("file", "document", "start", "doc_id", "n_tokens")
    return closed.unionByName(left)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents written as flat token files to the shared folder, and these scanned."""
    path = path or ranks_path()
    with open(path, "rb") as f:
        end = end_of(f.read().splitlines())
    blocks = stage(token_blocks(docs, path), "tokens")
    return separator_scan(blocks, end, id_width(end))


def op1_query(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return counted.select("doc_id", "file", "document", "start", "n_tokens")


__all__ = ["count_tokens", "drop", "flat_blocks", "op1_query", "separator_scan", "token_blocks"]
