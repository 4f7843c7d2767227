"""The test tables as the library's inputs, in Spark and as SQL views of the same names."""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import keywords
from sparkloom.session import dealt, drop, release, shared_dir, stage

#: Lines that are ordered in one shuffle, about.
PART_ROWS = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, content, mtime, doc_id: documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.col("source").alias("module"), F.col("text").alias("content"), F.col("doc_id").alias("mtime"), "doc_id", "lang")


DOCS = "docs AS (SELECT concat(source, '/', doc_id, '.md') AS path, source AS module, text AS content, doc_id AS mtime, doc_id, lang FROM documents)"


def headed(docs: DataFrame) -> DataFrame:
    """Every tenth line of the content becomes a heading, for no document has one."""
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.when(i % 10 == 9, F.concat(F.lit("# "), x)).otherwise(x))
    return docs.withColumn("content", F.array_join(lines, "\n"))


HEADED = DOCS + r""",
headed AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i % 10 = 0 THEN '# ' || x ELSE x END) AS lines FROM docs)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", "p_type").alias("signature"),
        F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"),
    )


SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_name || ' ' || p_type AS signature, p_brand AS file, p_size AS start_line, p_size + 10 AS end_line FROM part)"
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst_name, dst: from each line's part to the next line's in an order, each once."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    lines = table(spark, sf_dir, "lineitem")
    called = lambda x: x.select(F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null").distinct()
    # The order takes ten columns, so a shuffle of all lines would be many times what it yields: orders go in parts, and each part's shuffle before the next.
    if (parts := math.ceil(lines.count() / PART_ROWS)) <= 1:
        pairs = called(lines)
    else:
        pieces = []
        for k in range(parts):
            pieces.append(stage(called(lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(parts)) == k)), "lines"))
            release(spark)
        pairs = stage(functools.reduce(DataFrame.unionByName, pieces).distinct(), "pairs")
        drop(*pieces)
        release(spark)
    names = symbols(spark, sf_dir).select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return pairs.join(dealt(names), "dst").select("src", "dst_name", "dst")


EDGES = SYMBOLS + f""",
pairs AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS dst FROM lineitem) WHERE dst IS NOT NULL),
edges AS (SELECT p.src, s.name AS dst_name, p.dst FROM pairs p JOIN symbols s ON s.id = p.dst)"""


def every_twentieth(symbols_: DataFrame) -> DataFrame:
    """The stated set of start symbols: ids divisible by 20."""
    return symbols_.filter(F.col("id") % 20 == 0)


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots as (path, content, hash, mtime): documents, and the same with some gone, some edited and some touched."""
    d = documents(spark, sf_dir)
    prior = d.select("path", "content", F.sha2("content", 256).alias("hash"), "mtime")
    edit = F.when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit(" x"))).otherwise(F.col("content"))
    now = d.filter(F.col("doc_id") % 50 != 0).withColumn("content", edit).withColumn("mtime", F.when((F.col("doc_id") % 10).isin(1, 2), F.col("mtime") + 1).otherwise(F.col("mtime")))
    extra = d.filter(F.col("doc_id") % 50 == 0).select(F.concat(F.lit("new/"), F.col("doc_id"), F.lit(".md")).alias("path"), "content", F.sha2("content", 256).alias("hash"), "mtime")
    return prior, now.select("path", "content", F.sha2("content", 256).alias("hash"), "mtime").unionByName(extra)


FILES = DOCS + """,
prior AS (SELECT path, content, sha256(content) AS hash, mtime FROM docs),
edited AS (SELECT path, CASE WHEN doc_id % 10 = 1 THEN content || ' x' ELSE content END AS content, CASE WHEN doc_id % 10 IN (1, 2) THEN mtime + 1 ELSE mtime END AS mtime FROM docs WHERE doc_id % 50 <> 0),
cur AS (SELECT path, content, sha256(content) AS hash, mtime FROM edited UNION ALL SELECT 'new/' || doc_id || '.md', content, sha256(content), mtime FROM docs WHERE doc_id % 50 = 0)"""


def chunk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as searchable chunks: id, source, module, content, symbol_name, signature, start_line, end_line."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("path").alias("source"), "module", "content", F.lit("").alias("symbol_name"), F.substring(F.substring_index("content", "\n", 1), 1, 160).alias("signature"),
        F.lit(1).alias("start_line"), F.size(F.split("content", "\n", -1)).alias("end_line"),
    )


_INDEXES: dict[tuple[str, str], str] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> keywords.Index:
    """The stored keyword index of the table, built by the first query of a session that needs it and read by all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        keywords.build(chunk_cards(spark, sf_dir), folder)
        _INDEXES[key] = folder
    return keywords.read(spark, _INDEXES[key])


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("module"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
