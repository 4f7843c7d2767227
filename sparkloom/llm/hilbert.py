"""Sharding by Hilbert-curve order (operator 6), in DataFrame functions only.

Several metadata dimensions are quantised to a few bits, the point's index on a Hilbert curve orders the
documents, and runs of equal count are cut from that order: a shard then holds a compact box of every dimension, which
lets file statistics prune by any of them. The law that holds is ``rows``: counts differ by one at most.

Defined cases: a null text has no bytes and the checksum of the empty text; a null source or language sorts last; repeated rows
are placed one by one; an empty table has no shards; columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import global_position
from sparkloom.session import stage

BITS = 6


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The place of a point with three ``bits``-bit coordinates on the curve.

    From the highest bit down, each level's cell is turned and mirrored into standard position (the coordinates below
    the level are exchanged or complemented); a Gray code of the turned coordinates then numbers the cells.
    """

    def level(acc: Column, q: Column) -> Column:
        p = q - 1
        a, b, c = acc["a"], acc["b"], acc["c"]
        a = F.when(a.bitwiseAND(q) != 0, a.bitwiseXOR(p)).otherwise(a)
        turned = []
        for other in (b, c):
            t = a.bitwiseXOR(other).bitwiseAND(p)
            mirrored = other.bitwiseAND(q) != 0
            turned.append(F.when(mirrored, other).otherwise(other.bitwiseXOR(t)))
            a = F.when(mirrored, a.bitwiseXOR(p)).otherwise(a.bitwiseXOR(t))
        return F.struct(a.alias("a"), turned[0].alias("b"), turned[1].alias("c"))

    levels = F.array(*(F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)))
    start = F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"), z.cast("long").alias("c"))
    gray = lambda v: F.struct(v["a"].alias("a"), v["a"].bitwiseXOR(v["b"]).alias("b"), v["a"].bitwiseXOR(v["b"]).bitwiseXOR(v["c"]).alias("c"))
    flips = lambda c: F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(c.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def interleaved(v: Column) -> Column:
        t = flips(v["c"])
        out = F.lit(0).cast("long")
        for k in range(bits):
            for axis, place in (("a", 2), ("b", 1), ("c", 0)):
                bit = F.shiftright(v[axis].bitwiseXOR(t), k).bitwiseAND(F.lit(1).cast("long"))
                out = out.bitwiseOR(F.shiftleft(bit, 3 * k + place))
        return out

    return F.aggregate(levels, start, level, lambda v: F.aggregate(F.array(gray(v)), F.lit(0).cast("long"), lambda _, g: interleaved(g)))


def size_code(size: Column, bits: int = BITS) -> Column:
    """Half-octaves of a size: twice the exponent of two, plus one in the upper half of an octave."""
    exponent = F.length(F.bin(size)) - 1
    upper = F.substring(F.bin(size), 2, 1) == "1"
    return F.least(F.lit((1 << bits) - 1), 2 * exponent + F.when(upper, 1).otherwise(0)).cast("long")


def ranked(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Adds the rank of a name among the distinct names, spread over the codes. One row per name is ordered."""
    names = df.select(F.col(column).alias("_name")).distinct()
    spread = F.floor((F.row_number().over(Window.orderBy(F.asc_nulls_last("_name"))) - 1) * (1 << bits) / F.count("*").over(Window.partitionBy()))
    codes = stage(names.select("_name", spread.cast("long").alias(out)), "codes")
    return df.join(codes, F.col(column).eqNullSafe(F.col("_name"))).drop("_name")


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """doc_id, source, lang, size, text_crc32, curve, shard (0 to n-1) and slot (place in the shard, from 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    points = stage(
        docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")),
        "points",
    )
    coded = ranked(ranked(points, "source", "_x"), "lang", "_y").withColumn("_z", size_code(F.col("size")))
    placed = coded.withColumn("curve", hilbert_index(F.col("_x"), F.col("_y"), F.col("_z"))).drop("_x", "_y", "_z")
    order = [F.col("curve"), F.asc_nulls_last("doc_id"), F.col("text_crc32"), F.col("size")]
    at = global_position(placed, order, "_at", "_all")
    shard = F.expr(f"(_at * {n}) div _all")
    first = F.expr(f"(shard * _all + {n - 1}) div {n}")
    return at.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).drop("_at", "_all")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def _sql() -> str:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(n)
    steps, last = [], "p"
    for k in range(BITS - 1, 0, -1):
        q, p = 1 << k, (1 << k) - 1
        for i, axis in enumerate(("a", "b", "c")):
            name = f"q{k}{axis}"
            if i == 0:
                cols = f"CASE WHEN a & {q} <> 0 THEN xor(a, {p}) ELSE a END AS a, b, c"
            else:
                keep = "c" if axis == "b" else "b"
                cols = f"CASE WHEN {axis} & {q} <> 0 THEN xor(a, {p}) ELSE xor(a, xor(a, {axis}) & {p}) END AS a, CASE WHEN {axis} & {q} <> 0 THEN {axis} ELSE xor({axis}, xor(a, {axis}) & {p}) END AS {axis}, {keep}"
            steps.append(f"{name} AS (SELECT doc_id, size, text_crc32, {cols} FROM {last})")
            last = name
    flip = "0"
    for k in range(BITS - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN c & {1 << k} <> 0 THEN {(1 << k) - 1} ELSE 0 END)"
    bits = " + ".join(f"(((xor({a}, t) >> {k}) & 1) << {3 * k + o})" for k in range(BITS) for a, o in (("a", 2), ("b", 1), ("c", 0)))
    return rf"""
WITH t AS (SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 1 AS size,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda a, b: xor(a >> 8, ({table}::UBIGINT[])[((xor(a, b) & 255) + 1)::INT])))::BIGINT AS text_crc32 FROM documents),
sr AS (SELECT source, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) * {1 << BITS}) // count(*) OVER () AS x FROM (SELECT DISTINCT source FROM t)),
lr AS (SELECT lang, ((row_number() OVER (ORDER BY lang NULLS LAST) - 1) * {1 << BITS}) // count(*) OVER () AS y FROM (SELECT DISTINCT lang FROM t)),
p AS (SELECT doc_id, size, text_crc32, x::BIGINT AS a, y::BIGINT AS b, least({(1 << BITS) - 1}, 2 * (length(bin(size)) - 1) + CASE WHEN bin(size)[2] = '1' THEN 1 ELSE 0 END)::BIGINT AS c
  FROM t JOIN sr ON t.source IS NOT DISTINCT FROM sr.source JOIN lr ON t.lang IS NOT DISTINCT FROM lr.lang),
{", ".join(steps)},
g AS (SELECT doc_id, size, text_crc32, a, xor(a, b) AS b, xor(xor(a, b), c) AS c FROM {last}),
f AS (SELECT *, {flip} AS t FROM g),
i AS (SELECT doc_id, size, text_crc32, {bits} AS curve FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS LAST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM i),
s AS (SELECT *, (place * 16) // n AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, curve::BIGINT AS curve FROM s
"""


OP6_SQL = _sql()
