"""SimHash near-duplicates by deletion-variant signatures (operator 9).

A fingerprint has 64 bits; two link if they differ in at most ``2``. Cut into two halves, one half differs by at most
one bit. Each half is indexed once for each of its bits with that bit deleted (a wildcard), so linked fingerprints meet in
an equality join on (half, deleted bit, rest), and a bit count verifies them.

Equal fingerprints are one class before anything is joined. A signature shared by up to ``crowd`` classes gives pairs. Classes that meet
in a larger crowd are not paired there; each is instead indexed under what two of six segments leave, fifteen keys of 42 bits or more. Those
in a crowd there as well are indexed under all their variants with two bits deleted: at most four
fingerprints share such a variant and all of these link, so a star suffices and every link of the crowd is found.
Components come from alternating star contractions over staged edge tables, never on the driver.

Defined cases: a null text has no words; a text of any length is hashed whole, in parts; no words give fingerprint zero, which links like any other; one or two words form one
shingle; repeated rows are listed as often; an empty table stays empty; a null doc_id never names a component unless all its members'
are null; of equal candidates for a component's name the smaller id wins, so the order of rows does not matter; columns besides those named are not read, and their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import likeness
from sparkloom.session import bounded, dealt, drop, release, stage

CROWD = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number: a bit is set if over half of the shingles' XXH64 values have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(prints.view(np.int64))], names=["doc_id", "t", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text) and fp (the 64 bits as a signed long) of every document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("t"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(bounded(_signed), "doc_id long, t long, fp long")


def text_key() -> Column:
    """64 bits that tell texts apart; null and empty texts are one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _pairs_of_segments() -> list[int]:
    """The 15 masks of two out of six segments, as signed numbers."""
    cuts = [0, 11, 22, 33, 44, 54, 64]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(parts, 2))]


def links(classes: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (a < b) between distinct fingerprints ``fp`` that differ in at most two bits; stars stand for cliques of up to four."""
    if bits != 2:
        raise ValueError("two halves with one wildcard each find links of up to two bits")
    half = "(shiftright(fp, IF(_b >= 32, 32, 0)) & 4294967295L)"
    key = F.expr(f"({half} & ~shiftleft(1L, _b % 32)) | shiftleft(CAST(_b AS BIGINT), 32)")
    keyed = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_b")).select("fp", key.alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hits = stage(keyed.join(dealt(shared), "key"), "signatures")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits

    def met(few: DataFrame) -> DataFrame:
        a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
        return a.join(dealt(b), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")

    pairs = met(hits.filter(F.col("n") <= crowd))
    # Two differing bits leave four of six segments equal: fifteen keys of 42 bits or more for each member of a crowd.
    crowded = hits.filter(F.col("n") > crowd).select("fp").distinct()
    gone = F.array(*(F.lit(m) for m in _pairs_of_segments()))
    parts = crowded.select("fp", F.posexplode(gone).alias("_k", "_m")).select("fp", F.struct("_k", F.col("fp").bitwiseAND(F.bitwise_not("_m")).alias("v")).alias("key"))
    again = stage(parts.join(dealt(parts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")), "key"), "signatures")
    pairs = pairs.unionByName(met(again.filter(F.col("n") <= crowd)))
    crowded = again.filter(F.col("n") > crowd).select("fp").distinct()
    two = crowded.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(62)))).withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.lit(63))))
    gone = F.expr("shiftleft(1L, _i) | shiftleft(1L, _j)")
    variants = two.select("fp", (F.col("_i") * 64 + F.col("_j")).alias("_ij"), F.col("fp").bitwiseAND(F.bitwise_not(gone)).alias("_v"))
    stars = variants.groupBy("_ij", "_v").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("_all")).filter(F.size("_all") > 1)
    stars = stars.select("a", F.explode("_all").alias("b")).filter("a <> b")
    found = stage(pairs.unionByName(stars).distinct(), "near")
    drop(hits, again)
    release(classes.sparkSession)
    return found


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star steps until nothing moves.

    Each step joins every edge's end to the smallest neighbour of its start; the least of a hub's neighbours is a partial
    aggregate and the join on a hub is one that adaptive execution can split. The logarithm of the longest chain bounds the steps.
    """
    spark = edges.sparkSession
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.filter("b > a").join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = stage(small, "edges")
        sums = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = nxt
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    release(spark)
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def _rooted(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with _root, the smallest fingerprint of the component."""
    roots = components(edges)
    return classes.join(dealt(roots), classes["fp"] == roots["node"], "left").select(*classes.columns, F.coalesce("root", "fp").alias("_root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every document."""
    signed = stage(fingerprints(docs), "fingerprints")
    classes = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    placed = _rooted(classes, links(classes.select("fp")))
    names = placed.groupBy("_root").agg(F.min("first").alias("component_id"))
    named = placed.join(dealt(names), "_root").select(F.col("fp").alias("_fp"), "component_id")
    return signed.join(dealt(named), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def _with_alike(docs: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` with _root over near fingerprints and alike texts. Two stars thin out crowds; all pairs of what is still apart follow."""
    edges = links(classes.select("fp"))
    placed = stage(_rooted(classes, edges), "placed")
    texts = docs.select(text_key().alias("t"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seeds = likeness.seeds(texts)
    prints = stage(signed.select("t", "fp").distinct(), "prints")
    crowds = seeds.filter(F.col("many") > likeness.CROWD)
    crowded = not crowds.isEmpty()
    for star in (1, 2, None) if crowded else (None,):
        homes = stage(prints.join(dealt(placed.select("fp", "_root")), "fp").select("t", "_root"), "homes")
        rows = seeds if star is None else crowds
        found = likeness.links(rows.join(dealt(homes), "t"), texts, prints, star)
        if not found.isEmpty():
            old = (edges, placed)
            edges = stage(edges.unionByName(found), "near")
            placed = stage(_rooted(classes, edges), "placed")
            drop(*old)
        drop(homes, found)
        release(docs.sparkSession)
    drop(seeds, prints, edges)
    return placed


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``; texts with a five-word likeness of 0.8 link beside near fingerprints. It is that with the smallest doc_id (null last), of several that with
    the smallest hash of its text. Rows that share a doc_id but not a component, null ids included, do not replace each other."""
    signed = stage(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    classes = stage(signed.groupBy("fp").agg(first), "classes")
    placed = _with_alike(docs, signed, classes)
    names = placed.groupBy("_root").agg(F.min("first").alias("first"))
    named = names.select(F.col("first.doc_id").alias("__keep"), F.col("first.t").alias("__u"))
    own = signed.join(dealt(named), signed["doc_id"].eqNullSafe(F.col("__keep")) & (F.col("t") == F.col("__u")))
    keep = stage(own.groupBy("__keep", "__u").agg(F.count("*").alias("__rows")), "kept")
    drop(signed, classes, placed)
    release(docs.sparkSession)
    # The input's columns travel in one struct, so that their names may be any.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__id"), text_key().alias("__t"))
    kept = rows.join(dealt(keep), F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__t") == F.col("__u")))
    once = kept.filter("__rows = 1").select("__row.*")
    # Rows that repeat doc_id and text are rare; only they are compared.
    return once.unionByName(kept.filter("__rows > 1").dropDuplicates(["__keep", "__u"]).select("__row.*"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
