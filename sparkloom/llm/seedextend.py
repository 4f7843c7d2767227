"""Substring dedup by seed and extend (operator 7).

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it has the same words as one
that starts earlier (smaller doc_id, or the same document and an earlier start); all windows are judged on the input.

Seeds: winnowing picks in each window its least hash of ``GRAM`` words; equal windows pick the same, so every repeat has an anchor
in common. Anchors whose hash occurs once are dropped by a semi-join. Extension: the windows that picked one anchor form one
stretch of words around it; occurrences with the same anchor and the same stretch form a class, in which all but the earliest occurrence
repeat in full. Only where one anchor has several stretches are the earliest occurrences of each extended
window by window, and each window's earliest place is found by a grouped minimum. So no pairs of occurrences are made, whatever a
passage's frequency, and an exact copy costs no more than its anchors. Marked windows join into maximal stretches
per document and these are cut out.

Words are compared by 64-bit hashes of the anchor together with 64-bit hashes of the window, 128 bits in all.

Defined cases: a null text has no words; a text of any length is read whole, one too long for a batch alone in its own; rows with equal doc_id are ordered by the hash of their text, and rows that repeat both
are one document, listed as often as given; a null doc_id comes last; an empty table stays empty; other columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.flattext import SPAN_BASE, U, Words, mix, pieces, powers, rolling, sliding_min
from sparkloom.session import bounded, drop, release, stage

WINDOW, GRAM = 20, 6
REACH = WINDOW - GRAM + 1
_INVERSE = pow(SPAN_BASE, -1, 1 << 64)
ANCHOR = "h long, ctx long, doc long, t long, start int, n int"
LAST = (1 << 63) - 1


class Spans:
    """Hashes of any runs of words from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(SPAN_BASE, len(h)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(_INVERSE, len(self.sums))[start]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(U))


def anchors_of(words: Words) -> tuple[np.ndarray, ...]:
    """Of all rows' anchors: row, hash, hash of the stretch, first window (word in the row) and number of windows."""
    h = words.hashes()
    if len(h) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = rolling(h, GRAM)
    least = sliding_min(grams, REACH)
    counts = np.diff(words.word_at)
    row = np.repeat(np.arange(words.rows), counts)
    end = np.repeat(words.word_at[1:], counts)
    first = np.flatnonzero(end - np.arange(len(h)) >= WINDOW)
    least = least[first]
    place = np.full(len(first), -1, np.int64)
    for k in range(REACH):
        hit = (grams[first + k] == least) & (place < 0)
        place[hit] = k
    anchor = first + place
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(first) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(first)))
    low, at = first[new], anchor[new]
    ctx = mix(Spans(h).of(low, low + n + WINDOW - 1) + ((at - low) * 64 + n).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return row[low], grams[at].view(np.int64), ctx.view(np.int64), low - words.word_at[row[low]], n


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, t = batch.column("doc").to_numpy(), batch.column("t").to_numpy()
        for a, b, raw, offsets in pieces(batch.column("text")):
            row, h, ctx, start, n = anchors_of(Words(raw, offsets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(ctx), pa.array(doc[a:b][row]), pa.array(t[a:b][row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["h", "ctx", "doc", "t", "start", "n"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the given anchors of a text: anchor, stretch, the window's hash, its number and its place."""
    for batch in batches:
        doc, t, given = batch.column("doc").to_numpy(), batch.column("t").to_numpy(), batch.column("given")
        for a, b, raw, offsets in pieces(batch.column("text")):
            words = Words(raw, offsets)
            spans, part = Spans(words.hashes()), given.slice(a, b - a)
            rows = np.repeat(np.arange(b - a), pa.compute.list_value_length(part).to_numpy())
            flat = part.flatten()
            h, ctx, start, n = (flat.field(k).to_numpy() for k in range(4))
            which = np.repeat(np.arange(len(h)), n)
            i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            low = words.word_at[rows[which]] + start[which] + i
            w = spans.of(low, low + WINDOW).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h[which], ctx[which], w, i.astype(np.int32), doc[a:b][rows[which]], t[a:b][rows[which]], (start[which] + i).astype(np.int32))],
                names=["h", "ctx", "w", "i", "doc", "t", "start"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the text without its repeats into the struct of a row's columns."""
    for batch in batches:
        row, texts, spans = batch.column("__row"), batch.column("__text"), batch.column("__spans")
        out_text, n_words, n_removed, digests = [], [], [], []
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            marks = spans[k].values if spans[k].is_valid else None
            removed = np.zeros(len(words), bool)
            if marks is not None and len(marks):
                start, mask = marks.field(0).to_numpy().astype(np.int64), marks.field(1).to_numpy()
                step = np.zeros(len(words) + 1, np.int64)
                for i in range(REACH):
                    low = start[(mask >> i) & 1 == 1] + i
                    np.add.at(step, low, 1)
                    np.add.at(step, low + WINDOW, -1)
                removed = np.cumsum(step)[:-1] > 0
            gone = int(removed.sum())
            if gone:
                places = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                bounds = np.flatnonzero(np.diff(np.concatenate(([False], ~removed, [False])).astype(np.int8)))
                runs = [raw[places.start[x] : places.end[y - 1]] for x, y in zip(bounds[::2], bounds[1::2])]
                text = b"\n".join(runs).decode("utf-8", "surrogatepass")
                words = [w for w, r in zip(words, removed) if not r]
            out_text.append(text)
            n_words.append(len(removed))
            n_removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        fields = [pa.array(out_text, pa.string()) if f.name == "text" else column for f, column in zip(row.type, row.flatten())]
        made = pa.StructArray.from_arrays(fields, names=[f.name for f in row.type])
        yield pa.RecordBatch.from_arrays([made, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["__row", "__n_words", "__n_removed", "__sha"])


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_mark(text).alias("t"), text.alias("text"), *more)


def text_mark(text: Column) -> Column:
    """64 bits that tell rows of one doc_id apart; all rows with a null doc_id share one, so they must do as a key."""
    return F.xxhash64(text)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, t, start, mask): bit i of ``mask`` says that the window at word ``start`` + i starts earlier elsewhere too."""
    texts = keyed(docs)
    anchors = texts.mapInArrow(bounded(_anchors), ANCHOR)
    # Staged, so that the join below it has a shuffle on either side and a hot anchor's partition can be split.
    often = stage(anchors.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h"), "often")
    release(docs.sparkSession)
    seeds = stage(anchors.join(often, "h", "left_semi"), "seeds")
    release(docs.sparkSession)
    classes = seeds.groupBy("h", "ctx").agg(F.min(F.struct("doc", "t", "start")).alias("f"), F.count("*").alias("often"), F.min("n").alias("n"))
    classes = stage(classes, "stretches")
    several = stage(classes.groupBy("h").agg(F.count("*").alias("_k")).filter("_k > 1").select("h"), "several")
    apart = classes.join(several, "h", "left_semi").select("h", "ctx", "f.*", "n")
    given = apart.groupBy(F.col("doc").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("h", "ctx", "start", "n")).alias("given"))
    extended = texts.join(given, (F.col("doc") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc", "t", "text", "given")
    windows = stage(extended.mapInArrow(bounded(_windows), "h long, ctx long, w long, i int, doc long, t long, start int"), "windows")
    release(docs.sparkSession)
    earliest = windows.groupBy("h", "w").agg(F.min(F.struct("doc", "t", "start")).alias("e"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    earliest = stage(earliest, "earliest")
    later = windows.join(earliest, ["h", "w"]).filter(F.struct("doc", "t", "start") > F.col("e"))
    masks = later.groupBy("h", "ctx").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    judged = classes.join(masks, ["h", "ctx"], "left").filter("often > 1 or mask is not null").select("h", "ctx", "f", F.coalesce("mask", F.lit(0)).alias("mask"))
    judged = stage(judged, "judged")
    full = F.expr("shiftleft(1, n) - 1")
    marks = seeds.join(judged, ["h", "ctx"]).withColumn("mask", F.when(F.struct("doc", "t", "start") == F.col("f"), F.col("mask")).otherwise(full))
    marks = stage(marks.filter("mask <> 0").select("doc", "t", "start", "mask"), "marks")
    drop(often, several, earliest, judged, seeds, classes, windows)
    release(docs.sparkSession)
    return marks


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated stretches cut out of ``text`` (runs that stay are joined by a line end), and __n_words, __n_removed
    and __sha (SHA-256 of the kept words joined by one space; columns of these three names give way). A text without repeats stays as it is."""
    marks = repeated_windows(docs)
    spans = marks.groupBy(F.col("doc").alias("__d"), F.col("t").alias("__u")).agg(F.collect_list(F.struct("start", "mask")).alias("__spans"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.col("text").cast("string")
    columns = [c for c in docs.columns if c not in ("__n_words", "__n_removed", "__sha")]
    # The input's columns travel in one struct, so that their names may be any.
    rows = docs.select(F.struct(*(text.alias(c) if c == "text" else F.col(c) for c in columns)).alias("__row"), key.alias("__doc"), text_mark(F.coalesce(text, F.lit(""))).alias("__t"))
    joined = rows.join(spans, (F.col("__doc") == F.col("__d")) & (F.col("__t") == F.col("__u")), "left")
    out = f"__row {joined.schema['__row'].dataType.simpleString()}, __n_words long, __n_removed long, __sha string"
    cut = joined.select("__row", F.col("__row.text").alias("__text"), "__spans").mapInArrow(bounded(_cut), out)
    return cut.select("__row.*", "__n_words", "__n_removed", "__sha")


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__sha").alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, s.s AS s, array_to_string(words[s.s:s.s + 19], ' ') AS win
      FROM d, LATERAL (SELECT unnest(range(1, len(words) - 18)) AS s) s WHERE len(words) >= 20),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM w),
c AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS gone FROM r WHERE k > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i))) END AS kept
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
