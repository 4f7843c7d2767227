"""Alignment of two tokenizers over the same texts by elementary intervals (operator 13).

Both tokenizers cover a text's bytes without gaps, so a token is its end offset. The union of both arrays of ends (``union1d``) cuts the bytes into
elementary intervals; ``searchsorted`` finds the one token of each side that owns an interval, and since tokens are contiguous each interval is exactly one overlapping
pair, a link. Ends that both sides share close a group, the least stretch that both cut alike; the product of a group's sizes is the number of its pairs.

Both sides begin a new token at a single space between two characters that are no white space (the vocabularies are checked for that when they are loaded; one
that holds such a space inside a piece is read text by text). So a text is cut there into chunks without changing any token, each distinct chunk of a block of documents is encoded and aligned
once, and documents are runs of chunk numbers. A block becomes one row of bounded size (about ``BLOCK_BYTES`` of text, or one longer text).

How often a pair of ids is linked in the corpus is a sum over all blocks' distinct pairs. The sums go back to the blocks that need them by an equality join in which a pair stands at most once
for each block, so the commonest pair has no more rows than there are blocks; every chunk is then valued once and every document is a sum over its chunks.

Defined cases: a null or empty text has no tokens, like one whose bytes either side does not give back (all counts zero, no digest); strings of special tokens are text; a null doc_id stays; rows that repeat
count each; a text of any length is one text, and one without any space is one chunk; malformed UTF-8 is read with replacement characters, so no bytes are
compared with what was malformed; an empty table stays empty; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import bounded, dealt, drop, stage, width

#: Bytes of text that one block holds at least, if its task has as many.
BLOCK_BYTES = 4 << 20
#: Chunks that are encoded as one text.
UNIT = 1000
CHUNK, BESIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" (?:(?<=\s )|(?=\s))")
_READY: dict[tuple[str, str], "Pair"] = {}


def paths() -> tuple[str, str]:
    """The default vocabularies; set SPARKLOOM_ALIGN to two paths with a colon between to use others."""
    named = os.environ.get("SPARKLOOM_ALIGN")
    a, b = named.split(":") if named else ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
    return a, b


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others in order from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, last) of each elementary interval: the tokens that own it, and whether it closes a group. Both arrays of ends must have the same last entry."""
    cuts = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    return a, b, (a_ends[a] == cuts) & (b_ends[b] == cuts)


class Pair:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        letter = byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Each id with what may follow it in a group's text.
        self.marked = [f"{k}{c}" for k in range(len(self.a_bytes)) for c in ",|"] + [f"{k}{c}" for k in range(len(self.b_bytes)) for c in ",;"]
        # A space behind a character that is no white space, inside one token of either side, would make cutting there wrong.
        self.cuts = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for side in (self.a_bytes, self.b_bytes) for x in side)

    def chunks(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return CHUNK.split(text) if text[0] == " " or text[-1] == " " or BESIDE.search(text) else text.split(" ")

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids of space + text, or None where one does not give its bytes back."""
        x, y, want = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join([self.a_bytes[k] for k in x]) == want and b"".join([self.b_bytes[k] for k in y]) == want:
            return np.array(x, np.int64), np.array(y, np.int64)
        return None

    def table(self, chunks: list[str]) -> "Chunks":
        """All chunks encoded and aligned at once. Chunks that neither begin nor end with white space are encoded many to a text, which both sides cut at the chunks' borders."""
        plain = [k for k, c in enumerate(chunks) if self.cuts and c and not (c[0].isspace() or c[-1].isspace())]
        alone = set(plain)
        units = [plain[i : i + UNIT] for i in range(0, len(plain), UNIT)] + [[k] for k in range(len(chunks)) if k not in alone]
        order, a, b, a_n, b_n, bad = [], [], [], [], [], []
        while units:
            unit = units.pop()
            both = self._encoded(" ".join(chunks[k] for k in unit))
            if both is None:
                if len(unit) > 1:
                    units += [unit[: len(unit) // 2], unit[len(unit) // 2 :]]
                else:
                    bad += unit
                continue
            ends = np.cumsum([len(chunks[k].encode()) + 1 for k in unit])
            for ids, size, all_ids, counts in ((both[0], self.a_size, a, a_n), (both[1], self.b_size, b, b_n)):
                all_ids.append(ids)
                counts.append(np.diff(np.searchsorted(np.cumsum(size[ids]), ends, "right"), prepend=0))
            order += unit
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return Chunks(self, np.array(order + bad, np.int64), len(bad), flat(a), flat(a_n), flat(b), flat(b_n))


class Chunks:
    """Aligned chunks, in an order of their own: ``place`` of each as given, whether ``good``, ``sizes`` (n_a, n_b, groups, products), ``names`` of groups, and links as packed pairs from ``link_at``."""

    def __init__(self, pair: Pair, order: np.ndarray, bad: int, a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray):
        n, m = len(order), len(order) - bad
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.good = np.arange(n) < m
        self.sizes = np.zeros((n, 4), np.int64)
        self.names, self.link_at, self.pairs = [""] * n, np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
        if not m:
            return
        a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        at, bt, last = aligned(a_ends, b_ends)
        closing = np.flatnonzero(last)
        a_last, b_last = at[closing], bt[closing]
        in_a, in_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_of = np.repeat(np.arange(m), a_n)  # the chunk of each token of the first side
        of = a_of[a_last]
        count = lambda where, weights=None: np.bincount(where, weights, m).astype(np.int64)
        self.sizes[:m] = np.stack([a_n, b_n, count(of), count(of, in_a * in_b)], 1)
        self.pairs = (a[at] << 32) | b[bt]
        self.link_at[1:] = np.cumsum(np.concatenate([count(a_of[at]), np.zeros(bad, np.int64)]))
        # Groups as text: a group's ids of one side, then of the other; behind each id stands what follows it.
        words = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.repeat(np.arange(len(closing)), in_a), np.repeat(np.arange(len(closing)), in_b)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[a_last], ends_b[b_last] = 1, 1
        words[np.arange(len(a)) + (b_last + 1 - in_b)[group_a]] = 2 * a + ends_a
        words[np.arange(len(b)) + (a_last + 1)[group_b]] = 2 * (b + len(pair.a_bytes)) + ends_b
        text = [pair.marked[k] for k in words.tolist()]
        starts = np.concatenate(([0], np.cumsum(a_n + b_n))).tolist()
        self.names[:m] = ["".join(text[i:j]) for i, j in zip(starts, starts[1:])]


def _pair(names: tuple[str, str], shared) -> Pair:
    if names not in _READY:
        _READY[names] = Pair(*shared.value)
    return _READY[names]


ROW = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_products array<long>, sha array<string>"
BLOCK = ROW + ", words binary, word_at array<long>, links binary, link_at array<long>, pairs array<long>, counts array<long>"


class Block:
    """Documents gathered until they are one row."""

    def __init__(self, pair: Pair):
        #: Chunks by number, and the chunk numbers of each text.
        self.pair, self.known = pair, {}
        self.texts: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        known, chunks = self.known, self.pair.chunks(text) if text else []
        self.texts.append((doc_id, np.fromiter((known.setdefault(c, len(known)) for c in chunks), np.int64, len(chunks))))
        self.size += len(text)

    def row(self) -> pa.RecordBatch:
        table = self.pair.table(list(self.known))
        words, out = [], [[] for _ in range(6)]
        for doc_id, ids in self.texts:
            ids = table.place[ids]
            if not len(ids) or not table.good[ids].all():
                ids, sha = ids[:0], ""
            else:
                sha = hashlib.sha256("".join([table.names[k] for k in ids.tolist()])[:-1].encode()).hexdigest()
            words.append(np.sort(ids).astype(np.uint32))
            for column, value in zip(out, (doc_id, *table.sizes[ids].sum(0).tolist(), sha)):
                column.append(value)
        used = np.bincount(np.concatenate(words), minlength=len(table.place))
        pairs, place = np.unique(table.pairs, return_inverse=True)
        link_at = table.link_at
        counts = np.bincount(place, weights=np.repeat(used, np.diff(link_at)), minlength=len(pairs)).astype(np.int64)
        kept = counts > 0  # pairs of chunks that only stand in texts without tokens have no links
        new = np.cumsum(kept) - 1
        word_at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        columns = [*out, [np.concatenate([np.zeros(0, np.uint32), *words]).tobytes()], [word_at], [np.where(kept[place], new[place], 0).astype(np.uint32).tobytes()], [link_at], [pairs[kept]], [counts[kept]]]
        kinds = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.binary()] + [pa.list_(pa.int64())] * 3
        arrays = [pa.array([c], t) if k < 6 else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, kinds))]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in BLOCK.split(", ")])


def _blocks(names: tuple[str, str], shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(names, shared)
        block = Block(pair)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py().decode("utf-8", "replace") if text.is_valid else "")
                if block.size >= size:
                    yield block.row()
                    block = Block(pair)
        if block.texts:
            yield block.row()

    return run


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_products long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sums of ``x`` between neighbouring places ``at``."""
    until = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=until[1:])
    return until[at[1:]] - until[at[:-1]]


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus-wide count of each of their pairs and whether it is the best of its second id."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {name: batch.column(name)[row] for name in batch.schema.names}
            counts, best = one["values"].values.field("n").to_numpy(), one["values"].values.field("best").to_numpy(zero_copy_only=False)
            links, words = np.frombuffer(one["links"].as_buffer(), np.uint32), np.frombuffer(one["words"].as_buffer(), np.uint32)
            link_at, word_at = one["link_at"].values.to_numpy(), one["word_at"].values.to_numpy()
            # Sums over links by chunk, then over chunks by document, one column at a time. A chunk that stands in no document with tokens has no counts.
            by_chunk = [np.diff(link_at), *(_sums(x[links], link_at) if len(counts) else np.zeros(len(link_at) - 1, np.int64) for x in (best, counts))]
            n_links, n_best, count_sum = (_sums(x[words], word_at) for x in by_chunk)
            held = [one[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_products")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(n_links), pa.array(n_best), pa.array(count_sum), one["sha"].values], names=[x.split()[0] for x in OUT.split(", ")])


def align(docs: DataFrame, names: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document the columns of ``OUT``, and the links of the corpus: a, b, n (how many links hold the pair) and best (whether no other a has more with this b)."""
    spark = docs.sparkSession
    names = names or paths()
    with open(names[0], encoding="utf-8") as f, open(names[1], "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = stage(rows.mapInArrow(bounded(_blocks(names, shared, block_bytes)), BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks", wide=True)
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counted = stage(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counted.groupBy(second).agg(F.max("n").alias("most"))
    links = stage(counted.select("pair", second, "n").join(most, "b").select("pair", F.shiftright("pair", 32).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best")), "links")
    drop(counted)
    # A block is some MB on either side, so there is a task for each, however many the session would make.
    tasks = max(width(spark), blocks.count())
    found = each.select("block", "at", "pair").join(links.select("pair", "n", "best"), "pair").repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("values"))
    nothing = F.array().cast("array<struct<at:int,n:bigint,best:boolean>>")
    both = blocks.drop("pairs", "counts").repartition(tasks, "block").join(dealt(found), "block", "left").withColumn("values", F.coalesce("values", nothing)).drop("block")
    return both.mapInArrow(bounded(_valued, 4, 32 << 20), OUT), links.drop("pair")


def op13_query(spark, sf_dir: str) -> DataFrame:
    documents, _ = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return documents
