"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie (operator 3).

The pieces come from a public model file whose path is a parameter; nothing is trained. Of all ways to cut a text into pieces the one of
the greatest sum of log scores is taken. A model of the unigram kind has log scores; one of the BPE kind has merge ranks, which are no
logarithms, so there a piece of rank r gets log(1 / (r + 1)), Zipf's law. A character that is no piece becomes its UTF-8 bytes,
at a score below all pieces.

A space becomes the marker U+2581 and one marker is put in front; decoding undoes both. A literal U+2581 in a text is written as bytes, so decoding
gives back every text exactly.

No piece has a marker behind another character, and most control characters are in no longer piece; where that holds (it is checked) every best
path passes the border before a marker and those around such a character, so a text falls into short units that are solved on their own. Units
already solved come from a bounded memo; new ones are solved together: the trie is walked from all places at once, one depth at a time,
and the best paths grow by one byte of all units at a time.

Defined cases: a null text is empty; an empty text has no pieces; a text without spaces is one long unit, solved by the same code; repeated
rows are encoded alike; an empty table stays empty; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import bounded

MARK = "▁"
#: Added below the least score for a character that is no piece.
UNKNOWN = 10.0
MEMO = 300_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The default model file; set SPARKLOOM_PIECES to use another."""
    return os.environ.get("SPARKLOOM_PIECES") or f"/opt/tokenizers/{name}"


class DoubleArray:
    """A trie over byte strings: from state s byte c leads to ``base[s] + c + 1`` if ``check`` there is s; ``value`` holds ids, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        nodes: list[dict[int, int]] = [{}]
        ids = {0: -1}
        for key, v in zip(keys, values):
            at = 0
            for c in key:
                nxt = nodes[at].get(c)
                if nxt is None:
                    nxt = nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nxt
            ids[at] = v
        size = 2 * len(nodes) + 4096
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        state, low, span = [0] * len(nodes), 1, 512
        for node, children in enumerate(nodes):  # parents come before their children
            s = state[node]
            value[s] = ids.get(node, -1)
            if not children:
                continue
            codes = sorted(children)
            while not free[low]:
                low += int(free[low : low + span].argmax()) or span
            # The least base whose places for all children are free, looked for in runs of bases.
            b = max(low - codes[0] - 1, 0)
            while True:
                if b + span + 258 > len(free):
                    base, check, value = (np.concatenate((x, np.full(len(x), f, np.int32))) for x, f in ((base, 0), (check, -1), (value, -1)))
                    free = np.concatenate((free, np.ones(len(free), bool)))
                fits = free[b + codes[0] + 1 : b + codes[0] + 1 + span].copy()
                for c in codes[1:]:
                    fits &= free[b + c + 1 : b + c + 1 + span]
                first = int(fits.argmax())
                if fits[first]:
                    b += first
                    break
                b += span
            base[s] = b
            for c in codes:
                free[b + c + 1] = False
                check[b + c + 1] = s
                state[children[c]] = b + c + 1
        self.base, self.check, self.value = base, check, value

    def get(self, key: bytes) -> int:
        s = 0
        for c in key:
            t = int(self.base[s]) + c + 1
            if self.check[t] != s:
                return -1
            s = t
        return int(self.value[s])


class Pieces:
    """A model's pieces and the codec over them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], usable: list[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        keys = [pieces[i].encode() for i in usable]
        self.trie = DoubleArray(keys, usable)
        self.score = np.full(len(pieces), -np.inf)
        for i in usable:
            self.score[i] = scores[i]
        self.unknown = min((scores[i] for i in usable), default=0.0) - UNKNOWN
        self.lengths = np.array([len(p.encode()) for p in pieces], np.int32)
        self.deepest = max(map(len, keys), default=0)
        texts = [pieces[i] for i in usable]
        joined = {c for t in texts if len(t) > 1 for c in t}
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in joined)
        if any(MARK in t.lstrip(MARK) for t in texts):
            self.unit = re.compile(r"(?s).+")
        else:
            self.unit = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.byte_of = {int(b): i for i, b in enumerate(byte_ids)}
        self.memo: dict[str, np.ndarray] = {}

    @classmethod
    @cache
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        names = [m.id_to_piece(i) for i in range(n)]
        bytes_ = {names[i]: i for i in range(n) if m.is_byte(i)}
        usable = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        stored = [m.get_score(i) for i in range(n)]
        # Merge ranks are whole numbers from 0 down; log scores are not.
        ranks = all(float(stored[i]).is_integer() for i in usable)
        scores = [-log(1.0 - s) for s in stored] if ranks else stored
        return cls(names, scores, [bytes_[f"<0x{b:02X}>"] for b in range(256)], usable)

    def _solve(self, units: list[str]) -> list[np.ndarray]:
        """The best path of each unit, all units at once."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        total = len(data)
        first = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(raw)), length)
        stop = (first + length)[owner]
        # Walk the trie from every place at once.
        src, got = [], []
        start = np.flatnonzero((data & 0xC0) != 0x80)
        at, state = start, np.zeros(len(start), np.int64)
        single = np.zeros(total + 1, bool)
        width = np.ones(total, np.int64)
        lead = data[start]
        width[start] = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        for depth in range(self.deepest):
            alive = at + depth < stop[at] if len(at) else np.zeros(0, bool)
            at, state = at[alive], state[alive]
            if not len(at):
                break
            nxt = self.trie.base[state] + data[at + depth].astype(np.int64) + 1
            good = (nxt < len(self.trie.check)) & (self.trie.check[np.minimum(nxt, len(self.trie.check) - 1)] == state)
            at, state = at[good], nxt[good]
            value = self.trie.value[state]
            hit = value >= 0
            src.append(at[hit])
            got.append(value[hit])
            single[at[hit & (width[at] == depth + 1)]] = True
        bare = start[~single[start]]
        src.append(bare)
        got.append(np.full(len(bare), -1, np.int32))
        src, got = np.concatenate(src), np.concatenate(got)
        step = np.where(got >= 0, self.lengths[got], width[src])
        gain = np.where(got >= 0, self.score[got], self.unknown)
        # All paths grow from the units' first byte on; of equal scores the longer last piece stays.
        inner = src - first[owner[src]]
        order = np.lexsort((src, inner))
        src, got, step, gain, inner = src[order], got[order], step[order], gain[order], inner[order]
        cuts = np.flatnonzero(np.diff(inner)) + 1
        place = src + owner[src]  # each unit has one place more than bytes
        best = np.full(total + len(raw), -np.inf)
        best[first + np.arange(len(raw))] = 0.0
        back, by = np.zeros(len(best), np.int32), np.full(len(best), -2, np.int32)
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(src)])).tolist()):
            here = place[a:b]
            to = here + step[a:b]
            score = best[here] + gain[a:b]
            win = score > best[to]
            to = to[win]
            best[to] = score[win]
            back[to] = step[a:b][win]
            by[to] = got[a:b][win]
        # Read the paths back from their ends, all units at a time.
        zero = first + np.arange(len(raw))
        cur = zero + length
        ids, unit, where = [], [], []
        live = np.flatnonzero(length > 0)
        while len(live):
            c = cur[live]
            ids.append(by[c])
            unit.append(live)
            where.append(c - back[c])
            cur[live] = c - back[c]
            live = live[cur[live] > zero[live]]
        if not ids:
            return [np.zeros(0, np.int32) for _ in raw]
        ids, unit, where = np.concatenate(ids), np.concatenate(unit), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        ids, unit, where = ids[order], unit[order], where[order]
        unknown = ids < 0
        if unknown.any():
            n = np.where(unknown, width[where - unit], 1)
            which = np.repeat(np.arange(len(ids)), n)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            as_bytes = self.byte_ids[data[np.minimum(where[which] - unit[which] + offset, total - 1)]]
            ids, unit = np.where(unknown[which], as_bytes, ids[which]).astype(np.int32), unit[which]
        ends = np.searchsorted(unit, np.arange(len(raw) + 1))
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut: list[list[str]] = []
        new: dict[str, None] = {}
        memo = self.memo
        literal = [int(self.byte_ids[b]) for b in MARK.encode()]
        for text in texts:
            units: list[str] = []
            if text:
                parts = text.split(MARK)
                for k, part in enumerate(parts):
                    if k:
                        units.append("")  # a literal marker
                    units += self.unit.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
            cut.append(units)
            for u in units:
                if u not in memo:
                    new[u] = None
        todo = [u for u in new if u]
        solved = dict(zip(todo, self._solve(todo))) if todo else {}
        solved[""] = np.array(literal, np.int32)
        out = []
        for units in cut:
            ids = [solved[u] if u in solved else memo[u] for u in units]
            out.append(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        if len(memo) + len(solved) > MEMO:
            memo.clear()
        memo.update((u, x.copy()) for u, x in solved.items() if 0 < len(u) <= 32)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: markers become spaces, byte pieces their bytes, and the marker in front goes."""
        if not hasattr(self, "_bytes"):
            self._bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        raw = b"".join(map(self._bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""

    def score_of(self, ids: list[int]) -> float:
        return float(sum(self.score[i] for i in ids))


_LOADED: dict[str, Pieces] = {}


def _model(shared) -> Pieces:
    """One model per worker, from the broadcast pieces (its size is that of the vocabulary)."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = shared.value
    return _LOADED[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, repr(broadcast.id if hasattr(broadcast, "id") else id(broadcast))

    @property
    def value(self) -> Pieces:
        return self.broadcast.value

    def __reduce__(self):
        return _Shared._again, (self.broadcast, self.id)

    @staticmethod
    def _again(broadcast, name):
        s = _Shared.__new__(_Shared)
        s.broadcast, s.id = broadcast, name
        return s


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_bytes (pieces that are bytes), round_trip (whether decoding gave the text back) and ids."""
    spark = docs.sparkSession
    shared = _Shared(spark.sparkContext.broadcast(Pieces.load(path or model_path())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[model.byte_ids] = True
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 1 << 19):
                    size += len(texts[b])
                    b += 1
                ids = model.encode(texts[a:b])
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                ends = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n),
                        pa.array(np.diff(np.concatenate(([0], np.cumsum(is_byte[flat])))[ends])),
                        pa.array([model.decode(x) == t for x, t in zip(ids, texts[a:b])], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32())),
                    ],
                    names=["doc_id", "n_tokens", "n_bytes", "round_trip", "ids"],
                )
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        bounded(run, 1000, 2 << 20), "doc_id long, n_tokens long, n_bytes long, round_trip boolean, ids array<int>"
    )


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shared = _Shared(tokens.sparkSession.sparkContext.broadcast(Pieces.load(path or model_path())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(bounded(run, 1000, 2 << 20), "doc_id long, text string")


def op3_query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
