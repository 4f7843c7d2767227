"""Fill-in-the-middle transformation by an event scan (operator 11).

A text is cut into units at two places and rewritten as prefix, suffix and middle behind sentinels, so that a model that reads from left to right learns to fill gaps. Units are code
points, words (a run of characters other than white space with the white space behind it) or lines (with their line feed).

One Aho-Corasick automaton reads a text once and reports events only: sentinels and the ASCII characters at which a run of units of one class ends
(none for code points, white space for words, the line feed for lines). What lies in a gap between events needs no look: its number of units follows
from its length (code points) or from whether it is empty (words, lines). Units before each event are summed once, and the offset of the k-th unit is a
binary search over these sums and a step into one gap, so a text costs its few events and not its units.

Where the cuts fall and which form a text takes is decided by a hash of its doc_id alone, so reruns and repeated rows agree and any number of executors gives the same result. ``restore``
rebuilds texts from output and form; in a text that was cut no sentinel stands, and none can arise where parts meet, so it splits at three places exactly.

Defined cases: a null text is empty; an empty text and one that holds a sentinel stay as they are (form plain); a null doc_id is hashed as no digits at
all; rows that share a doc_id share cuts of their own lengths; a cut may leave any part empty; a text of any length is read whole, once; malformed
UTF-8 is read with replacement characters; an empty table stays empty; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import bounded

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those the percent with the suffix in front.
CUT, SUFFIX_FIRST = 90, 20
#: By kind of unit: the ASCII characters that end a run of its class.
CLASSES = {"codepoint": "", "word": " \t\n\v\f\r", "line": "\n"}
_SENTINEL = "sentinel"
_AUTOMATA: dict[tuple[str, tuple[str, ...]], ahocorasick.Automaton] = {}


def automaton(units: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton over the class-changing characters of ``units`` and all sentinels."""
    key = (units, sentinels)
    if key not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for c in CLASSES[units]:
            a.add_word(c, c)
        for s in sentinels:
            a.add_word(s, _SENTINEL)
        a.make_automaton()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


class Units:
    """The units of one text as sums over its events: how many there are, where the k-th ends, and whether a sentinel stands in the text."""

    def __init__(self, text: str, units: str, sentinels: tuple[str, ...]):
        self.length, self.by_length = len(text), units == "codepoint"
        self.marked, at = False, []
        for end, value in automaton(units, sentinels).iter(text):
            if value is _SENTINEL or value == _SENTINEL:
                self.marked = True
            else:
                at.append(end)
        #: Places at which a unit surely ends, ascending, the end of the text last; units up to each.
        if self.by_length:
            self.borders = np.array([self.length])
            self.sums = np.array([self.length])
            return
        events = np.array(at, np.int64)
        # A unit ends behind an event whose next character is no event of the class that goes on: for words the last white space of a run, for lines each feed.
        last = np.append(events[1:] != events[:-1] + 1, True) if units == "word" and len(events) else np.ones(len(events), bool)
        ends = events[last] + 1
        if self.length and (not len(ends) or ends[-1] != self.length):
            ends = np.append(ends, self.length)
        self.borders, self.sums = ends, np.arange(1, len(ends) + 1)

    def __len__(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def offset(self, k: int) -> int:
        """The code points in the first k units."""
        if k <= 0:
            return 0
        gap = int(np.searchsorted(self.sums, k))
        border, upto = int(self.borders[gap]), int(self.sums[gap])
        return border - (upto - k) if self.by_length else border


def _transformed(units: str, sentinels: tuple[str, str, str]):
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py().decode("utf-8", "replace") if x.is_valid else "" for x in batch.column("text")]
            n, form, cuts, out = [], [], ([], []), []
            for text, h in zip(texts, zip(*(batch.column(f"h{k}").to_pylist() for k in range(1, 5)))):
                counted = Units(text, units, sentinels)
                size = len(counted)
                n.append(size)
                if not text or counted.marked or h[2] % 100 >= CUT:
                    form.append("plain")
                    out.append(text)
                    for c in cuts:
                        c.append(None)
                    continue
                a, b = sorted((h[0] % (size + 1), h[1] % (size + 1)))
                a, b = counted.offset(a), counted.offset(b)
                first = h[3] % 100 < SUFFIX_FIRST
                form.append("spm" if first else "psm")
                out.append(f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if first else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}")
                cuts[0].append(a)
                cuts[1].append(b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(cuts[0], pa.int64()), pa.array(cuts[1], pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def _draw(salt: str, k: int) -> Column:
    """The k-th group of eight digits of the hash of a doc_id."""
    digits = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")


def infill(docs: DataFrame, units: str = "codepoint", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), salt: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain) and output of every document. ``salt`` gives other cuts, for a second pass."""
    if units not in CLASSES:
        raise ValueError(f"units are one of {sorted(CLASSES)}")
    if len(set(sentinels)) < 3 or not all(sentinels) or any(_overlap(a, b) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must differ, and none may begin as another (or itself) ends, or lie in another")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *(_draw(salt, k) for k in range(1, 5)))
    return rows.mapInArrow(bounded(_transformed(units, tuple(sentinels))), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _overlap(a: str, b: str) -> bool:
    """Whether b can begin inside a, which would let sentinels arise where parts meet."""
    return any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (a != b and a in b)


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``rows`` with a column restored: the exact text, from output and form alone."""
    p, s, m = sentinels
    quoted = "|".join("\\Q%s\\E" % x for x in sentinels)
    part = F.split("output", quoted, -1)
    whole = F.when(F.col("form") == "psm", F.concat(part[1], part[3], part[2])).when(F.col("form") == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col("output"))
    return rows.withColumn("restored", whole)


def op11_query(spark, sf_dir: str) -> DataFrame:
    made = restore(infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), draws AS (
    SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
             WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), cut AS (
    SELECT doc_id, t, n, form, least(x, y) AS a, greatest(x, y) AS b FROM draws
), parts AS (
    SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
