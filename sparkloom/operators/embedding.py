"""Texts to vectors by a service that may fail: batches are retried, then halved, so that a bad text fails alone and a dead service is not asked for ever.

An embedder takes a list of texts and gives a list of vectors (or None) of the same length; anything else, an exception included, is a failure of the whole batch. A failed batch is tried
again after a pause that doubles; then its halves are tried by themselves, down to the single text, which gets no vector. After ``BREAKER`` single texts in a row have failed the
service counts as down, and what is left of the partition gets no vectors without being asked for. Batches run side by side: one more at a time after a round without a failure, half
as many after one with a failure.

Defined cases: no texts give no call; None and vectors with a value that is not finite count as no vector, not as a failure; equal texts are sent once a batch.
"""

from __future__ import annotations

import math
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float] | None]]
BATCH, TRIES, PAUSE, BREAKER, SIDE_BY_SIDE = 64, 3, 0.05, 20, 8


class Service:
    """An embedder with its failures counted; ``down`` once the breaker has opened."""

    def __init__(self, embed: Embedder, tries: int = TRIES, pause: float = PAUSE, breaker: int = BREAKER):
        self.embed, self.tries, self.pause, self.breaker = embed, tries, pause, breaker
        self.failed = self.in_a_row = 0

    @property
    def down(self) -> bool:
        return self.in_a_row >= self.breaker

    def _once(self, texts: list[str]) -> list[list[float] | None]:
        distinct = list(dict.fromkeys(texts))
        out = self.embed(distinct)
        if len(out) != len(distinct):
            raise ValueError(f"{len(out)} vectors for {len(distinct)} texts")
        of = {t: None if v is None or not all(map(math.isfinite, v)) else [float(x) for x in v] for t, v in zip(distinct, out)}
        return [of[t] for t in texts]

    def vectors(self, texts: list[str]) -> list[list[float] | None]:
        if not texts or self.down:
            return [None] * len(texts)
        for attempt in range(self.tries):
            try:
                out = self._once(texts)
                self.in_a_row = 0
                return out
            except Exception:  # noqa: BLE001  whatever the service throws is a failure of this batch
                self.failed += 1
                if attempt + 1 < self.tries:
                    time.sleep(self.pause * 2**attempt)
        if len(texts) == 1:
            self.in_a_row += 1
            return [None]
        half = len(texts) // 2
        return self.vectors(texts[:half]) + self.vectors(texts[half:])

    def all(self, texts: list[str], batch: int = BATCH, most: int = SIDE_BY_SIDE) -> list[list[float] | None]:
        """All vectors, in batches side by side."""
        parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
        out: list[list[float] | None] = []
        width = 1
        with ThreadPoolExecutor(most) as pool:
            while parts:
                before = self.failed
                for one in pool.map(self.vectors, parts[:width]):
                    out += one
                parts = parts[width:]
                width = min(width + 1, most) if self.failed == before else max(width // 2, 1)
        return out


def embedded(chunks: DataFrame, embed: Embedder, text: str = "content") -> DataFrame:
    """``chunks`` with a vector where there was none and the embedder gave one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = Service(embed)  # one for each task: its breaker holds for the partition
        for pdf in frames:
            pdf["vector"] = service.all(pdf[text].tolist())
            yield pdf

    typed = chunks.withColumn("vector", F.col("vector").cast("array<float>"))
    todo = typed.filter("vector is null")
    return typed.filter("vector is not null").unionByName(todo.mapInPandas(run, todo.schema))


class QueryCache:
    """Vectors of queries by model and text: at most ``size``, the one that was used longest ago goes first. A query without a vector is not kept."""

    def __init__(self, size: int = 1000):
        self.size, self.hits, self.misses = size, 0, 0
        self._held: OrderedDict[tuple[str, str], list[float]] = OrderedDict()

    def vector(self, model: str, text: str, embed: Embedder) -> list[float] | None:
        key = (model, text)
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        found = Service(embed).vectors([text])[0]
        if found is not None and self.size > 0:
            self._held[key] = found
            if len(self._held) > self.size:
                self._held.popitem(last=False)
        return found
