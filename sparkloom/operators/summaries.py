"""Summaries of modules, kept up to date by commits: what a commit changed in a module and the summary so far become a request to a language model, and its answer takes the summary's place.

The model is a function from a request to a text, given by the user and called in the tasks, twice at most for a module; a module for which it fails keeps its summary and is reported.

Defined cases: an empty answer counts as a failure; a module without a summary gets its first; a null diff or message counts as empty; texts of any length are passed on whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import knowledge

Complete = Callable[[str], str]
#: The module under which summaries are stored, and the headings of a summary.
MODULE = "concept"
HEADINGS = ["Purpose", "Key Files", "Dependencies", "Data Flow", "Gotchas"]
TRIES = 2


def source(module: Column) -> Column:
    """The source under which a module's summary is stored."""
    return F.concat(F.lit("concept:"), module, F.lit(".md"))


def stored(chunks: DataFrame) -> DataFrame:
    """source, content: the summaries, put together again from their chunks."""
    return knowledge.rebuilt(chunks.filter(F.col("module") == MODULE), ["source"])


def request(module: Column, message: Column, diff: Column, before: Column) -> Column:
    """What the model is asked for one module."""
    told = lambda c: F.coalesce(c, F.lit(""))
    heads = "\n".join(f"## {h}" for h in HEADINGS)
    return F.concat(
        F.lit("Revise the summary of module "), module, F.lit(" for readers who ask what it does and where things are; what this commit left alone stays as it is.\n"),
        F.lit(f"Answer with the whole summary in Markdown, from the first to the last of these headings and nothing around them:\n{heads}\n\nCommit message:\n"), told(message),
        F.lit("\n\nChanges of the commit in this module:\n"), told(diff), F.lit("\n\nSummary so far:\n"), F.when(told(before) == "", "(there is none)").otherwise(before),
    )


def completed(requests: DataFrame, complete: Complete) -> DataFrame:
    """module, content, error: the model's answer to each request (module, request), or why there is none."""

    def one(text: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(TRIES):
            try:
                if got := (complete(text) or "").strip():
                    return got, None
                error = "empty answer"
            except Exception as e:  # noqa: BLE001  whatever a client raises is this module's failure alone
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [one(t) for t in frame["request"]]
            yield pd.DataFrame({"module": frame["module"], "content": [c for c, _ in said], "error": [e for _, e in said]})

    return requests.select("module", "request").mapInPandas(run, "module string, content string, error string")
