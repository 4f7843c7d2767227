"""Bundles as files: reading them, bringing derived text into concepts that people edit too, and writing what changed.

A concept has three parts: front matter of which some keys are derived and the others a person's, a managed block that is derived, and prose that is a person's. ``merge`` brings
new derived parts into all concepts of a bundle at once and leaves the rest as it is; merging the same again changes nothing, not even the time of generation.

Defined cases: a null text counts as empty; of several rows with one path the least (by front and body) is taken; a document that opens a managed block and never closes it is left
as it is and reported as ``torn``, for nobody can tell what in it is derived; documents without anything derived are not touched.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import knowledge
from sparkloom.operators.knowledge import BLOCK_END, BLOCK_START
from sparkloom.sources import files as S

#: Keys of the front matter that are derived, and keys of which the derived value is only a start.
DERIVED = ["type", "title", "resource", "sources"]
SEEDED = ["description", "tags", "status", "stale_after", "verified"]
MERGED = "path string, status string, generated_at string, front string, body string, content string"
STUB = "# {{name}}\n\n## Purpose\n\n## Entry points\n\n## Dependencies\n"


class BundleError(RuntimeError):
    """The bundle's folder cannot be read."""


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """path (below the bundle), content of every Markdown file of a bundle; names that begin with a dot are passed over at every level, as are, by Spark's readers, those that begin
    with an underscore. A folder that is not there is an error, an empty one has no rows; what stands in the files is never an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise BundleError(f"no folder {root}")
    found = S.scan(spark, root).filter(F.lower("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\."))
    return found.select("path", S.text_of(F.col("content")).alias("content"))


def version(parsed: DataFrame) -> str | None:
    """The version that the bundle's first index declares, where it is a text."""
    row = parsed.filter("path = 'index.md'").select("front").first()
    said = json.loads(row["front"]).get("okf_version") if row else None
    return said if isinstance(said, str) else None


def block_of(body: str) -> str | None:
    """What stands in the managed block, or None."""
    _, start, rest = body.partition(BLOCK_START)
    inner, end, _ = rest.partition(BLOCK_END)
    return inner.strip("\r\n") if start and end else None


def with_block(body: str, derived: str) -> str:
    """The body with ``derived`` as its managed block: in the place of the first one, else behind the prose."""
    block = f"{BLOCK_START}\n{derived}\n{BLOCK_END}"
    before, start, rest = body.partition(BLOCK_START)
    if start:
        return before + block + rest.partition(BLOCK_END)[2]
    return f"{body.rstrip(chr(10))}\n\n{block}" if body else block


def rendered(front: dict, body: str) -> str:
    """A document's text; without front matter it is the body alone."""
    head = knowledge.rendered_front(front) + "\n" if any(v is not None and v != [] for v in front.values()) else ""
    return f"{head}{body.strip()}\n"


def merged(old: tuple[dict, str] | None, new: tuple[dict, str], now: str) -> tuple[str, dict, str]:
    """(status, front, body) of one document: ``new``, ``changed``, ``same`` or ``torn``."""
    derived = new[1].strip()
    by = (new[0].get("generated") or {}).get("by") or "sparkloom"
    stamp = {"by": by, "at": now}
    if old is None:
        return "new", {**new[0], "generated": stamp}, with_block("", derived)
    front, body = old
    if BLOCK_START in body and block_of(body) is None:
        return "torn", front, body
    out = {k: v for k, v in front.items() if k not in DERIVED} | {k: new[0][k] for k in DERIVED if new[0].get(k) is not None}
    out |= {k: new[0][k] for k in SEEDED if front.get(k) is None and new[0].get(k) is not None}
    same = all(front.get(k) == out.get(k) for k in DERIVED) and block_of(body) == derived
    out["generated"] = front.get("generated") or stamp if same else stamp
    untouched = same and out == front
    return "same" if untouched else "changed", out, body if untouched else with_block(body, derived)


def merge(existing: DataFrame, derived: DataFrame, now: str) -> DataFrame:
    """path, status, generated_at, front (JSON), body, content (the whole text) of every path of ``derived`` (path, front as JSON, body) after its merge with ``existing`` (path, front, body, content).

    A document whose status is ``same`` or ``torn`` keeps its text byte for byte."""

    def once(df: DataFrame, *values: str) -> DataFrame:
        return df.groupBy("path").agg(F.min(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in values))).alias("_one")).select("path", *(F.col(f"_one.{c}").alias(c) for c in values))

    new = once(derived.filter("path is not null"), "front", "body")
    old = once(existing.filter("path is not null"), "front", "body", "content").select("path", *(F.col(c).alias(f"old_{c}") for c in ("front", "body", "content")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, front, body, old_front, old_body, old_content in zip(*(pdf[c] for c in ("path", "front", "body", "old_front", "old_body", "old_content"))):
                before = None if pd.isna(old_body) else (json.loads(old_front or "{}"), old_body)
                status, f, b = merged(before, (json.loads(front or "{}"), body), now)
                said = f.get("generated")
                at = said.get("at") if isinstance(said, dict) else None
                text = old_content if status in ("same", "torn") else rendered(f, b)
                rows.append((path, status, at and str(at), json.dumps(f, sort_keys=True, ensure_ascii=False), b, text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED.split(", ")])

    return new.join(old, "path", "left").mapInPandas(run, MERGED)


def module_stubs(modules: DataFrame, existing: DataFrame, template: str = STUB) -> DataFrame:
    """path, content of a page for each module that has none yet; ``existing`` has the paths that are there. Nulls and blank names have no page."""
    named = modules.filter(F.trim("module") != "").select("module").distinct()
    made = named.select(F.concat(F.lit("docs/modules/"), "module", F.lit(".md")).alias("path"), F.replace(F.lit(template), F.lit("{{name}}"), F.col("module")).alias("content"))
    return made.join(existing.select("path").distinct(), "path", "left_anti")


def write_files(files: DataFrame, root: str) -> int:
    """Writes each row (path below ``root``, content) as a file, by a draft beside it that is then moved over it, so readers see the old text or the new one and a task that runs twice does no harm. How many.
    A path that leads out of the folder is an error before anything is written. ``root`` is a folder that all executors share."""
    out = files.select("path", "content").filter("path is not null and content is not null")
    path = F.concat(F.lit("/"), F.col("path"), F.lit("/"))
    bad = out.filter(F.contains(path, F.lit("/../")) | F.startswith(F.col("path"), F.lit("/"))).first()
    if bad:
        raise BundleError(f"{bad['path']} leads out of {root}")
    base = root.rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        disk, at = fs.FileSystem.from_uri(base if ":" in base else f"file://{base}")
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                target = f"{at}/{name}"
                folder, leaf = posixpath.split(target)
                disk.create_dir(folder, recursive=True)
                draft = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
                with disk.open_output_stream(draft) as f:
                    f.write(content.encode())
                disk.move(draft, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return out.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def update(spark: SparkSession, root: str, derived: DataFrame, now: str) -> DataFrame:
    """Merges ``derived`` into the bundle below ``root`` and writes the documents that are new or changed; gives path, status of all."""
    from sparkloom.session import stage

    done = stage(merge(knowledge.front_matter(read_bundle(spark, root)), derived, now), "merged")
    write_files(done.filter("status in ('new', 'changed')"), root)
    return done.select("path", "status")


def routed_files(files: DataFrame, bundle: str) -> DataFrame:
    """Files (path, content) as the index takes them: those outside the bundle as they are, fit concepts as their projected text, and of the rest of the bundle nothing."""
    within = X.inside(F.col("path"), F.lit(bundle))
    inner = knowledge.front_matter(files.filter(within & F.lower("path").endswith(".md")).withColumn("path", F.expr(f"substring(path, {len(bundle) + 2})")))
    fit = knowledge.indexable(inner).select(F.concat(F.lit(f"{bundle}/"), "source").alias("path"), "content")
    return files.filter(~within).select("path", "content").unionByName(fit)
