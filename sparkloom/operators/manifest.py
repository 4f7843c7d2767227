"""Incremental maintenance: what changed since the last run, what can be reused, what must go, and in which order to write.

manifest: path, hash, mtime; chunk manifest: path, chunk_id, content_hash; current files: path, hash, mtime (hash may be null where
the modification time already tells that nothing changed and the file was not read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("new", "changed", "touched", "unchanged", "deleted")


def diff_files(current: DataFrame, manifest: DataFrame, full_walk: bool = True) -> DataFrame:
    """path, action, hash, mtime from a full outer join. Without a full walk nothing counts as deleted."""
    c = current.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    m = manifest.select("path", F.col("hash").alias("_oh"), F.col("mtime").alias("_om"))
    both = c.withColumn("_here", F.lit(True)).join(m.withColumn("_there", F.lit(True)), "path", "full_outer")
    action = (
        F.when(F.col("_here").isNull(), "deleted")
        .when(F.col("_there").isNull(), "new")
        .when(F.col("_m") == F.col("_om"), "unchanged")
        .when(F.col("_h") == F.col("_oh"), "touched")
        .otherwise("changed")
    )
    out = both.select("path", action.alias("action"), F.coalesce("_h", "_oh").alias("hash"), F.coalesce("_m", "_om").alias("mtime"))
    return out if full_walk else out.filter("action <> 'deleted'")


def reuse_chunks(chunks: DataFrame, chunk_manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``vector`` and ``action`` (reuse or embed): a chunk whose hash is as before and whose vector is still stored is not embedded again."""
    m = chunk_manifest.select("path", F.col("chunk_id").alias("id"), F.col("content_hash").alias("_old"))
    s = stored.select("id", F.col("vector").alias("_vector"))
    both = chunks.join(m, ["path", "id"], "left").join(s, "id", "left")
    same = F.col("_old").eqNullSafe(F.col("content_hash")) & F.col("_vector").isNotNull()
    return both.withColumn("vector", F.when(same, F.col("_vector"))).withColumn("action", F.when(same, "reuse").otherwise("embed")).drop("_old", "_vector")


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` in place of those with the same key; of equal keys in ``new`` the row with the greatest values stays, column by column in order."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(once, allowMissingColumns=True)


def replace_sources(stored: DataFrame, sources: DataFrame, new: DataFrame, keep_if_empty: bool = False) -> DataFrame:
    """All rows of ``sources`` (``source``) go and ``new`` comes. ``keep_if_empty`` keeps the old rows where there is nothing new."""
    if keep_if_empty and new.isEmpty():
        return stored
    return stored.join(sources.select("source").distinct(), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def deleted_paths(prior: DataFrame, current: DataFrame) -> DataFrame:
    return prior.select("path").join(current.select("path"), "path", "left_anti").distinct()


def orphan_paths(graph_files: DataFrame, current: DataFrame, prior: DataFrame) -> DataFrame:
    """Files of the graph that neither exist nor were known."""
    return graph_files.select("path").join(current.select("path"), "path", "left_anti").join(prior.select("path"), "path", "left_anti").distinct()


def settle(embedded: DataFrame) -> DataFrame:
    """path, chunks, embedded, action: ``store`` if every chunk has a vector, ``retry`` if only some have (these are stored, the
    manifest row goes), ``skip`` if none has (nothing is written)."""
    counts = embedded.groupBy("path").agg(F.count("*").alias("chunks"), F.count("vector").alias("embedded"))
    return counts.withColumn("action", F.when(F.col("embedded") == F.col("chunks"), "store").when(F.col("embedded") > 0, "retry").otherwise("skip"))


def settled_manifest(manifest: DataFrame, current: DataFrame, verdict: DataFrame) -> DataFrame:
    """The manifest after a run: stored files as they are now, retried ones gone, all others as before."""
    moved = verdict.filter("action in ('store', 'retry')").select("path")
    stored = current.join(verdict.filter("action = 'store'").select("path"), "path", "left_semi")
    return manifest.join(moved, "path", "left_anti").unionByName(stored.select(*manifest.columns))


def staleness(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: stale, current and total files. Times are ignored and hashes compared; a file without hash counts in the total only."""
    m = manifest.select("path", F.col("hash").alias("_old"))
    both = current.select("path", "hash").join(m, "path", "left")
    fresh = F.col("hash").isNotNull() & F.col("hash").eqNullSafe(F.col("_old"))
    stale = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_old"))
    return both.agg(F.count_if(stale).alias("stale"), F.count_if(fresh).alias("current"), F.count("*").alias("total"))


def run_counters(diff: DataFrame, verdict: DataFrame | None = None) -> DataFrame:
    """One row: scanned, ingested, skipped, deleted, and embed_failed where a verdict is given."""
    live = F.col("action") != "deleted"
    out = diff.agg(
        F.count_if(live).alias("scanned"),
        F.count_if(F.col("action").isin("new", "changed")).alias("ingested"),
        F.count_if(F.col("action").isin("touched", "unchanged")).alias("skipped"),
        F.count_if(~live).alias("deleted"),
    )
    if verdict is None:
        return out
    return out.join(verdict.agg(F.coalesce(F.sum(F.col("chunks") - F.col("embedded")), F.lit(0)).alias("embed_failed")))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key: the one with the greatest ``order``, a partial aggregate, so a hot key is not sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def import_manifest(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old JSON entries (path, json) of two shapes, a bare hash or an object with hash, mtime and chunks, as file and chunk manifests."""
    full = F.from_json("json", "hash string, mtime bigint, chunks map<string,string>", {"mode": "PERMISSIVE"})
    e = entries.withColumn("_x", F.when(F.col("json").startswith("{"), full))
    bare = F.regexp_replace("json", '^"|"$', "")
    files = e.select("path", F.coalesce("_x.hash", F.when(~F.col("json").startswith("{"), bare)).alias("hash"), F.coalesce("_x.mtime", F.lit(0)).alias("mtime"))
    chunks = e.filter("_x.chunks is not null").select("path", F.explode("_x.chunks").alias("chunk_id", "content_hash"))
    return files.filter("hash is not null"), chunks
