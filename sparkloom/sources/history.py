"""A repository's history as rows: commits, the files each changed, and when a file or a range of its lines last changed.

The clock of an audit has to mean the same on every machine, so it is that of commits and not of files, which a fresh clone stamps anew. The work is done by the ``git`` program in the
tasks: one task a repository lists the commits as a stream, then blocks of commits, and ranges of lines, are spread over all tasks, whichever repository they are of. Executors need the
program and see the repositories under the same path (a shared folder); nothing is written to a repository, and its locks are left alone.

Defined cases: a merge changed a file only if the file differs from that of every parent; the first commit changed all its files; a rename is a deletion and an addition; a file's last
change is the first in the order of the log, so one that a merge threw away counts as well; a range of lines that the file does not have falls back to the whole file; a file that was never
committed has no time and is open; a path that is not UTF-8 has replacement characters; a folder that is no repository, or holds no commit, is an error, or without ``strict`` has no rows.
"""

from __future__ import annotations

import contextlib
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import width

#: Commits that one run of the program compares with their parents; their ids fit into a pipe.
BLOCK = 500
#: Rows of a batch.
BATCH = 2000
ID = (40, 64)


class HistoryError(RuntimeError):
    """The program could not answer for a repository."""


def _start(root: str, args: list[str]) -> subprocess.Popen:
    # A hook runs with the folders of its own repository in the environment.
    own = {k: v for k, v in os.environ.items() if k not in ("GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE", "GIT_PREFIX")}
    return subprocess.Popen(
        ["git", "-C", root, "--literal-pathspecs", *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={**own, "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    )


def _fields(root: str, args: list[str], feed: str = "", strict: bool = True) -> Iterator[str]:
    """What the program prints, cut at NUL, as it comes. ``feed`` must fit into a pipe."""
    with _start(root, args) as p:
        with contextlib.suppress(BrokenPipeError):  # it gave up at once, and says why below
            p.stdin.write(feed.encode())
            p.stdin.close()
        rest = b""
        while piece := p.stdout.read(1 << 20):
            *whole, rest = (rest + piece).split(b"\0")
            yield from (w.decode("utf-8", "replace") for w in whole)
        if rest:
            yield rest.decode("utf-8", "replace")
        said = p.stderr.read().decode("utf-8", "replace").strip()
    if p.returncode and strict:
        raise HistoryError(f"{root}: {said or p.returncode}")


def answer(root: str, *args: str) -> str:
    """What the program prints about one repository; for short answers, such as one commit's message."""
    return "\0".join(_fields(root, list(args)))


def commit_id(root: str, commit: str = "HEAD") -> str:
    return answer(root, "rev-parse", "--verify", "--end-of-options", f"{commit}^{{commit}}").strip()


def message(root: str, commit: str = "HEAD") -> str:
    return answer(root, "log", "-1", "--format=%B", commit_id(root, commit)).strip()


def module_diff(root: str, module: str, commit: str = "HEAD") -> str:
    """What a commit changed in the files below a module's folder."""
    return answer(root, "show", commit_id(root, commit), "--format=", "--", f"{module.rstrip('/')}/")


def repository(spark: SparkSession, project: str, root: str) -> DataFrame:
    return spark.createDataFrame([(project, root)], "project string, root string")


def _apart(repos: DataFrame) -> DataFrame:
    """A few repositories a task."""
    return repos.select("project", "root").repartition(width(repos.sparkSession), "project", "root")


def commits(repos: DataFrame, head: str = "HEAD", strict: bool = True) -> DataFrame:
    """project, root, position (0 is the newest), commit, parents, at, message of all commits that ``head`` reaches in repositories (project, root)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["project", "root", "position", "commit", "parents", "at", "message"]
        for frame in frames:
            for project, root in zip(frame["project"], frame["root"]):
                rows = []
                for n, text in enumerate(_fields(root, ["log", "-z", "--format=%H%x1f%P%x1f%ct%x1f%B", "--end-of-options", head, "--"], strict=strict)):
                    commit, parents, at, said = text.split("\x1f", 3)
                    rows.append((project, root, n, commit, parents.split(), int(at), said.strip()))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    rows = _apart(repos).mapInPandas(of, "project string, root string, position long, commit string, parents array<string>, at long, message string")
    return rows.withColumn("at", F.timestamp_seconds("at"))


def changes(commits: DataFrame) -> DataFrame:
    """project, position, commit, at, path, status (A, M, D, T; of merges one letter a parent) of every file that each commit changed."""
    spark = commits.sparkSession

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (project, root), some in frame.groupby(["project", "root"], sort=False):
                ids = list(some["commit"])
                for k in range(0, len(ids), BLOCK):
                    rows, commit, status = [], None, None
                    args = ["diff-tree", "--stdin", "-r", "--root", "-c", "--no-renames", "--name-status", "-z"]
                    for field in _fields(root, args, "".join(f"{i}\n" for i in ids[k : k + BLOCK])):
                        if status is not None:
                            rows.append((project, commit, field, status))
                            status = None
                        elif len(field) in ID:
                            commit = field
                        else:
                            status = field
                        if len(rows) == BATCH:
                            yield pd.DataFrame(rows, columns=["project", "commit", "path", "status"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["project", "commit", "path", "status"])

    blocks = commits.select("project", "root", "commit", "position").repartition(width(spark), "project", "root", F.floor(F.col("position") / BLOCK))
    found = blocks.select("project", "root", "commit").mapInPandas(of, "project string, commit string, path string, status string")
    return found.join(commits.select("project", "commit", "position", "at"), ["project", "commit"]).select("project", "position", "commit", "at", "path", "status")


def dirty(repos: DataFrame, strict: bool = True) -> DataFrame:
    """project, path of every file that the working tree has changed, staged, or never tracked; of a rename both paths."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for project, root in zip(frame["project"], frame["root"]):
                rows, fields = [], _fields(root, ["status", "--porcelain", "-z", "--untracked-files=all"], strict=strict)
                for field in fields:
                    rows.append((project, field[3:]))
                    if "R" in field[:2] or "C" in field[:2]:
                        rows.append((project, next(fields)))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["project", "path"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["project", "path"])

    return _apart(repos).mapInPandas(of, "project string, path string").distinct()


def present(repos: DataFrame, strict: bool = True) -> DataFrame:
    """project, path of every file in the working tree that no ignore rule hides, dot files and empty files included."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for project, root in zip(frame["project"], frame["root"]):
                gone, rows = set(_fields(root, ["ls-files", "-z", "--deleted"], strict=strict)), []
                for path in _fields(root, ["ls-files", "-z", "--cached", "--others", "--exclude-standard"], strict=strict):
                    if path not in gone:
                        rows.append((project, path))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["project", "path"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["project", "path"])

    return _apart(repos).mapInPandas(of, "project string, path string").distinct()


def diffs(modules: DataFrame) -> DataFrame:
    """module, diff of rows (root, commit, module): what the commit changed below each module's folder. Each diff is made in a task."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, commit, module in zip(frame["root"], frame["commit"], frame["module"]):
                yield pd.DataFrame([(module, module_diff(root, module, commit))], columns=["module", "diff"])

    return modules.select("root", "commit", "module").repartition(width(modules.sparkSession), "module").mapInPandas(of, "module string, diff string")


def clock(changes: DataFrame, dirty: DataFrame) -> DataFrame:
    """project, path, at, uncommitted: the last change of every path of the history, deleted ones included, and of every open one."""
    last = changes.groupBy("project", "path").agg(F.min_by("at", "position").alias("at"))
    both = last.join(dirty.select("project", "path", F.lit(True).alias("_open")), ["project", "path"], "full")
    return both.select("project", "path", "at", F.coalesce("_open", F.lit(False)).alias("uncommitted"))


def ranged_clock(ranges: DataFrame, repos: DataFrame, clock: DataFrame) -> DataFrame:
    """project, path, line_start, line_end, at, uncommitted of places (project, path, line_start, line_end): the last change of these lines where they are given and the file has them,
    else of the file. Places that the clock does not know are left out."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = []
            for root, path, a, b in zip(frame["root"], frame["path"], frame["line_start"], frame["line_end"]):
                said = "".join(_fields(root, ["log", "-1", "-s", "--format=%ct", f"-L{int(a)},{int(b)}:{path}"], strict=False)).split()
                at.append(int(said[0]) if said else None)
            yield pd.DataFrame({"project": frame["project"], "path": frame["path"], "line_start": frame["line_start"], "line_end": frame["line_end"], "at": pd.Series(at, dtype="Int64")})

    key = ["project", "path", "line_start", "line_end"]
    places = ranges.select(*key).distinct()
    asked = places.filter("line_start is not null and line_end is not null").join(repos.select("project", "root"), "project")
    spread = asked.repartition(width(ranges.sparkSession), *key)
    lines = spread.mapInPandas(of, "project string, path string, line_start int, line_end int, at long").withColumn("_at", F.timestamp_seconds("at"))
    whole = places.join(clock.select("project", "path", "at", "uncommitted"), ["project", "path"])
    both = whole.alias("w").join(lines.alias("l"), [F.col(f"w.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key], "left")
    return both.select(*[f"w.{c}" for c in key], F.coalesce("_at", "w.at").alias("at"), "uncommitted")
