"""Files as rows: scanning, gates, binary sniffing, ignore rules and text from office documents.

Content is read by Spark's binary reader, so any file system that Spark knows will do. Ignore rules are compiled on the driver to
one expression over paths (their number is that of the lines of ignore files), so they are evaluated in the JVM.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X

MOST_TEXT, MOST_DOCUMENT, MOST_EXTRACTED, SNIFF = 512_000, 10_000_000, 1_000_000, 8192
#: Directories that a walk never enters; matched as prefixes or behind any slash, so ``src/builder.ts`` falls to ``build``.
WALK_IGNORED = [
    "node_modules/", ".git/", "dist/", "build/", ".next/", ".nuxt/", ".svelte-kit/", ".turbo/", ".vercel/", "target/", ".gradle/", ".idea/", ".kotlin/",
    "generated/", "intermediates/", "outputs/", "__pycache__/", ".venv/", ".mypy_cache/", ".build/", "DerivedData/", "Pods/", ".cache/", "coverage/", ".nyc_output/",
]
#: Names that hide a file wherever they stand as a whole segment of its path.
SEGMENT_IGNORED = [".git", "node_modules", "dist", "build", ".next", "target", "__pycache__", ".claude"]


def scan(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """path (below ``root``), content, size, mtime (ms). With ``paths`` only these files are read and no rule is applied to them."""
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load([f"{root}/{p}" for p in paths] if paths else root)
    return found.select(_below(root).alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def _below(root: str) -> Column:
    root = root.rstrip("/")
    return F.regexp_replace(F.col("path"), r"^(?:[a-z]+:/{0,2})?/*" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).lstrip("/")) + "/", "")


def size_gate(path: Column, size: Column) -> Column:
    return size <= F.when(X.is_document(path), MOST_DOCUMENT).otherwise(MOST_TEXT)


def looks_binary(content: Column) -> Column:
    """Of the first bytes: a NUL tells at once, else more than a tenth of characters that are no UTF-8. An empty file is text."""
    head = F.substring(content, 1, SNIFF)
    text = F.make_valid_utf8(head.cast("string"))
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.hex(head).rlike("^(?:..)*?00") | (broken > 0.1 * F.length(text))


def text_of(content: Column) -> Column:
    """The content as UTF-8; what is not becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def walk_ignored(path: Column, patterns: list[str] | None = None, exact: bool = False) -> Column:
    """Whether a walk passes a path over. ``exact`` matches whole segments only."""
    names = [p.rstrip("/") for p in patterns or WALK_IGNORED]
    if exact:
        return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.startswith(path, F.concat(n, F.lit("/"))) | F.contains(path, F.concat(F.lit("/"), n)))


def glob_regex(pattern: str) -> str:
    """``**`` passes slashes, ``*`` and ``?`` do not, everything else is literal."""
    part = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(part.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", pattern, re.S))


def rule_matches(path: Column, rule: str) -> Column:
    """One rule: a directory (with a slash at its end) anywhere, a glob on the file name or the whole path, or a path and what is below."""
    if rule.endswith("/"):
        return F.contains(path, F.lit(rule))
    if "*" in rule or "?" in rule:
        whole = f"^{glob_regex(rule)}$"
        return X.basename(path).rlike(whole) | path.rlike(whole)
    return (path == rule) | F.startswith(path, F.lit(rule + "/"))


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches decides; one that begins with ``!`` takes a path in again. Some names are ignored whatever the rules."""
    verdict = F.lit(False)
    for rule in rules:
        if rule.startswith("!"):
            verdict = verdict & ~rule_matches(path, rule[1:])
        else:
            verdict = verdict | rule_matches(path, rule)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SEGMENT_IGNORED))) | verdict


def nested_rules(ignore_files: dict[str, str]) -> list[str]:
    """Rules of ignore files by directory (``""`` is the root), parents first, children by name; a child's rules get its directory in front."""
    out = []
    for directory in sorted(ignore_files, key=lambda d: d.split("/") if d else []):
        for line in ignore_files[directory].splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            sign, rule = ("!", line[1:]) if line.startswith("!") else ("", line)
            out.append(sign + (f"{directory}/{rule.lstrip('/')}" if directory else rule))
    return out


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))


def _xlsx(data: bytes) -> str:
    """A sheet is its name as a heading, then a line per row, each filled cell with its column's heading; without headings, cells and tabs."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            rows: dict[int, dict[int, str]] = {}
            for r, row in enumerate(ElementTree.fromstring(z.read("xl/" + targets[sheet.get(rel)].removeprefix("/xl/"))).iter(f"{m}row")):
                number = int(row.get("r", r + 1))
                for c, cell in enumerate(row.iter(f"{m}c")):
                    letters = re.match("[A-Z]*", cell.get("r", "")).group()
                    column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) if letters else c + 1
                    v = cell.find(f"{m}v")
                    raw = "".join(t.text or "" for t in cell.iter(f"{m}t")) if cell.get("t") == "inlineStr" else (v.text if v is not None else "") or ""
                    value = shared[int(raw)] if cell.get("t") == "s" and raw else raw
                    if value.strip():
                        rows.setdefault(number, {})[column] = value.strip()
            heads, lines = rows.pop(1, {}), []
            for _, cells in sorted(rows.items()):
                if heads:
                    lines.append("; ".join(f"{heads.get(c, f'Col{c}')}: {v}" for c, v in sorted(cells.items())))
                else:
                    lines.append("\t".join(v for _, v in sorted(cells.items())))
            out.append("\n".join([f"## {sheet.get('name')}", *lines]))
    return "\n\n".join(out)


def extract_documents(files: DataFrame, pdf: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """path, text of office documents (path, content): null where a document cannot be read, an empty text where it has none. A reader of PDF files is
    a parameter, for none comes with Python. Texts are cut at a documented number of characters."""

    def one(path: str, data: bytes) -> str | None:
        try:
            kind = path.lower().rsplit(".", 1)[-1]
            text = _docx(data) if kind == "docx" else _xlsx(data) if kind == "xlsx" else pdf(data) if pdf and kind == "pdf" else None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
            return None
        return text[:MOST_EXTRACTED] if text is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in frames:
            yield pd.DataFrame({"path": pdf_["path"], "text": [one(p, c) for p, c in zip(pdf_["path"], pdf_["content"])]})

    return files.select("path", "content").filter(X.is_document(F.col("path"))).mapInPandas(run, "path string, text string")


#: Files up to which those that changed are read by name; beyond, the tree is read and the others are dropped.
MOST_NAMED = 20_000


def ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> dict[str, str]:
    """The ignore files of a tree by directory, none from directories that a walk never enters. Spark's readers pass dot files over, so the tasks look for one in each directory
    that holds a file, or leads to one, by the file system that pyarrow knows for ``root``. The rules are compiled on the driver anyway."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = scan(spark, root).select("path").filter(~walk_ignored(F.col("path"))).select(F.explode(above).alias("path")).distinct()
    base = root.rstrip("/")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(base if ":" in base else f"file://{base}")
        for pdf_ in frames:
            out = []
            for d in pdf_["path"]:
                place = "/".join(x for x in (at.rstrip("/"), d, name) if x)
                if files.get_file_info(place).type == fs.FileType.File:
                    with files.open_input_stream(place) as f:
                        out.append((d, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "text"])

    return {r["path"]: r["text"] for r in directories.mapInPandas(look, "path string, text string").collect()}


def list_files(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """path, size, mtime of the files that a walk takes in; no content is read."""
    found = scan(spark, root).select("path", "size", "mtime")
    found = found.filter(~walk_ignored(F.col("path")) & ~ignored(F.col("path"), rules or []))
    return found.filter(size_gate(F.col("path"), F.col("size")))


def read_files(spark: SparkSession, root: str, rules: list[str] | None = None, paths: list[str] | None = None, pdf: Callable | None = None, known: DataFrame | None = None) -> DataFrame:
    """path, content (text), hash, mtime of all files that pass the rules, gates and the sniff; documents come as their text.

    Spark's readers pass over dot files and files without bytes, so these are never among them. With ``known`` (path, hash, mtime) a file whose time has not moved is not read: it comes with a null content and the known hash."""
    if known is None or paths:
        return _contents(scan(spark, root, paths) if paths else _walked(spark, root, rules), pdf)
    listed = list_files(spark, root, rules).join(known.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m")), "path", "left")
    same = F.coalesce(F.col("mtime") == F.col("_m"), F.lit(False))
    old = listed.filter(same).select("path", F.lit(None).cast("string").alias("content"), F.col("_h").alias("hash"), "mtime")
    moved = listed.filter(~same).select("path")
    names = [r["path"] for r in moved.limit(MOST_NAMED + 1).collect()]
    if not names:
        return old
    read = _contents(scan(spark, root, names), pdf) if len(names) <= MOST_NAMED else _contents(_walked(spark, root, rules).join(moved, "path", "left_semi"), pdf)
    return old.unionByName(read)


def _walked(spark: SparkSession, root: str, rules: list[str] | None) -> DataFrame:
    return scan(spark, root).filter(~walk_ignored(F.col("path")) & ~ignored(F.col("path"), rules or []))


def _contents(found: DataFrame, pdf: Callable | None) -> DataFrame:
    found = found.filter(size_gate(F.col("path"), F.col("size")))
    plain = found.filter(~F.coalesce(X.is_document(F.col("path")), F.lit(False)) & ~looks_binary(F.col("content")))
    texts = plain.select("path", text_of(F.col("content")).alias("content"), "mtime")
    documents = extract_documents(found, pdf).filter("text is not null").join(found.select("path", "mtime"), "path")
    both = texts.unionByName(documents.select("path", F.col("text").alias("content"), "mtime"))
    return both.select("path", "content", X.content_hash(F.col("content")).alias("hash"), "mtime")


#: Manifest file, language, and (word, framework) pairs. In package.json a word is the name of a dependency, elsewhere it stands anywhere in the text.
STACK = [
    ("package.json", "JavaScript", [("react", "React"), ("vue", "Vue"), ("next", "Next.js"), ("nuxt", "Nuxt"), ("svelte", "Svelte"), ("@sveltejs/kit", "SvelteKit"), ("express", "Express"), ("fastify", "Fastify"), ("hono", "Hono"), ("@nestjs/core", "NestJS"), ("@remix-run/node", "Remix"), ("@remix-run/react", "Remix"), ("@tanstack/react-router", "TanStack Router"), ("astro", "Astro"), ("elysia", "Elysia"), ("react-native", "React Native"), ("expo", "Expo"), ("@angular/core", "Angular"), ("solid", "SolidJS"), ("solid-js", "SolidJS")]),
    ("go.mod", "Go", [("gin-gonic/gin", "Gin"), ("labstack/echo", "Echo"), ("gofiber/fiber", "Fiber"), ("go-chi/chi", "Chi")]),
    ("Cargo.toml", "Rust", [("actix-web", "Actix"), ("axum", "Axum"), ("rocket", "Rocket"), ("tauri", "Tauri")]),
    ("pyproject.toml", "Python", [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask"), ("sqlalchemy", "SQLAlchemy")]),
    ("requirements.txt", "Python", [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask")]),
    ("build.gradle.kts", "Kotlin", [("multiplatform", "Kotlin Multiplatform"), ("compose", "Jetpack Compose"), ("ktor", "Ktor"), ("spring-boot", "Spring Boot"), ("org.springframework", "Spring Boot"), ("android", "Android")]),
    ("build.gradle", "Kotlin", [("multiplatform", "Kotlin Multiplatform"), ("compose", "Jetpack Compose"), ("ktor", "Ktor"), ("spring-boot", "Spring Boot"), ("springframework", "Spring Boot"), ("android", "Android")]),
    ("pom.xml", "Java", [("spring-boot", "Spring Boot"), ("quarkus", "Quarkus"), ("micronaut", "Micronaut")]),
    ("Package.swift", "Swift", [("vapor", "Vapor"), ("hummingbird", "Hummingbird")]),
    ("pubspec.yaml", "Dart", [("flutter", "Flutter")]),
    ("Gemfile", "Ruby", [("rails", "Rails"), ("sinatra", "Sinatra")]),
    ("composer.json", "PHP", [("laravel", "Laravel"), ("symfony", "Symfony")]),
    ("mix.exs", "Elixir", [("phoenix", "Phoenix")]),
]


def detect_stack(files: DataFrame, *by: str) -> DataFrame:
    """One row (one for each value of the columns ``by``): languages and frameworks told by manifest files (path, content). A package.json that is no JSON object tells its language only; a dependency with an empty version counts for nothing."""
    spark = files.sparkSession
    rules = spark.createDataFrame([(f, lang, probe, name) for f, lang, probes in STACK for probe, name in [*probes, (None, None)]], "_file string, language string, _probe string, framework string")
    named = files.withColumn("_name", X.basename(F.col("path")))
    hits = named.join(F.broadcast(rules), F.col("_name") == F.col("_file"))
    read = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    version = F.coalesce(F.try_element_at(read["devDependencies"], F.col("_probe")), F.try_element_at(read["dependencies"], F.col("_probe")))
    plain = F.contains(F.when(F.col("_file") == "requirements.txt", F.lower("content")).otherwise(F.col("content")), F.col("_probe"))
    found = hits.filter(F.col("_probe").isNull() | F.when(F.col("_file") == "package.json", F.coalesce(version != "", F.lit(False))).otherwise(plain))
    sets = found.groupBy(*by).agg(F.collect_set("language").alias("languages"), F.collect_set("framework").alias("frameworks"))
    return sets.select(*by, F.sort_array("languages").alias("languages"), F.sort_array("frameworks").alias("frameworks"))


def modules(files: DataFrame) -> DataFrame:
    """Top-level directories, not hidden and not ignored, that hold a source file at any depth."""
    top = F.substring_index("path", "/", 1)
    source = X.language_of(F.col("path")).isNotNull()
    return files.filter(F.col("path").contains("/") & source & ~F.col("path").startswith(".") & ~walk_ignored(F.col("path"), exact=True)).select(top.alias("module")).distinct()
