"""Scalar functions over columns of text, paths and scores. All stay in the JVM.

Lengths count code points and comparisons are binary. White space is Unicode white space where a function trims.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds a symbol may have.
SYMBOL_KINDS = ["function", "class", "method", "interface", "type", "variable", "enum", "struct", "trait", "impl", "section", "unknown"]
#: Languages by file extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".dart": "dart",
}
DOC_EXTENSIONS = [".pdf", ".docx", ".xlsx"]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source: Column, *places: Column) -> Column:
    """Positional id of a chunk: hash of its source, then section and part numbers."""
    return F.concat_ws("-", F.sha2(source, 256), *(p.cast("string") for p in places))


def note_id(source: Column, text: Column) -> Column:
    """Id of a chunk added by hand: its source and eight digits of the hash of its text."""
    return F.concat(source, F.lit("::"), F.substring(F.sha2(text, 256), 1, 8))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscore."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != ""))


def all_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def identifier_words(name: Column) -> Column:
    """The words of an identifier in snake, kebab, camel case or with acronyms."""
    camel = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(camel, r"[\s_-]+"), lambda w: w != "")


def has_boundary(name: Column) -> Column:
    return name.rlike("[_-]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")


def strip_edges(word: Column) -> Column:
    """Without punctuation around it; word characters and hyphens stay."""
    return F.regexp_replace(word, r"^[^\w-]+|[^\w-]+$", "")


def dense_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def signature(text: Column, most: int = 160) -> Column:
    """The first line, cut."""
    return F.substring(F.substring_index(text, "\n", 1), 1, most)


def snippet(text: Column, lines: int = 5) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)


def project_table(project: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(F.lower(project), "[^a-z0-9]", "_"), 1, 64), F.lit("_chunks"))


def forward_slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the file name on; empty without one or for a leading dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def module_of(path: Column) -> Column:
    """The first directory, or root."""
    return F.when(F.locate("/", path) > 0, F.substring_index(path, "/", 1)).otherwise("root")


def language_of(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def is_document(path: Column) -> Column:
    return F.lower(extension(path)).isin(DOC_EXTENSIONS)


def repo_name(remote: Column) -> Column:
    """The last segment of an ssh or https remote, without .git; null if there is none."""
    name = F.regexp_extract(F.regexp_replace(trimmed(remote), r"(\.git)?/*$", ""), r"([^/:]+)$", 1)
    return F.when(name != "", name)


def known_kind(kind: Column) -> Column:
    """Null stays null; kinds not listed become unknown."""
    return F.when(kind.isNull() | kind.isin(SYMBOL_KINDS), kind).otherwise("unknown")


def is_test_path(path: Column) -> Column:
    """A test directory before the file name, or a test infix in it."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(above, F.array(*map(F.lit, ["test", "tests", "__tests__", "spec", "specs"]))) | basename(path).rlike(r"\.test\.|\.spec\.|_test\.|_spec\.")


def inside(path: Column, directory: Column) -> Column:
    return (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def closeness(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rendered_hit(path: Column, line: Column, kind: Column, name: Column, sign: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit("  "), kind, F.lit(" "), name, F.lit(" — "), sign)


def managed_block(text: Column, start: str, end: str) -> Column:
    """What stands between two markers, or null."""
    pattern = rf"(?s)\Q{start}\E\n?(.*?)\n?\Q{end}\E"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def without_block(text: Column, start: str, end: str) -> Column:
    return F.regexp_replace(text, rf"(?s)\n*\Q{start}\E.*?\Q{end}\E\n?", "\n")


def duration(ms: Column) -> Column:
    """Milliseconds as 850ms, 12.3s, or 2m 5s."""
    minutes, seconds = F.floor(ms / 60000), F.floor((ms % 60000) / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.format_number(ms / 1000, "0.0"), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))
    )


def prompt_of(json: Column) -> Column:
    """The prompt field of a JSON text; empty where the text is malformed or has none."""
    return F.coalesce(F.get_json_object(json, "$.prompt"), F.lit(""))


def iso_time(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def decision_record(title: Column, status: Column, body: Column) -> Column:
    return F.concat(F.lit("# ADR: "), title, F.lit("\n\nStatus: "), status, F.lit("\n\n"), body)


def decision_title(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^# ADR: (.+)$", 1)


def decision_status(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^Status: (.+)$", 1)
