"""Queries of scans, the chunk store and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunking, manifest
from sparkloom.plans import bindings as B
from sparkloom.plans.registry import query
from sparkloom.sources import files as S
from sparkloom.streaming import folder, watch


@query("scan_documents", f"WITH {B.DOCS} SELECT path, module, sha256(content) AS content_hash, sha256(path) || '-0' AS id, len(string_split(content, chr(10)))::INT AS lines FROM docs")
def scan_documents(spark, d):
    x = B.documents(spark, d)
    return x.select("path", "module", X.content_hash(F.col("content")).alias("content_hash"), X.chunk_id(F.col("path"), F.lit(0)).alias("id"), F.size(F.split("content", "\n", -1)).alias("lines"))


@query("module_list", f"WITH {B.DOCS} SELECT DISTINCT module FROM docs")
def module_list(spark, d):
    return B.documents(spark, d).select("module").distinct().orderBy("module")


@query("module_chunks", f"WITH {B.DOCS} SELECT path, content FROM docs WHERE module = 'src0'")
def module_chunks(spark, d):
    return B.documents(spark, d).filter("module = 'src0'").select("path", "content").orderBy("path")


@query("project_listing", f"WITH {B.DOCS} SELECT lang || '_chunks' AS project, count(*) AS chunks, 64 AS dim FROM docs GROUP BY lang")
def project_listing(spark, d):
    counts = B.documents(spark, d).groupBy("lang").agg(F.count("*").alias("chunks"))
    meta = B.documents(spark, d).select("lang").distinct().withColumn("dim", F.lit(64))
    return counts.join(meta, "lang", "left").select(X.project_table(F.col("lang")).alias("project"), "chunks", "dim")


@query("lookup_batch", "SELECT doc_id, source FROM documents JOIN (SELECT item_id AS doc_id FROM benchmark) USING (doc_id)")
def lookup_batch(spark, d):
    ids = B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return B.table(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "source")


@query("store_upsert", f"WITH {B.FILES} SELECT path, hash FROM prior WHERE path NOT IN (SELECT path FROM cur) UNION ALL SELECT path, hash FROM cur")
def store_upsert(spark, d):
    prior, now = B.files(spark, d)
    return manifest.upsert(prior, now, "path").select("path", "hash")


@query("store_replace_sources", "SELECT doc_id, source FROM documents WHERE source <> 'src3' UNION ALL SELECT -doc_id - 1, source FROM documents WHERE source = 'src3' AND lang = 'en'")
def store_replace_sources(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", "source")
    new = B.table(spark, d, "documents").filter("source = 'src3' and lang = 'en'").select((-F.col("doc_id") - 1).alias("doc_id"), "source")
    return manifest.replace_sources(t, spark.createDataFrame([("src3",)], "source string"), new).select("doc_id", "source")


@query("fixed_split", f"""WITH {B.DOCS}, n AS (SELECT *, length(content) AS n FROM docs),
p AS (SELECT path, content, n, unnest(range(0, CASE WHEN n > 1600 THEN ceil((n - 120) / 1480)::BIGINT + 1 WHEN n > 0 THEN 1 ELSE 0 END)) AS part FROM n)
SELECT path, part::INT AS part, CASE WHEN n <= 1600 THEN content WHEN part = ceil((n - 120) / 1480) THEN substring(content, n - 119, 120) ELSE substring(content, part * 1480 + 1, 1600) END AS content FROM p""")
def fixed_split(spark, d):
    return B.documents(spark, d).select("path", F.posexplode(chunking.windows(F.col("content"))).alias("part", "content"))


_HEAD = B.HEADED + r""",
l AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM headed),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3}\s+(.+)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS sec FROM l),
s AS (SELECT path, sec, min(i) AS start_line, max(i) AS end_line, trim(string_agg(line, chr(10) ORDER BY i), E' \t\n\r') AS content, arg_min(line, i) AS head FROM g GROUP BY ALL)
SELECT path, start_line::INT AS start_line, end_line::INT AS end_line, content, CASE WHEN sec > 0 THEN trim(regexp_extract(head, '^#{1,3}\s+(.+)', 1)) END AS name FROM s WHERE content <> ''"""


@query("heading_split", f"WITH {_HEAD}")
def heading_split(spark, d):
    return chunking.heading_sections(B.headed(B.documents(spark, d))).select("path", "start_line", "end_line", "content", "name")


@query("chunk_files")
def chunk_files(spark, d):
    return chunking.chunks(B.headed(B.documents(spark, d)).select("path", "content"))


@query("snippets", f"WITH {B.DOCS} SELECT path, array_to_string(string_split(content, chr(10))[1:5], chr(10)) AS snippet, ceil(length(content) / 4)::BIGINT AS tokens, substring(string_split(content, chr(10))[1], 1, 160) AS signature FROM docs")
def snippets(spark, d):
    c = F.col("content")
    return B.documents(spark, d).select("path", X.snippet(c).alias("snippet"), X.estimated_tokens(c).alias("tokens"), X.signature(c).alias("signature"))


@query("parse_gate", f"WITH {B.DOCS} SELECT path, strlen(content) <= 524288 AND len(list_filter(string_split(content, chr(10)), lambda x: length(x) > 5000)) = 0 AS parses FROM docs")
def parse_gate(spark, d):
    return B.documents(spark, d).select("path", chunking.parse_gate(F.col("content")).alias("parses"))


@query("size_gate", f"WITH {B.DOCS} SELECT path, strlen(content) AS size FROM docs WHERE strlen(content) <= 512000")
def size_gate(spark, d):
    x = B.documents(spark, d).withColumn("size", F.octet_length("content"))
    return x.filter(S.size_gate(F.col("path"), F.col("size"))).select("path", F.col("size").cast("long").alias("size"))


@query("sniff_text", f"WITH {B.DOCS} SELECT path, doc_id % 7 = 0 AND length(content) > 0 AS binary FROM docs")
def sniff_text(spark, d):
    data = F.encode("content", "UTF-8")
    spoiled = F.when((F.col("doc_id") % 7 == 0) & (F.length("content") > 0), F.concat(F.unhex(F.lit("00")), data)).otherwise(data)
    return B.documents(spark, d).select("path", S.looks_binary(spoiled).alias("binary"))


RULES = ["src1/", "*.md", "!src2/**", "src2/?.md", "!src3/*5.md", "src30"]
_IGNORED = r"""SELECT path, (len(list_intersect(string_split(path, '/'), ['.git', 'node_modules', 'dist', 'build', '.next', 'target', '__pycache__', '.claude'])) > 0
 OR (((((contains(path, 'src1/') OR regexp_matches(name, '^[^/]*\.md$') OR regexp_matches(path, '^[^/]*\.md$'))
   AND NOT (regexp_matches(name, '^src2/.*$') OR regexp_matches(path, '^src2/.*$')))
   OR regexp_matches(name, '^src2/[^/]\.md$') OR regexp_matches(path, '^src2/[^/]\.md$'))
   AND NOT (regexp_matches(name, '^src3/[^/]*5\.md$') OR regexp_matches(path, '^src3/[^/]*5\.md$')))
   OR path = 'src30' OR starts_with(path, 'src30/'))) AS ignored FROM p"""
_PATHS = "CASE WHEN doc_id % 13 = 0 THEN 'a/dist/' || doc_id || '.ts' WHEN doc_id % 13 = 1 THEN 'src/builder' || doc_id || '.ts' ELSE path END"


@query("ignore_rules", f"WITH {B.DOCS}, p AS (SELECT path, string_split(path, '/')[-1] AS name FROM (SELECT {_PATHS} AS path FROM docs)) {_IGNORED}")
def ignore_rules(spark, d):
    return _paths(spark, d).select("path", S.ignored(F.col("path"), RULES).alias("ignored"))


def _paths(spark, d):
    return B.documents(spark, d).select(F.expr(_PATHS).alias("path"))


def _walk_sql() -> str:
    return " OR ".join(f"starts_with(path, '{p}') OR contains(path, '/{p[:-1]}')" for p in S.WALK_IGNORED)


@query("walk_ignored", f"WITH {B.DOCS}, p AS (SELECT {_PATHS} AS path FROM docs) SELECT path, {_walk_sql()} AS ignored FROM p")
def walk_ignored(spark, d):
    return _paths(spark, d).select("path", S.walk_ignored(F.col("path")).alias("ignored"))


_KINDS = "CASE WHEN doc_id % 11 = 0 THEN module || '/tests/f' || doc_id || '.py' WHEN doc_id % 11 = 1 THEN module || '/f' || doc_id || '.spec.go' WHEN doc_id % 11 = 2 THEN 'latest/f' || doc_id || '.PDF' WHEN doc_id % 11 = 3 THEN 'f' || doc_id || '_test.rs' WHEN doc_id % 11 = 4 THEN module || '/.hidden' ELSE path END"


@query("path_functions", f"""WITH {B.DOCS}, p AS (SELECT {_KINDS} AS path FROM docs), q AS (SELECT path, string_split(path, '/')[-1] AS base, string_split(path, '/')[:-2] AS dirs FROM p)
SELECT path, base, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS module,
CASE regexp_extract(base, '^.+(\\.[^.]*)$', 1) WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' END AS language,
len(list_intersect(dirs, ['test', 'tests', '__tests__', 'spec', 'specs'])) > 0 OR regexp_matches(base, '\\.test\\.|\\.spec\\.|_test\\.|_spec\\.') AS test,
lower(regexp_extract(base, '^.+(\\.[^.]*)$', 1)) IN ('.pdf', '.docx', '.xlsx') AS document FROM q""")
def path_functions(spark, d):
    p = F.col("path")
    paths = B.documents(spark, d).select(F.expr(_KINDS).alias("path"))
    return paths.select("path", X.basename(p).alias("base"), X.extension(p).alias("ext"), X.module_of(p).alias("module"), X.language_of(p).alias("language"), X.is_test_path(p).alias("test"), X.is_document(p).alias("document"))


@query("kind_coercion", f"SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'unknown' END AS kind FROM part")
def kind_coercion(spark, d):
    raw = F.expr("CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN p_type END")
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.known_kind(raw).alias("kind"))


_DIFF = B.FILES + """,
diff AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'new' WHEN c.mtime = p.mtime THEN 'unchanged' WHEN c.hash = p.hash THEN 'touched' ELSE 'changed' END AS action
  FROM cur c FULL JOIN prior p ON c.path = p.path)"""


@query("manifest_diff", f"WITH {_DIFF} SELECT path, action FROM diff")
def manifest_diff(spark, d):
    prior, now = B.files(spark, d)
    return manifest.diff_files(now, prior).select("path", "action")


@query("manifest_incremental", f"WITH {_DIFF} SELECT path, action FROM diff WHERE action <> 'deleted'")
def manifest_incremental(spark, d):
    prior, now = B.files(spark, d)
    return manifest.diff_files(now, prior, full_walk=False).select("path", "action")


@query("run_counters", f"WITH {_DIFF} SELECT count(*) FILTER (action <> 'deleted') AS scanned, count(*) FILTER (action IN ('new', 'changed')) AS ingested, count(*) FILTER (action IN ('touched', 'unchanged')) AS skipped, count(*) FILTER (action = 'deleted') AS deleted FROM diff")
def run_counters(spark, d):
    prior, now = B.files(spark, d)
    return manifest.run_counters(manifest.diff_files(now, prior))


@query("deletion_sweep", f"WITH {B.FILES} SELECT path FROM prior WHERE path NOT IN (SELECT path FROM cur)")
def deletion_sweep(spark, d):
    return manifest.deleted_paths(*B.files(spark, d))


@query("orphan_sweep", f"WITH {B.FILES}, gf AS (SELECT path FROM prior UNION SELECT 'old/' || path FROM cur WHERE path LIKE 'new/%') SELECT path FROM gf WHERE path NOT IN (SELECT path FROM cur) AND path NOT IN (SELECT path FROM prior)")
def orphan_sweep(spark, d):
    prior, now = B.files(spark, d)
    old = now.filter(F.col("path").startswith("new/")).select(F.concat(F.lit("old/"), "path").alias("path"))
    return manifest.orphan_paths(prior.select("path").unionByName(old), now, prior)


@query("staleness", f"WITH {B.FILES} SELECT count(*) FILTER (c.hash IS DISTINCT FROM p.hash) AS stale, count(*) FILTER (c.hash = p.hash) AS current, count(*) AS total FROM cur c LEFT JOIN prior p USING (path)")
def staleness(spark, d):
    prior, now = B.files(spark, d)
    return manifest.staleness(now, prior)


def _pieces(df):
    return df.select("path", F.posexplode(chunking.windows(F.col("content"))).alias("part", "content")).select(
        "path", X.chunk_id(F.col("path"), F.lit(0), F.col("part")).alias("id"), F.sha2("content", 256).alias("content_hash")
    )


_SPLIT = """(SELECT path, content, n, unnest(range(0, CASE WHEN n > 1600 THEN ceil((n - 120) / 1480)::BIGINT + 1 WHEN n > 0 THEN 1 ELSE 0 END)) AS part FROM (SELECT path, content, length(content) AS n FROM {t}))"""
_PIECE = "SELECT path, sha256(path) || '-0-' || part AS id, sha256(CASE WHEN n <= 1600 THEN content WHEN part = ceil((n - 120) / 1480) THEN substring(content, n - 119, 120) ELSE substring(content, part * 1480 + 1, 1600) END) AS h FROM "


@query("chunk_reuse", f"WITH {B.FILES}, o AS ({_PIECE}{_SPLIT.format(t='prior')}), n AS ({_PIECE}{_SPLIT.format(t='cur')}) SELECT n.path, n.id, CASE WHEN o.h = n.h THEN 'reuse' ELSE 'embed' END AS action FROM n LEFT JOIN o ON o.path = n.path AND o.id = n.id")
def chunk_reuse(spark, d):
    prior, now = B.files(spark, d)
    old = _pieces(prior)
    stored = old.select("id", F.array(F.lit(0.0)).alias("vector"))
    return manifest.reuse_chunks(_pieces(now), old.select("path", F.col("id").alias("chunk_id"), "content_hash"), stored).select("path", "id", "action")


@query("partial_failure", f"WITH {B.FILES}, n AS ({_PIECE}{_SPLIT.format(t='cur')}), v AS (SELECT path, count(*) AS chunks, count(*) FILTER (h[1] NOT IN ('0', '1', '2')) AS embedded FROM n GROUP BY path) SELECT *, CASE WHEN embedded = chunks THEN 'store' WHEN embedded > 0 THEN 'retry' ELSE 'skip' END AS action FROM v")
def partial_failure(spark, d):
    _, now = B.files(spark, d)
    failed = F.substring("content_hash", 1, 1).isin("0", "1", "2")
    return manifest.settle(_pieces(now).withColumn("vector", F.when(~failed, F.array(F.lit(0.0)))))


@query(
    "debounce_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new, event_type, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM e)
SELECT user_id, min(ts) AS started, count(*) AS changes, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, sess""",
)
def debounce_sessions(spark, d):
    e = B.table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("path"))
    return watch.debounce(e, "60 minutes", "user_id").select("user_id", F.col("start").alias("started"), "changes", F.size("paths").cast("long").alias("paths"))


@query("wave_split", "SELECT wave, count(*) AS files FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 200 AS wave FROM events) GROUP BY wave")
def wave_split(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id").alias("path"))
    return watch.waves(e, 200).groupBy("wave").agg(F.count("*").alias("files"))


_CODE = {
    0: (".py", "'def f' || doc_id || '(x):\n    return g' || (doc_id % 7) || '(x)\n'"),
    1: (".ts", "'export async function f' || doc_id || '(x: number) {\n  return g' || (doc_id % 7) || '(x);\n}\n'"),
    2: (".go", "'package p\n\nfunc f' || doc_id || '(x int) int {\n\treturn g' || (doc_id % 7) || '(x)\n}\n'"),
    3: (".java", "'class K { int f' || doc_id || '(int x) { return g' || (doc_id % 7) || '(x); } }\n'"),
}


@query("symbols_and_calls", """WITH s AS (SELECT 'm/' || doc_id || ['.py', '.ts', '.go', '.java'][doc_id % 4 + 1] AS path, 'f' || doc_id AS name, CASE WHEN doc_id % 4 = 3 THEN 'method' ELSE 'function' END AS kind,
  [1, 1, 3, 1][doc_id % 4 + 1]::INT AS start_line, [2, 3, 5, 1][doc_id % 4 + 1]::INT AS end_line, 'g' || (doc_id % 7) AS calls FROM documents)
SELECT * FROM s UNION ALL SELECT 'm/' || doc_id || '.java', 'K', 'class', 1, 1, '' FROM documents WHERE doc_id % 4 = 3""")
def symbols_and_calls(spark, d):
    k = F.col("doc_id") % 4
    pick = lambda i: F.coalesce(*(F.when(k == n, F.expr(v[1].replace("\n", "\\n").replace("\t", "\\t")) if i else F.lit(v[0])) for n, v in _CODE.items()))
    files = B.documents(spark, d).select(F.concat(F.lit("m/"), "doc_id", pick(0)).alias("path"), pick(1).alias("content"))
    found = chunking.symbols_and_calls(files)
    return found.select("path", "name", "kind", "start_line", "end_line", F.array_join(F.transform("edges", lambda e: e["dst_name"]), ",").alias("calls"))


@query("page_prose", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_prose(spark, d):
    strip = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return B.table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(strip, r"\s+", " ")).alias("text"))


@query(
    "folder_changes",
    f"""WITH {B.FILES}, a AS (SELECT path, length(content) AS size, mtime FROM cur), b AS (SELECT path, length(content) AS size, mtime FROM prior)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'add' WHEN a.path IS NULL THEN 'unlink' ELSE 'change' END AS event
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size OR a.mtime IS DISTINCT FROM b.mtime""",
)
def folder_changes(spark, d):
    """What a watched folder hands on between two listings of its files."""
    prior, now = B.files(spark, d)
    listed = lambda df: df.select("path", F.length("content").cast("long").alias("size"), "mtime")
    return folder.moved(listed(now), listed(prior))
