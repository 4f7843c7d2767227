"""URL filters: pattern rules indexed by their rarest literal token (operator 12).

A rule is a pattern over a url's address, that is host, path and rest (query and fragment), the host in lower case. A pattern is literal text with

* ``||`` at its beginning: the rest begins at the host or at one of the host's labels; ``|`` there: it begins at the host;
* ``|`` at its end: the address ends there;
* ``*``: any run of characters; ``^``: one character that is no ASCII letter, digit, ``-``, ``_``, ``.`` or ``%``, or the end of the address.

A pattern is matched without regard to the case of ASCII letters unless ``exact`` holds, and means one regular expression. An expression is run only where it may fit: a maximal run of ASCII
letters and digits in a pattern that can neither grow to the left nor to the right in a url is a token every fitting url must have. Of its tokens each rule is
indexed by the one that fewest of all urls have; the distinct tokens of a url fetch their rules in one equality join, and the fetched expressions decide.
Rules without such a token stand under the empty token, which every url has.

Of base rules (host and path, for the host and all its subdomains) the longest that fits decides. Else pattern rules do: a url is blocked if a rule that blocks fits and none that allows. Else it is allowed.

Urls are spread over tasks however few distinct tokens they have: both join sides carry a salt of ``SALTS`` values, over which rules are repeated; where rules are
few the engine sends them to the urls instead. A url's rules meet in partial aggregates, so no task holds more of a url than its own tokens.

Defined cases: a null url, one without ``://`` and an empty one have an empty host and path and fit no rule (verdict allow); ``://`` counts where it stands first; user names and ports belong to the host
as given; a path begins with its slash or is empty; of equally long base rules that fit, one that blocks wins, then the greater text; rules that repeat count once; null, empty and unknown
patterns are dropped; urls of any length are matched whole; rows that repeat stay rows of their own; an empty table stays empty; columns besides page_id and url are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import stage

SALTS = 16
RULE = "verdict string, host string, path string, pattern string, exact boolean"
#: The base rules as (verdict, host, path).
BASE = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pattern rules for pages that hold no running text or none of their own: (verdict, pattern).
PATTERNS = [
    *(("block", f"/{word}^") for word in "login logout signin signup register account cart checkout basket wishlist admin cgi-bin wp-admin wp-login search feed rss print embed share captcha unsubscribe".split()),
    *(("block", f".{end}|") for end in "jpg jpeg png gif svg webp ico css js json xml zip gz exe pdf mp3 mp4 avi woff".split()),
    *(("block", f"^{key}=") for key in "sessionid phpsessid jsessionid sid replytocom add-to-cart".split()),
    *(("block", f"||{host}^") for host in "doubleclick.net ads.example.com tracker.example.net pixel.example.org".split()),
    ("block", "/tag/*/page/"),
    ("block", "/calendar/*/19"),
    ("block", "/sitemap*.xml|"),
    ("block", "?utm_source=feed&*&utm_campaign="),
    ("block", "/404.html|"),
    ("allow", "/docs/*/search^"),
    ("allow", "||feed.example.net^"),
    ("allow", "/account/help^"),
    ("allow", "/data/*.json|"),
]


def lowered(c: Column) -> Column:
    """ASCII letters in lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path, and what stands behind it."""
    at = F.instr(url, "://")
    behind = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(behind, r"^[^/?#]*", 0)
    tail = behind.substr(F.length(host) + 1, F.length(behind))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return lowered(host), path, tail.substr(F.length(path) + 1, F.length(tail))


def rule_table(spark: SparkSession, base: list | None = None, patterns: list | None = None) -> DataFrame:
    """The rules of this module, or others, as a table."""
    rows = [{"verdict": v, "host": h, "path": p} for v, h, p in (BASE if base is None else base)]
    rows += [{"verdict": v, "pattern": p} for v, p in (PATTERNS if patterns is None else patterns)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{RULE}>>")))


def compiled(rules: DataFrame) -> DataFrame:
    """Distinct rules as base (host and path, null for patterns), verdict, exact, regex and tokens, in which a rule without any has the empty one."""
    base, path = F.col("host").isNotNull(), F.coalesce("path", F.lit(""))
    host = lowered(F.col("host"))
    exact = base | F.coalesce("exact", F.lit(False))
    body = F.when(base, host).when(exact, F.col("pattern")).otherwise(lowered(F.col("pattern")))
    known = rules.select(F.when(base, F.concat(host, path)).alias("base"), "verdict", exact.alias("exact"), body.alias("body"), path.alias("path"))
    known = known.filter((F.col("body") != "") & F.col("verdict").isin("allow", "block")).distinct()
    is_base = F.col("base").isNotNull()
    front = F.when(is_base, F.lit("||")).otherwise(F.regexp_extract("body", r"^\|{0,2}", 0))
    end = F.when(is_base, F.lit("")).otherwise(F.regexp_extract("body", r"(?<!^)\|?$", 0))
    inner = F.when(is_base, F.col("body")).otherwise(F.expr("substring(body, length(front) + 1, length(body) - length(front) - length(end))"))
    cut = known.withColumn("front", front).withColumn("end", end).withColumn("inner", inner)
    # Literals are quoted character by character; in a base rule * and ^ are characters like others, and its host ends where the path begins.
    quoted = _quoted(F.col("inner"))
    wild = F.regexp_replace(F.regexp_replace(quoted, r"\\\*", "(?s:.*)"), r"\\\^", r"(?:[^A-Za-z0-9_.%\\-]|\\z)")
    begins = F.when(F.col("front") == "||", F.lit(r"^(?:[^/?#]*\.)?")).when(F.col("front") == "|", F.lit("^")).otherwise(F.lit(""))
    closed = F.when(F.col("end") == "|", F.lit(r"\z")).otherwise(F.lit(""))
    regex = F.when(is_base, F.concat(begins, quoted, F.lit(r"(?=[/?#]|\z)"), _quoted(F.col("path")))).otherwise(F.concat(begins, wild, closed))
    # Tokens that cannot grow have neighbours that are no letter, digit or star; an open border of the pattern counts as a star.
    plain = F.concat(F.lit("|"), F.translate("inner", "*", "|"), F.lit("|"), F.translate("path", "*", "|"), F.lit("*"))
    free = F.concat(F.when(F.col("front") == "", "*").otherwise("|"), F.col("inner"), F.when(F.col("end") == "", "*").otherwise("|"))
    tokens = F.array_distinct(F.regexp_extract_all(lowered(F.when(is_base, plain).otherwise(free)), F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)))
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("")))
    return cut.select("base", "verdict", "exact", regex.alias("regex"), tokens.alias("tokens"))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()+?$|^*#&~\-])", r"\\$1")


def url_tokens(address: Column) -> Column:
    """The distinct tokens of an address, and the empty one."""
    return F.array_append(F.array_distinct(F.regexp_extract_all(lowered(address), F.lit("[a-z0-9]+"), F.lit(0))), F.lit(""))


def indexed(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """Rules with the token under which they stand: of their own the one that fewest rows of ``addresses`` have, then the longest, then the least."""
    ready = compiled(rules)
    wanted = ready.select(F.explode("tokens").alias("token")).filter("token <> ''").distinct()
    # Only tokens that stand in some rule are counted; counts are summed in each task before they move.
    seen = addresses.select(F.explode(url_tokens(F.col("address"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = ready.withColumn("rule", F.struct("base", "verdict", "exact", "regex")).select("rule", F.explode("tokens").alias("token"))
    rank = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), F.col("token"))
    return each.join(seen, "token", "left").groupBy("rule").agg(F.min_by("token", rank).alias("token")).select("token", "rule.*")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule (the base rule that decided, else null), n_patterns (pattern rules that fit), n_tried (expressions run) and verdict of every row."""
    host, path, rest = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumn("address", F.concat("host", "path", "rest"))
    index = stage(indexed(rules, rows.select("address")), "rules")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    each = each.withColumn("token", F.explode(url_tokens(F.col("address"))))
    tried = each.join(salted, ["token", "salt"], "left")
    # A url that is not one fits nothing.
    fits = (F.col("address") != "") & F.rlike(F.when(F.col("exact"), F.col("address")).otherwise(lowered(F.col("address"))), F.col("regex"))
    is_base = F.col("base").isNotNull()
    marked = tried.withColumn("fits", F.coalesce(fits, F.lit(False)))
    first = F.when(F.col("fits") & is_base, F.struct(F.length("base"), F.col("verdict") == "block", F.col("base").alias("base"), F.col("verdict").alias("verdict")))
    pattern = F.col("fits") & ~is_base
    found = marked.groupBy("row", "page_id", "url", "host", "path").agg(
        F.max(first).alias("first"),
        F.coalesce(F.bool_or(pattern & (F.col("verdict") == "block")), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(pattern & (F.col("verdict") == "allow")), F.lit(False)).alias("allowed"),
        F.count_if(pattern).alias("n_patterns"),
        F.count("regex").alias("n_tried"),
    )
    own = F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "url", "host", "path", F.col("first.base").alias("rule"), "n_patterns", "n_tried", F.coalesce(F.col("first.verdict"), own).alias("verdict"))


def expression(pattern: str) -> str:
    """The regular expression a pattern stands for, in the words of the docstring; used by tests and by the SQL below."""
    pattern = pattern.translate({c: c + 32 for c in range(65, 91)})
    front = re.match(r"\|{0,2}", pattern).group()
    body = pattern[len(front) :]
    end = "|" if body.endswith("|") else ""
    body = body[: len(body) - len(end)]
    inner = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    return {"": "", "|": "^", "||": r"^(?:[^/?#]*\.)?"}[front] + inner + ("$" if end else "")


def op12_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "n_patterns", "verdict")


def _sql() -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    base = ", ".join(f"({text(v)}, {text(h)}, {text(p)})" for v, h, p in BASE)
    patterns = ", ".join(f"({text(v)}, {text(expression(p))})" for v, p in PATTERNS)
    return f"""
WITH base(verdict, host, path) AS (VALUES {base}), patterns(verdict, regex) AS (VALUES {patterns}),
u AS (
    SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS behind FROM pages
), split AS (
    SELECT r, page_id, regexp_extract(behind, '^[^/?#]*') AS h, substr(behind, length(regexp_extract(behind, '^[^/?#]*')) + 1) AS tail FROM u
), parts AS (
    SELECT r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path,
        translate(h || tail, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS address FROM split
), longest AS (
    SELECT p.r, arg_max(b.host || b.path, length(b.host || b.path)) AS rule, arg_max(b.verdict, length(b.host || b.path)) AS verdict
    FROM parts p JOIN base b ON (p.host = b.host OR ends_with(p.host, '.' || b.host)) AND starts_with(p.path, b.path) GROUP BY p.r
), own AS (
    SELECT p.r, count(*) AS n_patterns, bool_or(q.verdict = 'block') AND NOT bool_or(q.verdict = 'allow') AS blocked
    FROM parts p JOIN patterns q ON p.address <> '' AND regexp_matches(p.address, q.regex, 's') GROUP BY p.r
)
SELECT page_id, host, path, rule, coalesce(n_patterns, 0) AS n_patterns, coalesce(longest.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN longest USING (r) LEFT JOIN own USING (r)
"""


OP12_SQL = _sql()
