"""HTML extraction with a suffix array per host (operator 8).

A page is read as a stream of blocks. Block structure tells four kinds: *main* (in an article or main element), *named* (menus, headers of the site,
footers, sidebars, notices, adverts, forms, reader comments, by element or by whole words of class, id or role), *maybe* (a paragraph or the like inside an
article whose class is a word that only may name furniture) and *free* (in no article and not named, whether or not the page has an article). An article below a wrapper that is named (a form
around the page, say) is still the text if no other article stands outside; one in a real menu, sidebar or footer is not.

What structure does not decide, the host decides, by comparing its pages with each other; pages of equal content count as one:

* Long substrings. The token streams of all blocks of a host but main ones are one sequence with separators between blocks. A suffix array (suffixes sorted by prefix
  doubling over token ranks) puts suffixes that share their first ``LEAST`` tokens side by side; where such neighbours come from distinct pages, all
  tokens of the shared prefix are covered. The union of these places is that of all repeats of at least that length. Free and maybe blocks lose
  covered tokens and keep their unique runs.
* Whole blocks. A free or maybe block, however short, goes if it stands on three distinct pages and a tenth of the host's. A main block
  always stays, whoever shares it: passages that pages of a host share are their text.

A host of any size is spread over all tasks: each Arrow batch sorts its own suffixes, one row leaves it for each run of equal prefixes and host (its
first and last page), and a grouped minimum and maximum merges the runs. No task holds a host.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; unclosed, stray and implied tags are borne, and a tag
or comment that never ends takes the rest of the page; a text of any length is read in time in proportion to it, elements nested deeper than ``DEEPEST`` count as text of the
one above; repeated rows are pages of their own with equal content, so they are never furniture to each other; order and ties of rows do not matter; an empty table stays empty;
columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import bounded, stage

#: Tokens from which on a repeated substring is long.
LEAST = 10
#: (distinct pages, share of the host's) from which on a whole block that is undecided is furniture.
OUTSIDE = (3, 0.1)
DEEPEST = 512
#: Hosts with furniture blocks up to which these are broadcast.
MOST_HOSTS = 20_000
MAIN, NAMED_, MAYBE, FREE = range(4)
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NONE = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v ]+")
#: Elements by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "noframes", "xmp", "head"}
SWALLOW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
FOREIGN = {"svg", "math"}
NAMED = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header", "noscript", "label", "input"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements whose start ends an open paragraph; elements that end one of their own kind, up to a container.
BLOCKS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: Elements that hold text, and words which on such an element in an article only may name furniture.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "table", "dl"}
WEAK = set("notice search share sharing social related recommended menu form banner widget footer sidebar toolbar skip popup modal sponsor promotion navigation consent login subscription".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words that name furniture as a class, id or role, and parts that may stand beside them in one such token.
FURNITURE = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer siteheader masthead banner sidebar widget ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice popup modal newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist disqus replies reply respond pagination pager toolbar skip"
    " complementary contentinfo form".split()
)
BESIDE = set(
    "site page main top bottom left right primary secondary global mobile desktop post posts article articles entry content body text inner outer wrap wrapper container box block area section region panel column col"
    " row bar list item items link links button buttons icon icons group slot unit header title meta author wp div sub the js user thread field input submit to side media stories".split()
)


@functools.lru_cache(1 << 16)
def is_furniture(marks: str) -> bool:
    """Whether a whole class, id or role names furniture: ``site-footer`` does, ``has-sidebar`` and ``search-results`` do not."""
    for token in marks.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
        whole = "site-header" in token or "side-bar" in token
        if (whole or any(p in FURNITURE for p in parts)) and all(p in FURNITURE or p in BESIDE for p in parts):
            return True
    return False


@functools.lru_cache(1 << 16)
def may_be_text(marks: str) -> bool:
    """Whether the words of a class that names furniture are all weak ones."""
    parts = {p for token in marks.lower().split() for p in re.split(r"[-_]+", token)}
    return not (parts & FURNITURE) - WEAK


class Page:
    """The blocks of one page: (text, kind), kind being main, named, maybe or free."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.has_main = False
        self._source, self._gone = source, set()
        self._parts: list[str] = []
        self._stack: list[tuple[str, str]] = [("", "free")]
        self._deeper = 0
        at = 0
        while (low := source.find("<", at)) >= 0:
            after = source[low + 1 : low + 3]
            closing = after[:1] == "/"
            if after[:1] in ("!", "?"):
                self._parts.append(source[at:low])
                comment, data = source.startswith("<!--", low), source.startswith("<![CDATA[", low)
                at = self._behind("-->" if comment else "]]>" if data else ">", low + (4 if comment else 2))
                continue
            first = after[closing : closing + 1]
            if not (first.isascii() and first.isalpha()):
                self._parts.append(source[at : low + 1])
                at = low + 1
                continue
            self._parts.append(source[at:low])
            at = self._tag_end(low + 1)
            name = NAME.match(source, low).group(1).lower()
            if at < 0:  # a tag that never ends
                at = len(source)
                break
            if name not in INLINE:
                self._flush()
            if closing:
                self._close(name)
                continue
            text = source[low:at]
            self._imply(name)
            # A slash before the end of a tag says something in foreign elements only.
            ended = name in FOREIGN and text.endswith("/>")
            if name in RAW and name != "head" and not ended:
                end = self._end_of(name, at)
                if end >= 0 or name in SWALLOW:
                    at = end if end >= 0 else len(source)
            elif name not in VOID and not ended:
                self._open(name, text)
        self._parts.append(source[at:])
        self._flush()
        # Articles below a named wrapper are the text of a page that has no other; beside another they are teasers.
        boxed = not self.has_main and any(k == "boxed" for _, k in self.blocks)
        self.has_main |= boxed
        kinds = {"shut": "named", "boxed": "main" if boxed else "named"}
        self.blocks = [(t, kinds.get(k, k)) for t, k in self.blocks]

    def _behind(self, mark: str, at: int) -> int:
        end = self._source.find(mark, at)
        return len(self._source) if end < 0 else end + len(mark)

    def _tag_end(self, at: int) -> int:
        """The place behind a tag's ``>``, quoted values passed over, or -1. A quote counts behind ``=`` and if it is closed; that one is not is looked up once."""
        source = self._source
        while stop := STOP.search(source, at):
            at, mark = stop.end(), stop.group()
            if mark == ">":
                return at
            if source[max(0, at - 9) : at - 1].rstrip(" \t\n\r\f").endswith("=") and mark not in self._gone:
                end = source.find(mark, at)
                if end < 0:
                    self._gone.add(mark)
                else:
                    at = end + 1
        return -1

    def _end_of(self, name: str, at: int) -> int:
        """The place behind the next end tag of an element whose content is no text, or -1."""
        if name in self._gone:
            return -1
        if end := _end_tag(name).search(self._source, at):
            close = self._source.find(">", end.end())
            return len(self._source) if close < 0 else close + 1
        self._gone.add(name)
        return -1

    def _imply(self, name: str) -> None:
        """Ends that may be left out: of the head, of a paragraph before a block, of an item before its like."""
        if name not in IN_HEAD:
            for k, (other, _) in enumerate(self._stack[1:4], 1):
                if other == "head":
                    del self._stack[k:]
                    break
        like, stops = SIBLINGS.get(name, ({"p"} if name in BLOCKS else set(), {"button", "table", *BLOCKS} - {"p"}))
        for k in range(len(self._stack) - 1, 0, -1) if like else ():
            if self._stack[k][0] in like:
                del self._stack[k:]
                if name != "tr":
                    break
            elif self._stack[k][0] in stops:
                break

    def _open(self, name: str, text: str) -> None:
        """Kinds on the stack are those of blocks and: shut, which nothing below leaves; boxed, an article below a wrapper that is named."""
        above = kind = self._stack[-1][1]
        marks, role, hidden = "", "", False
        if "=" in text or "hidden" in text.lower():
            for key, value in ATTRIBUTE.findall(text, len(name) + 1):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    marks += f" {value}"
                    role = value.lower() if key == "role" else role
                hidden |= key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NONE.search(value) is not None
        inside = above in ("main", "boxed", "maybe")
        if above != "shut":
            if name in ("article", "main") or (name == "div" and "main" in role.split()):
                kind = "shut" if is_furniture(marks) else "boxed" if above in ("named", "boxed") else "main"
                self.has_main |= kind == "main"
            elif name == "head" or (name in NAMED - {"form"} and not (name == "header" and inside)):
                kind = "shut"
            elif name not in ("body", "html"):
                if hidden:
                    kind = "shut"
                elif name == "form" or is_furniture(marks):
                    kind = "maybe" if above in ("main", "maybe") and name in TEXTUAL and may_be_text(marks) else "shut" if inside else "named"
        if len(self._stack) >= DEEPEST:
            self._deeper += 1
        else:
            self._stack.append((name, kind))

    def _close(self, name: str) -> None:
        if self._deeper:
            self._deeper -= 1
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == name:
                del self._stack[k:]
                return
            # A stray end of an inline or paragraph element closes no section.
            if self._stack[k][0] in ("article", "main", "nav", "footer", "aside", "form", "header", "section", "body", "html") and name in INLINE | {"p", "li"}:
                return

    def _flush(self) -> None:
        if self._parts:
            text = SPACE.sub(" ", entities.unescape("".join(self._parts))).strip(" ")
            self._parts = []
            if text:
                self.blocks.append((text, self._stack[-1][1]))


@functools.cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = {"main": MAIN, "named": NAMED_, "maybe": MAYBE, "free": FREE}
    for batch in batches:
        hosts, prints, texts, kinds, undecided = [], [], [], [], []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source or "")
            hosts.append(host_of(url))
            texts.append([t for t, _ in page.blocks])
            kinds.append(bytes(kind[k] for _, k in page.blocks))
            undecided.append(any(k in (MAYBE, FREE) for k in kinds[-1]))
            prints.append(xxhash.xxh64_intdigest(source or "") >> 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(prints, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.binary()), pa.array(undecided, pa.bool_())],
            names=["page_id", "url", "host", "content", "texts", "kinds", "undecided"],
        )


def suffix_array(ranks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the suffixes of ``ranks`` sorted by their first ``depth`` entries, by prefix doubling, and whether each has these in common with the one before.

    A round ranks pairs of ranks, so it doubles the length that ranks tell apart; the last one lets the two halves overlap. Beyond the end stands -1.
    """
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    now, length = np.unique(ranks, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(now, kind="stable")
    while length < depth:
        step = min(length, depth - length)
        then = np.full(n, -1, np.int64)
        then[: max(0, n - step)] = now[step:]
        order = np.lexsort((then, now))
        a, b = now[order], then[order]
        new = np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        now = np.empty(n, np.int64)
        now[order] = np.cumsum(new)
        length += step
    return order, np.concatenate(([False], now[order][1:] == now[order][:-1]))


def streams(texts: list[list[str]], kinds: list[bytes], wanted: set[int]) -> tuple[np.ndarray, ...]:
    """The tokens of all wanted blocks of some pages: page, number of the token in the page's wanted blocks, tokens left in the block, and a 64-bit hash."""
    page, number, left, h = [], [], [], []
    for k, (blocks, kind) in enumerate(zip(texts, kinds)):
        at = 0
        for block, c in zip(blocks, kind):
            if c in wanted:
                tokens = block.split(" ")
                n = len(tokens)
                page += [k] * n
                number += range(at, at + n)
                left += range(n, 0, -1)
                h += [xxhash.xxh64_intdigest(t) for t in tokens]
                at += n
    return np.array(page, np.int64), np.array(number, np.int64), np.array(left, np.int64), np.array(h, np.uint64)


def prefixes(h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of suffixes that have ``LEAST`` tokens in their block, and a 64-bit hash of these tokens, the same in every task."""
    at = np.flatnonzero(left >= LEAST)
    key = np.zeros(len(at), np.uint64)
    for k in range(LEAST):
        key = (key ^ (h[at + k] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return at, key.view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of suffixes of one host with a common prefix: host, prefix, and the first and last page in it."""
    for batch in batches:
        hosts, contents = batch.column("host").to_pylist(), batch.column("content").to_numpy()
        page, _, left, h = streams(batch.column("texts").to_pylist(), batch.column("kinds").to_pylist(), {NAMED_, MAYBE, FREE})
        at, key = prefixes(h, left)
        names, host = np.unique(np.array(hosts, dtype=object).astype(str), return_inverse=True)
        order, same = suffix_array(h, LEAST)
        place = np.full(len(h), -1, np.int64)
        place[at] = np.arange(len(at))
        inside = place[order] >= 0
        # Suffixes that end in another block stand among their like; taking them out leaves the others' runs as they are.
        run = np.cumsum(~same)[inside]
        order = order[inside]
        own, text = host[page[order]], contents[page[order]]
        group = np.lexsort((text, own, run))
        run, own, text, order = run[group], own[group], text[group], order[group]
        first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])))) if len(run) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(run)) - 1 if len(first) else first
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[own[first]], pa.string()), pa.array(key[place[order[first]]], pa.int64()), pa.array(text[first], pa.int64()), pa.array(text[last], pa.int64())],
            names=["host", "prefix", "a", "b"],
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the suffixes of undecided blocks stand."""
    for batch in batches:
        rids, hosts = batch.column("rid").to_numpy(), np.array(batch.column("host").to_pylist(), dtype=object)
        page, number, left, h = streams(batch.column("texts").to_pylist(), batch.column("kinds").to_pylist(), {MAYBE, FREE})
        at, key = prefixes(h, left)
        yield pa.RecordBatch.from_arrays([pa.array(rids[page[at]]), pa.array(hosts[page[at]], pa.string()), pa.array(key), pa.array(number[at])], names=["rid", "host", "prefix", "at"])


def _block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct block of a page that may be furniture as a whole."""
    for batch in batches:
        hosts, contents = batch.column("host").to_pylist(), batch.column("content").to_pylist()
        out = []
        for host, content, blocks, kinds in zip(hosts, contents, batch.column("texts").to_pylist(), batch.column("kinds").to_pylist()):
            out += [(host, content, b) for b in {block_hash(t) for t, k in zip(blocks, kinds) if k in (MAYBE, FREE)}]
        kinds_ = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds_)], names=["host", "content", "block"])


def block_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def kept_text(blocks: list[str], kinds: bytes, starts: list[int] | None, whole: list[int] | None) -> str:
    """The blocks that stay, without the tokens that the repeats at ``starts`` cover, joined."""
    common, gone = set(whole or ()), {i + k for i in starts or () for k in range(LEAST)}
    kept, n = [], 0
    for block, kind in zip(blocks, kinds):
        if kind == NAMED_:
            continue
        if kind == MAIN:
            kept.append(block)
            continue
        tokens = block.split(" ")
        if not common or block_hash(block) not in common:
            run = [t for i, t in enumerate(tokens, n) if i not in gone]
            if run:
                kept.append(" ".join(run))
        n += len(tokens)
    return " ".join(kept)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("texts", "kinds", "covered", "whole"))
        out = [kept_text(*row) for row in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def host_furniture(rows: DataFrame) -> DataFrame:
    """(host, whole): the hashes of undecided blocks that are furniture as a whole. Few to a host: each stands on a tenth of its pages."""
    pages = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("_n"))
    blocks = rows.select("host", "content", "texts", "kinds").mapInArrow(bounded(_block_hashes, 500), "host string, content long, block long").distinct()
    often = blocks.groupBy("host", "block").agg(F.count("*").alias("_k")).filter(F.col("_k") >= OUTSIDE[0])
    return often.join(pages, "host").filter(F.col("_k") >= OUTSIDE[1] * F.col("_n")).groupBy("host").agg(F.collect_set("block").alias("whole"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        bounded(_read, 500), "page_id long, url string, host string, content long, texts array<string>, kinds binary, undecided boolean"
    )
    rows = stage(read.withColumn("rid", F.monotonically_increasing_id()), "pages")
    suffixes = rows.select("host", "content", "texts", "kinds").mapInArrow(bounded(_suffixes, 5000, 16 << 20), "host string, prefix long, a long, b long")
    repeated = suffixes.groupBy("host", "prefix").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("host", "prefix")
    places = rows.filter("undecided").select("rid", "host", "texts", "kinds").mapInArrow(bounded(_places, 500), "rid long, host string, prefix long, at long")
    covered = stage(places.join(repeated, ["host", "prefix"], "left_semi").groupBy(F.col("rid").alias("_rid")).agg(F.collect_list("at").alias("covered")), "covered")
    whole = stage(host_furniture(rows).withColumnRenamed("host", "_host"), "furniture")

    def cut(some: DataFrame) -> DataFrame:
        if whole.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS:
            both = some.join(F.broadcast(whole), F.col("host") == F.col("_host"), "left")
        else:  # a hot host's pages meet its few blocks in many tasks
            salted = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
            both = some.join(salted, (F.col("host") == F.col("_host")) & (F.pmod("rid", F.lit(64)) == F.col("_salt")), "left")
        return both.select("page_id", "url", "texts", "kinds", "covered", "whole").mapInArrow(bounded(_kept, 500), "page_id long, url string, text string")

    if covered.isEmpty():
        return cut(rows.withColumn("covered", F.lit(None).cast("array<long>")))
    decided = rows.filter("not undecided").withColumn("covered", F.lit(None).cast("array<long>"))
    return cut(decided).unionByName(cut(rows.filter("undecided").join(covered, F.col("rid") == F.col("_rid"), "left").drop("_rid")))


def op8_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
