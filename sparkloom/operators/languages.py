"""Declarations and calls in source text of many languages, from a few facts of each language's public grammar and one scanner for all.

Comments and the insides of strings are blanked out first, so braces and words in them do not count. A declaration is a keyword with a name behind it,
or, where functions are told by a return type (``typed``), a name with parentheses and a body. It ends with its braces, with its indentation (Ruby), or with its line.
A call is a name before an opening parenthesis; it belongs to the innermost declaration around it.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass, field

NAME = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    """Words that may stand before a declaring keyword, the keywords with the kind they declare, and how the language is written."""

    modifiers: str = ""
    keywords: dict[str, str] = field(default_factory=dict)
    typed: bool = False
    members: bool = False  # functions without keyword or type, as in a class body of scripts
    assigned: bool = False  # functions bound to a name
    hash_comments: bool = False
    hash_defines: bool = False
    quotes: str = "\"'`"
    indented: bool = False
    calls: bool = True


#: The public grammars' modifiers and declaring keywords, with kinds.
_SCRIPT = Language("export default declare abstract async", {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "class"}, members=True, assigned=True)
_C = Language("static inline extern const", {"struct": "struct", "union": "struct", "enum": "enum", "typedef": "type"}, typed=True, hash_defines=True, quotes="\"'")
_KOTLIN = Language(
    "public private internal protected open abstract final sealed data inline noinline suspend override operator infix tailrec external inner companion annotation value expect actual enum const lateinit",
    {"fun": "function", "class": "class", "interface": "interface", "object": "class", "typealias": "type"}, quotes="\"'",
)
LANGUAGES: dict[str, Language] = {
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "javascript": _SCRIPT,
    "python": Language("async", {"def": "function", "class": "class"}, hash_comments=True, quotes="\"'"),
    "go": Language("", {"func": "function", "type": "type", "var": "variable", "const": "variable"}, quotes="\"'`"),
    "rust": Language("pub async unsafe const extern default", {"fn": "function", "struct": "struct", "enum": "enum", "union": "struct", "trait": "trait", "impl": "impl", "mod": "class", "type": "type", "macro_rules!": "function"}, quotes='"'),
    "java": Language("public protected private static final abstract sealed native synchronized default strictfp", {"class": "class", "interface": "interface", "enum": "enum", "record": "class", "@interface": "interface"}, typed=True, quotes="\"'"),
    "c": _C,
    "cpp": Language("static inline extern const constexpr virtual explicit friend", {"class": "class", "struct": "struct", "union": "struct", "enum": "enum", "namespace": "class", "typedef": "type", "template": "type"}, typed=True, hash_defines=True, quotes="\"'"),
    "c_sharp": Language("public protected private internal static sealed abstract partial readonly async override virtual extern unsafe new", {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "class", "delegate": "type"}, typed=True, quotes="\"'"),
    "ruby": Language("private protected public", {"def": "function", "class": "class", "module": "type"}, hash_comments=True, quotes="\"'", indented=True),
    "php": Language("public protected private static abstract final readonly", {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}, hash_comments=True, quotes="\"'"),
    "swift": Language("public private internal open fileprivate package final static override mutating nonmutating async nonisolated indirect required convenience", {"func": "function", "class": "class", "struct": "struct", "protocol": "interface", "enum": "enum", "extension": "class", "actor": "class", "typealias": "type"}, quotes='"'),
    "kotlin": _KOTLIN,
    "scala": Language("private protected final sealed abstract implicit lazy override case inline", {"def": "function", "class": "class", "object": "class", "trait": "trait", "type": "type"}, quotes='"'),
    "dart": Language("abstract base final interface mixin sealed static external const late", {"class": "class", "enum": "enum", "mixin": "trait", "extension": "class", "typedef": "type"}, typed=True, quotes="\"'", calls=False),
}
#: Words before a parenthesis that call nothing.
CONTROL = set("if else for foreach while do switch case catch return throw try finally with synchronized using lock when match guard until unless elsif elseif in of is as not and or new await yield sizeof typeof super this function fun func fn def static_assert defined loop select go defer where repeat fixed checked del".split())
CLASSES = {"class", "interface", "struct", "trait", "impl", "enum"}
#: Beside these, what may hold methods in a language whose modules count as types.
MODULES = {"type"}


@functools.cache
def _noise(lang: str) -> re.Pattern:
    language = LANGUAGES[lang]
    parts = [r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"] if lang not in ("python", "ruby") else [r"^=begin.*?(?:^=end|\Z)"]
    if language.hash_comments:
        parts.append(r"\#(?!\[)[^\n]*")
    if lang in ("python", "kotlin", "scala", "swift"):
        parts.append(r'"""(?:\\.|[^\\])*?(?:"""|\Z)')
    if lang == "python":
        parts.append(r"'''(?:\\.|[^\\])*?(?:'''|\Z)")
    for q in language.quotes:
        many = q == "`" or lang in ("php", "ruby")
        parts.append(rf"{q}(?:\\.|[^\\{q}{'' if many else chr(92) + 'n'}])*{q}")
    return re.compile("|".join(f"(?:{p})" for p in parts), re.S | re.M)


def blanked(content: str, lang: str) -> str:
    """The text with comments and strings turned into spaces; places and lines stay."""
    return _noise(lang).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content)


@functools.cache
def line_start(lang: str) -> re.Pattern:
    """Lines (without indentation) that begin a declaration: modifiers, then a declaring keyword, a bound function, a typed one, or an attribute or macro before it."""
    language = LANGUAGES[lang]
    modifier = "|".join(language.modifiers.split())
    before = rf"(?:(?:{modifier})(?:\([^)\n]*\))?\s+)*" if modifier else ""
    keyword = "|".join(re.escape(k) for k in language.keywords)
    ways = [rf"{before}(?:{keyword})(?![\w$])"]
    if language.assigned:
        ways.append(rf"{before}(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:\(|function\b|{NAME}\s*=>)")
    if language.typed:
        ways.append(rf"{before}(?!(?:{'|'.join(sorted(CONTROL))})\b)[\w$<>\[\],.?:*&~]+(?:[\s*&]+[\w$<>\[\],.?:*&~]+)*[\s*&]+[\w$:~]+\s*[(<]")
    if lang in ("python", "swift"):
        ways.append(r"@\w")
    if language.hash_defines:
        ways.append(r"\#\s*define\s")
    if lang == "ruby":
        ways.append(r"attr_\w+\s")
    return re.compile("|".join(f"(?:{w})" for w in ways))


@functools.cache
def _declaring(lang: str) -> re.Pattern:
    language = LANGUAGES[lang]
    keyword = "|".join(re.escape(k) for k in sorted(language.keywords, key=len, reverse=True))
    ways = [rf"(?<![\w$.@])(?P<keyword>{keyword})(?![\w$])"]
    if language.typed:
        ways.append(rf"(?<=[\w>\]*&?\s])(?P<typed>(?:{NAME}::)*~?{NAME})\s*\(")
    if language.members:
        ways.append(rf"(?<![\w$.])(?P<member>{NAME})\s*(?:<[^<>(){{}}]*>)?\(")
    return re.compile("|".join(f"(?:{w})" for w in ways))


class Source:
    """A text with its braces and parentheses matched."""

    def __init__(self, content: str, lang: str):
        self.content, self.lang, self.language = content, lang, LANGUAGES[lang]
        self.text = blanked(content, lang)
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.text):
            if m.group() in "({[":
                open_.append(m.start())
            else:
                want = {")": "(", "}": "{", "]": "["}[m.group()]
                if any(self.text[k] == want for k in open_[-64:]):
                    while open_ and self.text[open_[-1]] != want:
                        open_.pop()
                    if open_:
                        self.match[open_.pop()] = m.start()
        self.lines = [0, *(m.end() for m in re.finditer("\n", content))]

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def body(self, at: int) -> tuple[int, int]:
        """(place of what opens the body, end) of what is declared before ``at``: a brace that matches, else the end of the statement, of the line or of what is around."""
        k = at
        while k < len(self.text):
            c = self.text[k]
            if c in "([" and k in self.match:
                k = self.match[k] + 1
            elif c == "{":
                return k, self.match.get(k, len(self.text) - 1) + 1
            elif c in ";}" or (c == "\n" and self._ends(k)):
                return k, k + (c == ";")
            else:
                k += 1
        return k, k

    def _ends(self, k: int) -> bool:
        """Whether a statement ends with its line: where no semicolons are needed and neither side goes on."""
        if self.lang not in ("kotlin", "scala", "swift", "go", "typescript", "tsx", "javascript", "python"):
            return False
        before, after = self.text[max(0, k - 200) : k].rstrip(" \t"), self.text[k + 1 : k + 200].lstrip()
        return not before.endswith((",", "=", "(", ":", "|", "&", ".", "->", "=>", "<")) and not after.startswith(("{", ".", ":", "extends", "implements", "where", "with", "=", "->"))


def _named(src: Source, m: re.Match) -> tuple[str, str, int] | None:
    """(name, kind, place behind the name) of a keyword's declaration."""
    word, text = m["keyword"], src.text
    kind = src.language.keywords[word]
    rest = text[m.end() : m.end() + 400]
    skip = {
        "go": r"\s*\([^()]*\)\s*" if word == "func" else r"\s+", "rust": r"(?:\s*<[^{;()]*?>)?\s+(?:[^{;]*?\bfor\s+)?" if word == "impl" else r"\s+",
        "kotlin": r"(?:\s*<[^()]*?>)?\s+(?:[\w.<>?, ]*\.)?" if word == "fun" else r"\s+", "cpp": r"(?:\s+class)?\s+" if word == "enum" else r"\s+",
    }.get(src.lang, r"\s*\*?\s*&?")
    name = r"(?:self\.)?" + NAME + r"[?!]?" if src.lang == "ruby" else NAME
    found = re.match(rf"(?:{skip}){'' if src.lang != 'rust' else '&?'}({name})", rest) or re.match(rf"\s+({name})", rest)
    if not found or found[1] in CONTROL:
        return None
    if src.lang == "go" and word == "func" and re.match(r"\s*\(", rest):
        kind = "receiver"
    if src.lang == "go" and word == "type":
        follow = re.match(r"(?:\[[^\]]*\])?\s*(struct|interface)\b", rest[found.end() :])
        kind = follow[1] if follow else "type"
    if src.lang in ("c", "cpp") and word in ("struct", "union", "enum", "class") and not re.match(r"[^;()=]*\{", rest[found.end() :]):
        return None
    if word in ("typedef", "template") or (src.lang == "go" and word in ("var", "const")):
        return None
    return found[1].removeprefix("self."), kind, m.end() + found.end()


def declarations(content: str, lang: str) -> list[tuple[str, str, int, int, int, int, int]]:
    """(name, kind, start, end, start_line, end_line, depth) of all declarations, outer ones first. A function in a class-like one is a method."""
    src, found = Source(content, lang), []
    for m in _declaring(lang).finditer(src.text):
        start = src.text.rfind("\n", 0, m.start()) + 1
        prefix = src.text[start : m.start()]
        # A declaration begins where its statement does.
        begin = start + len(prefix) - len(prefix.lstrip()) if not re.search(r"[{};]", prefix) else start + max(prefix.rfind(c) for c in "{};") + 1
        begin += len(src.text[begin : m.start()]) - len(src.text[begin : m.start()].lstrip())
        if m["keyword"]:
            if (named := _named(src, m)) is None:
                continue
            name, kind, behind = named
            if src.language.indented:
                found.append((name, kind, begin, _dedent(src, m.start())))
                continue
            found.append((name, kind, begin, src.body(behind)[1]))
            continue
        typed = m["typed"] if src.language.typed else None
        name = typed or m["member"]
        close = src.match.get(m.end() - 1)
        if close is None or name in CONTROL or name in src.language.keywords:
            continue
        tail = re.match(r"\s*(?:const|noexcept|override|final|throws\s+[\w.,\s]+|async\*?|sync\*|:\s*[^{};=]*|->\s*[^{};=]*)*\s*(\{|=>|;)?", src.text[close + 1 : close + 400])
        before = src.text[begin : m.start()].strip()
        if not tail or not tail[1]:
            continue
        if typed:
            words = before.split()
            if not words and tail[1] != "{" or re.search(r"[=(.]|\b(?:return|new|throw|else|await|yield|case|goto|delete)\b", re.sub(r"@\w+(?:\([^)]*\))?", "", before)):
                continue
            if tail[1] == ";" and (lang in ("c", "cpp") or not words):
                continue
        elif tail[1] != "{" or re.search(r"[=(.,?:&|]|\b(?:return|new|function|else|await|yield|case)\b", before):
            continue
        at = close + 1 + tail.end(1) - 1
        end = src.match.get(at, len(src.text) - 1) + 1 if tail[1] == "{" else src.text.find(";", at) + 1 or len(src.text)
        found.append((name.split("::")[-1], "function" if typed else "method", begin, end))
    found.sort(key=lambda d: (d[2], -d[3]))
    out: list[tuple] = []
    around: list[tuple] = []
    for name, kind, a, b in found:
        while around and around[-1][3] <= a:
            around.pop()
        inside = around[-1][1] if around else None
        if kind == "method" and inside not in CLASSES | MODULES:
            continue
        kind = "method" if kind == "receiver" else kind
        if kind == "function" and inside in CLASSES | (MODULES if lang == "ruby" else set()) and lang != "python":
            kind = "method"
        out.append((name, kind, a, b, src.line(a), src.line(max(a, b - 1)), len(around)))
        around.append((name, kind, a, b))
    return out


def _dedent(src: Source, at: int) -> int:
    """The end of a block that an ``end`` with the same indentation closes."""
    start = src.text.rfind("\n", 0, at) + 1
    indent = re.match(r"[ \t]*", src.text[start:]).group()
    line_end = src.text.find("\n", at)
    if re.search(r";\s*end\b", src.text[at : line_end if line_end >= 0 else None]):
        return line_end if line_end >= 0 else len(src.text)
    end = re.compile(rf"^{indent}end\b", re.M).search(src.text, at)
    return end.end() if end else len(src.text)


def calls(content: str, lang: str, declared: list[tuple]) -> list[list[str]]:
    """For each of ``declared`` the names that are called in it, not counting what stands in a declaration inside; repeats stay."""
    out: list[list[str]] = [[] for _ in declared]
    if not LANGUAGES[lang].calls or not declared:
        return out
    text, around, k = blanked(content, lang), [], 0
    for m in re.finditer(rf"(?<![\w$@])({NAME})[?!]?\s*(?:<[^<>(){{}};]*>)?\(", text):
        name, at = m[1], m.start()
        while k < len(declared) and declared[k][2] <= at:
            around.append(k)
            k += 1
        while around and declared[around[-1]][3] <= at:
            around.pop()
        owners = [i for i in reversed(around) if declared[i][3] > at]
        if not owners or name in CONTROL or declared[owners[0]][1] == "interface":
            continue
        before = text[max(0, at - 40) : at].rstrip()
        # The name that a declaration gives is no call, nor is a type that is made where that counts as none.
        if re.search(rf"\b(?:{'|'.join(re.escape(w) for w in LANGUAGES[lang].keywords)})(?:\s*\([^()]*\))?(?:\s*<[^<>]*>)?$", before) or _is_header(declared, owners, name, at, text):
            continue
        if re.search(r"\bnew$", before) and lang not in ("java", "c_sharp"):
            continue
        out[owners[0]].append(name)
    return out


def _is_header(declared: list[tuple], owners: list[int], name: str, at: int, text: str) -> bool:
    own = declared[owners[0]]
    return own[0] == name and not re.search(r"[{;]|=>", text[own[2] : at])
