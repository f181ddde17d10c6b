"""Solidity source text: lexing into spans, declarations, documentation comments.

Everything here works on one file's text and yields character offsets into it. Line ends are never
translated, so offsets hold for the text as stored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F

# one alternative per span that is not code; an unterminated block comment runs to the end of the text
_SPAN = re.compile(
    r"""//[^\r\n]*
      | /\*(?:[^*]|\*(?!/))*(?:\*/|\Z)
      | "(?:\\.|[^"\\\r\n])*"?
      | '(?:\\.|[^'\\\r\n])*'?""",
    re.X | re.S,
)
_VISIBLE = re.compile(r"[^\s]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_TAG = re.compile(r"@([A-Za-z][\w:-]*)[ \t]*")
_DECL = re.compile(r"(?<![\w$.])(function|constructor|fallback|receive|modifier|event|error|contract|interface|library)(?![\w$])")
_NAME = re.compile(r"\s*([A-Za-z_$][\w$]*)?\s*")
_ABSTRACT = re.compile(r"\babstract\s+\Z")
_EDGE = re.compile(r"[{;()]")
_BRACE = re.compile(r"[{}]")


class Span(NamedTuple):
    kind: str  # code, line, doc_line, block, doc_block, string
    start: int
    end: int


class Decl(NamedTuple):
    kind: str  # function, constructor, fallback, receive, modifier, event, error; or contract, interface, library
    name: str
    container: str
    start: int
    header_end: int
    end: int
    has_body: bool
    container_kind: str = ""


class Doc(NamedTuple):
    start: int
    end: int
    parts: tuple[tuple[int, int], ...]


def comment_kind(text: str) -> str:
    if text.startswith("///"):
        return "line" if text.startswith("////") else "doc_line"
    if text.startswith("/**"):
        return "block" if text in ("/**/", "/**") else "doc_block"
    return "line" if text.startswith("//") else "block"


def spans(src: str) -> list[Span]:
    """Spans that tile ``src`` without gaps."""
    out, at = [], 0
    for m in _SPAN.finditer(src):
        s, e = m.span()
        if s > at:
            out.append(Span("code", at, s))
        t = m.group()
        out.append(Span(comment_kind(t) if t[0] == "/" else "string", s, e))
        at = e
    if at < len(src):
        out.append(Span("code", at, len(src)))
    return out


def code_view(src: str, parts: list[Span] | None = None) -> str:
    """``src`` at the same length, comments as blanks and the inside of strings as ``x``."""
    out = []
    for kind, s, e in parts if parts is not None else spans(src):
        if kind == "code":
            out.append(src[s:e])
        elif kind == "string":
            out.append('"' + "x" * (e - s - 2) + '"' if e - s > 1 else '"')
        else:
            out.append(_VISIBLE.sub(" ", src[s:e]))
    return "".join(out)


def _closing(code: str, at: int) -> int:
    """Offset after the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in _BRACE.finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _header_end(code: str, at: int) -> tuple[int, bool]:
    """Where the header from ``at`` on ends, and whether a body follows."""
    depth = 0
    for m in _EDGE.finditer(code, at):
        c = m.group()
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth <= 0:
            return m.start(), c == "{"
    return len(code), False


def declarations(code: str, containers: bool = False) -> list[Decl]:
    """Functions, constructors, fallbacks, receives, modifiers, events and errors of a code view; with ``containers`` these, too.

    Bodies are skipped whole, so assembly functions and function-typed variables inside them declare
    nothing. ``function`` without a name is a type unless a body follows (the unnamed fallback).
    """
    out: list[Decl] = []
    at, closes = 0, []  # closes: (offset where the container ends, its name, its kind)
    while m := _DECL.search(code, at):
        word, start = m.group(1), m.start()
        at = m.end()
        before = code[:start].rstrip()[-1:] if start < 4096 else code[start - 4096 : start].rstrip()[-1:] or code[:start].rstrip()[-1:]
        if word in ("contract", "interface", "library"):
            if before in ("", "{", "}", ";", "﻿") or code[:start].rstrip().endswith("abstract"):
                n = _NAME.match(code, at)
                end, body = _header_end(code, n.end())
                if n.group(1) and body:
                    closes.append((_closing(code, end), n.group(1), word))
                    at = end + 1
                    if containers:
                        first = _ABSTRACT.search(code, 0, start)
                        out.append(Decl(word, n.group(1), "", first.start() if first else start, end, closes[-1][0], True))
            continue
        if before not in ("", "{", "}", ";", "﻿"):
            continue
        n = _NAME.match(code, at)
        name = n.group(1) or ""
        opens = code[n.end() : n.end() + 1]
        if word in ("constructor", "fallback", "receive") and (name or opens != "("):
            continue
        if word == "function" and opens != "(" or word == "modifier" and (not name or opens not in "({") or word in ("event", "error") and (not name or opens != "("):
            continue
        end, body = _header_end(code, n.end())
        if word == "function" and not name:
            if not body:
                at = end
                continue
            word = "fallback"
        stop = _closing(code, end) if body else min(end + 1, len(code))
        while closes and closes[-1][0] <= start:
            closes.pop()
        _, holder, kind = closes[-1] if closes else (0, "", "")
        out.append(Decl(word, name or word, holder, start, end, stop, body, kind))
        at = stop
    return out


def doc_units(src: str, parts: list[Span]) -> list[Doc]:
    """Documentation comments: each ``/**`` block, and each run of ``///`` lines.

    Ordinary comments and blank lines do not break a run; code and other blocks do.
    """
    out: list[Doc] = []
    run: list[tuple[int, int]] = []

    def close() -> None:
        if run:
            out.append(Doc(run[0][0], run[-1][1], tuple(run)))
            run.clear()

    for kind, s, e in parts:
        if kind == "doc_line":
            run.append((s, e))
        elif kind == "doc_block":
            close()
            out.append(Doc(s, e, ((s, e),)))
        elif kind == "string" or kind == "code" and not src[s:e].isspace():
            close()
    close()
    return out


def attach(decls: list[Decl], docs: list[Doc], code: str) -> list[Doc | None]:
    """As-of interval join: for each declaration the latest comment that ends before it.

    Comments and declarations are two sorted lists of intervals of the same file. A match is rejected
    if anything but blanks (ordinary comments are blanks of the code view) lies between the two.
    """
    ends = [d.end for d in docs]
    out: list[Doc | None] = []
    for d in decls:
        k = bisect_right(ends, d.start) - 1
        doc = docs[k] if k >= 0 else None
        out.append(doc if doc and not code[doc.end : d.start].strip("﻿ \t\r\n\f\v") else None)
    return out


def strip_markers(src: str, doc: Doc) -> list[str]:
    """The comment's lines without comment markers."""
    lines: list[str] = []
    for s, e in doc.parts:
        t = src[s:e]
        if t.startswith("///"):
            lines.append(t[3:].strip())
            continue
        for line in re.split(r"\r\n|\r|\n", t[3:].removesuffix("*/")):
            line = line.strip()
            lines.append(line.lstrip("*").strip() if line.startswith("*") else line)
    return lines


def tags(lines: list[str]) -> list[tuple[str, str]]:
    """(tag, text) in order; text before any tag counts as ``notice``."""
    out: list[list] = []
    for line in lines:
        m = _TAG.match(line)
        if m:
            out.append([m.group(1), line[m.end() :]])
        elif line:
            if not out:
                out.append(["notice", line])
            else:
                out[-1][1] = f"{out[-1][1]} {line}".strip()
    return [(a, b) for a, b in out]


def description(found: list[tuple[str, str]]) -> str:
    return " ".join(t for tag, t in found if tag in ("notice", "dev") and t).strip()


# fixed values: how a place for text to be written announces itself
_PLACEHOLDER = re.compile(
    r"""^\W*(?:
        (?:todo|fixme|xxx|tbd|tba|tbc|wip|placeholder|lorem\s+ipsum|n/?a|undocumented|unfinished|stub)\b
      | missing(?:\W*$|\W+(?:docs?|documentation|descriptions?|comments?|natspec|text|summary|notice)\b)
      | \?\?\?
      | (?:add|write|insert|put|fill\s+in|complete|provide|enter)\s+(?:\w+\s+){0,3}?(?:docs?|documentation|description|comment|comments|text|natspec|notice|summary)\b(?:\s+\w+){0,3}\W*$
      | (?:\w+\s+){0,3}?(?:docs?|documentation|description|comments?|natspec|explanation|details?|text|summary)\s+(?:\w+\s+){0,2}?(?:here|later|soon|pending|needed|missing|required|follows?|coming|goes)\b(?:\s+\w+){0,3}\W*$
      | (?:to\s+be|will\s+be|needs?\s+to\s+be|must\s+be|should\s+be)\s+(?:documented|written|added|described|done|filled|completed|defined|determined|explained|decided|announced)\b(?:\s+\w+){0,3}\W*$
      | (?:needs?|requires?)\s+(?:an?\s+|some\s+|proper\s+|more\s+|better\s+)*(?:docs?|documentation|description|comments?|explanation)\W*$
      | (?:not|never)\s+(?:yet\s+)?documented\b(?:\s+\w+){0,2}\W*$
      | no\s+(?:\w+\s+)?(?:docs?|documentation|description|comments?)\b(?:\s+\w+){0,2}\W*$
      )""",
    re.X | re.I,
)


# What a text about documentation names, and what says that it is still to come, surely or perhaps.
_ABOUT = frozenset("doc docs documentation description comment comments natspec notice summary explanation text words content details describe described explain explained document documented".split())
_TO_COME = frozenset("todo tbd fixme please later soon yet pending awaiting await placeholder construction remember unfinished stub coming".split())
_MAYBE = frozenset("no missing need needs needed required fill insert replace follow follows write written goes".split())
_ORDER = re.compile(
    r"""^\W*(?:
        (?:describe|explain|document)\s+(?:\w+\s+){0,2}?(?:this|me|it|function|method|here|what)\b
      | (?:yet|still)\s+to\s+be\s+(?:written|documented|described|filled|added|explained)\b
      | (?:coming\s+soon|under\s+construction|work\s+in\s+progress)\b
      | replace\s+(?:me|this|with)\b
      | (?:this|the)\s+\w+\s+(?:has|have)\s+no\s+(?:\w+\s+)?(?:docs?|documentation|description|comments?)\b
      )""",
    re.X | re.I,
)


def _awaits_text(text: str, words: list[str]) -> bool:
    """Whether a short text without names of code speaks of the documentation that is still to be written."""
    if len(words) > 12 or "`" in text or any(w[1:].lower() != w[1:] for w in words if not w.isupper()):
        return False
    said = [w.lower() for w in words]
    about, sure, maybe = (sum(w in group for w in said) for group in (_ABOUT, _TO_COME, _MAYBE))
    return bool(_ORDER.match(text)) or about > 0 and (sure > 0 or about + maybe > 2 and maybe > 0)


# what stands in brackets, or for an omission, where text should be
_SLOT = re.compile(r"(?<![\w`)\]])(?:<[^<>`]*>|\[[^\[\]`]*\]|\{+[^{}`]*\}+)|_{2,}|\.{3,}|…")


def is_trivial(text: str, name: str) -> bool:
    """No more than two words, slots to be filled in not counted; the declared name again; or merely a placeholder."""
    words = _WORD.findall(text)
    if len(words) <= 2 or len(_WORD.findall(_SLOT.sub(" ", text))) <= 2:
        return True
    if _PLACEHOLDER.match(text) or _awaits_text(text, words):
        return True
    said = "".join(words).lower()
    return bool(name) and said in {name.replace("_", "").replace("$", "").lower()}


# headers --------------------------------------------------------------------------------------------------


class Param(NamedTuple):
    type: str
    name: str | None


class Header(NamedTuple):
    params: tuple[Param, ...]
    returns: tuple[Param, ...]
    visibility: str | None
    mutability: str | None
    is_virtual: bool
    overrides: bool


_PARTS = re.compile(r"[()\[\]{}]|,")
_TAIL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)$")
# fixed values: words that end a parameter without naming it; words a signature leaves out
_NO_NAME = "memory storage calldata payable external internal public private pure view indexed anonymous".split()
_LOCATION = re.compile(r"\b(?:memory|storage|calldata|payable)\b|\s+")


def split_top(text: str) -> list[str]:
    """The parts of a list between commas that stand in no bracket; blank parts are none."""
    out, depth, at = [], 0, 0
    for m in _PARTS.finditer(text):
        c = m.group()
        if c == ",":
            if depth == 0:
                out.append(text[at : m.start()])
                at = m.end()
        else:
            depth += 1 if c in "([{" else -1
    return [x.strip() for x in (*out, text[at:]) if x.strip()]


def last_group(text: str) -> str:
    """What the last bracket of a text that stands in no other holds; empty if there is none."""
    depth, at, got = 0, 0, ""
    for m in re.finditer(r"[()]", text):
        if m.group() == "(":
            at = at if depth else m.end()
            depth += 1
        elif depth:
            depth -= 1
            got = got if depth else text[at : m.start()]
    return got


def parameter(raw: str) -> Param:
    """Type and name of one declared parameter; the name is the last word, unless that belongs to the type."""
    raw = raw.strip()
    m = _TAIL.search(raw)
    kind = raw[: m.start()].rstrip() if m else ""
    if not kind or kind.endswith(".") or m.group() in _NO_NAME:
        return Param(raw, None)
    if kind.endswith(")") and not kind.endswith("returns)") and re.search(r"\bmapping\s*\(", kind) and not re.search(r"\b(?:memory|storage|calldata)\b", kind):
        return Param(raw, None)
    return Param(kind, m.group())


def type_key(p: Param) -> str:
    """A type as signatures have it: without blanks, location and ``payable``."""
    return _LOCATION.sub("", p.type)


def _group(code: str, at: int, end: int) -> tuple[str, int]:
    """What the bracket opened at or after ``at`` holds, and the offset after it."""
    first = code.find("(", at, end)
    if first < 0:
        return "", at
    depth = 0
    for m in re.finditer(r"[()]", code[first:end]):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return code[first + 1 : first + m.start()], first + m.end()
    return code[first + 1 : end], end


def header(code: str, d: Decl) -> Header:
    inner, after = _group(code, d.start, d.header_end)
    tail = code[after : d.header_end]
    m = re.search(r"\breturns\b", tail)
    back = _group(code, after + m.end(), d.header_end)[0] if m else ""
    word = lambda *options: next((w for w in options if re.search(rf"\b{w}\b", tail)), None)
    return Header(
        tuple(map(parameter, split_top(inner))), tuple(map(parameter, split_top(back))), word("external", "public", "internal", "private"), word("pure", "view", "payable"),
        word("virtual") is not None, word("override") is not None,
    )


def signature(d: Decl, h: Header) -> str:
    return f"{d.name}({','.join(map(type_key, h.params))})"


_DECLARED = "array<struct<kind:string,name:string,container:string,start:int,body:boolean,signature:string,arity_key:string,visibility:string,mutability:string,is_virtual:boolean,overrides:boolean,params:array<string>,returns:array<string>>>"


def declared_in(src: str | None) -> list[tuple]:
    """Declarations of a file with their headers' parts; null and blank texts have none."""
    if not src:
        return []
    code = code_view(src)
    out = []
    for d in declarations(code):
        h = header(code, d)
        names = [p.name or "" for p in h.params], [p.name or "" for p in h.returns]
        out.append((d.kind, d.name, d.container, d.start, d.has_body, signature(d, h), f"{d.name}/{len(h.params)}", h.visibility, h.mutability, h.is_virtual, h.overrides, *names))
    return out


def declared(src):
    """Column of the declarations of a column of files."""
    text, flag = pa.string(), pa.bool_()
    kinds = [text, text, text, pa.int32(), flag, text, text, text, text, flag, flag, pa.list_(text), pa.list_(text)]
    names = re.findall(r"(?:<|,)(\w+):", _DECLARED)
    kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))

    @F.arrow_udf(_DECLARED)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, r)) for r in declared_in(x)] for x in col.to_pylist()], kind)

    return run(src)


def visible_code(src):
    """Column of how many characters of a column of files are code, without comments and blanks."""
    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([len("".join(code_view(x).split())) if x else 0 for x in col.to_pylist()], pa.int32())

    return run(src)


_GUARD = re.compile(r"(?<![\w$.])(require|revert|assert)\b")


def guards_of(code: str | None) -> list[tuple[str, str, str]]:
    """(kind, condition, message) of the guards in a function's text, in order; comments and strings hold none.

    The arguments are those of the statement's last bracket; the first is the condition, the last the
    message. A guard without arguments has its own text as the condition.
    """
    if not code:
        return []
    view, out = code_view(code), []
    for m in _GUARD.finditer(view):
        end = view.find(";", m.start())
        end = len(view) if end < 0 else end
        masked = last_group(view[m.start() : end])
        at = view.rfind(masked, m.start(), end) if masked else m.start()
        parts, lo = [], at
        for part in split_top(masked):
            lo = view.index(part, lo)
            parts.append(code[lo : lo + len(part)])
            lo += len(part)
        out.append((m.group(), parts[0] if parts else code[m.start() : end].strip(), parts[-1].strip('"') if len(parts) > 1 else ""))
    return out


def guards(code):
    """Column of the guards of a column of functions."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "condition", "message")]))

    @F.arrow_udf("array<struct<kind:string,condition:string,message:string>>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "condition", "message"), g)) for g in guards_of(x)] for x in col.to_pylist()], kind)

    return run(code)


class Offsets:
    """Byte and character offsets of a text into each other; those beyond the text are its ends, those inside a character its start."""

    def __init__(self, src: str) -> None:
        self.ends = None
        if not src.isascii():
            at, self.ends = 0, [0]
            for ch in src:
                at += len(ch.encode("utf-8", "surrogatepass"))
                self.ends.append(at)

    def to_char(self, byte: int) -> int:
        return byte if self.ends is None else min(max(bisect_right(self.ends, byte) - 1, 0), len(self.ends) - 1)

    def to_byte(self, char: int) -> int:
        return char if self.ends is None else self.ends[min(max(char, 0), len(self.ends) - 1)]
