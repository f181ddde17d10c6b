"""Writing comments into source files: fields to text, where each goes, the edits, and checks of the result.

All edits of a file are made against its text as it is and put together once, from left to right.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import comments, solidity

WIDTH = 100
#: Tags that are written for another one.
ALIASES = {"returns": "return", "params": "param", "parameter": "param"}
_ALIAS = re.compile(r"(?m)^(\s*(?:///?|\*)?\s*)@(" + "|".join(ALIASES) + r")\b")
_LONG_WORD = re.compile(r"[A-Za-z]{2,}")
_TAG_NAME = re.compile(r"\s*@([A-Za-z][\w:-]*)")


@dataclass
class Comment:
    """A declaration's documentation by fields; paragraphs of notice and dev stay apart, ``preamble`` is text before any tag."""

    notice: list[str] = field(default_factory=list)
    dev: list[str] = field(default_factory=list)
    params: dict[str, str] = field(default_factory=dict)
    returns: list[str] = field(default_factory=list)
    inheritdoc: str | None = None
    title: str = ""
    author: str = ""
    preamble: str = ""
    custom: list[tuple[str, str]] = field(default_factory=list)

    def __bool__(self) -> bool:
        return any(bool(v) for v in vars(self).values())


def marked_lines(text: str) -> list[str]:
    """Lines of a comment without its marks; a text without marks is its own lines."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text):
        line = re.sub(r"^\s*(?:/\*\*?(?!/)|///?|\*(?!/))?[ \t]?", "", line)
        out.append(re.sub(r"\s*\*+/\s*$", "", line).strip())
    return out


def tag_names(text: str) -> list[str]:
    return [m.group(1) for line in marked_lines(text) if (m := _TAG_NAME.match(line))]


def parse(text: str | None) -> Comment:
    """A comment, with or without marks, as fields. Text before the first tag is the notice, or the preamble if a notice follows."""
    c, plain, seen = Comment(), [], False
    found: list[list[str]] = []
    for line in marked_lines(text or ""):
        m = _TAG_NAME.match(line)
        if m:
            seen = True
            found.append([m.group(1), line[m.end() :].strip()])
        elif seen:
            found[-1][1] = f"{found[-1][1]} {line}".strip()
        elif line:
            plain.append(line)
    lead = " ".join(plain)
    for tag, body in found:
        if tag in ("notice", "dev") and body:
            getattr(c, tag).append(body)
        elif tag == "param":
            name, _, rest = body.partition(" ")
            c.params.setdefault(name, rest.strip())
        elif tag == "return":
            c.returns.append(body)
        elif tag == "inheritdoc":
            c.inheritdoc = body or None
        elif tag in ("title", "author"):
            setattr(c, tag, f"{getattr(c, tag)} {body}".strip())
        elif tag.startswith("custom:"):
            c.custom.append((tag, body))
    if lead and c.notice:
        c.preamble = lead
    elif lead:
        c.notice = [lead]
    return c


def of_fields(fields: dict[str, str] | None) -> Comment:
    """From a map of notice, dev, param:<name> and return:<i>; returns come in the order of their numbers."""
    f = fields or {}
    number = lambda k: int(k[7:]) if k[7:].isdigit() else 0
    return Comment(
        notice=[f["notice"]] if f.get("notice") else [], dev=[f["dev"]] if f.get("dev") else [], params={k[6:]: v for k, v in f.items() if k.startswith("param:")},
        returns=[f[k] for k in sorted((k for k in f if k.startswith("return:")), key=number)], inheritdoc=f.get("inheritdoc") or None,
    )


def style_of(src: str) -> str:
    """``block`` if more lines of the file stand in documentation blocks than in ``///`` lines, else ``line``."""
    lines = blocks = 0
    for kind, a, b in solidity.spans(src):
        lines += kind == "doc_line"
        blocks += len(src[a:b].splitlines()) if kind == "doc_block" else 0
    return "block" if blocks > lines else "line"


def tag_lines(c: Comment, params: Iterable[str], returns: list[str | None]) -> list[str]:
    """A comment's tags, one text each, in the order in which they are written.

    Parameters and returns are those of the declaration, in its order; a return with a name begins with it.
    With ``inheritdoc`` only dev stands beside it, as all else comes from the base.
    """
    if c.inheritdoc:
        return [f"@inheritdoc {c.inheritdoc}", *(f"@dev {x}" for x in c.dev)]
    out = [c.preamble] if c.preamble else []
    out += [f"@{tag} {x}" for tag, texts in (("title", [c.title]), ("author", [c.author]), ("notice", c.notice), ("dev", c.dev)) for x in texts if x]
    out += [f"@param {name} {c.params[name]}" for name in params if c.params.get(name)]
    for text, name in zip(c.returns, returns):
        if text:
            out.append(f"@return {text}" if not name or text.split(" ", 1)[0] == name else f"@return {name} {text}")
    return out + [f"@{k if k.startswith('custom:') else 'custom:' + k} {x}" for k, x in c.custom]


def layout(tags: list[str], style: str = "line", indent: str = "", width: int = WIDTH) -> str:
    """Tags as a comment, wrapped; no tags give no text."""
    lead = f"{indent} * " if style == "block" else f"{indent}/// "
    body = [lead + w for t in tags for w in textwrap.wrap(t, max(20, width - len(lead)), break_long_words=False, break_on_hyphens=False) or [t]]
    if not body:
        return ""
    return "\n".join([f"{indent}/**", *body, f"{indent} */"] if style == "block" else body)


def normalise(text: str | None, style: str = "line", indent: str = "", width: int = WIDTH) -> str:
    """Any comment text as a proper comment. Known misspellings of tags are mended, parameters and returns are the text's own."""
    c = parse(_ALIAS.sub(lambda m: f"{m.group(1)}@{ALIASES[m.group(2)]}", text or ""))
    return layout(tag_lines(c, list(c.params), [None] * len(c.returns)), style, indent, width)


# where comments go ---------------------------------------------------------------------------------------------


@dataclass
class Place:
    """A declaration and its header's names, and the spans of its comment."""

    decl: solidity.Decl
    signature: str
    params: list[str]
    returns: list[str | None]
    doc: tuple[tuple[int, int], ...]


def places(src: str) -> list[Place]:
    """All declarations of a file, containers among them, with the comment that belongs to each."""
    parts = solidity.spans(src)
    code = solidity.code_view(src, parts)
    decls = solidity.declarations(code, containers=True)
    out = []
    for d, doc in zip(decls, solidity.attach(decls, solidity.doc_units(src, parts), code)):
        h = None if d.kind in ("contract", "interface", "library") else solidity.header(code, d)
        out.append(Place(d, solidity.signature(d, h) if h else d.name, [p.name for p in h.params if p.name] if h else [], [p.name for p in h.returns] if h else [], doc.parts if doc else ()))
    return out


def documents(src: str, doc: tuple[tuple[int, int], ...]) -> bool:
    """Whether a comment says anything: it has a tag, or three words of two letters or more. A row of asterisks does not."""
    text = "\n".join(src[a:b] for a, b in doc)
    return bool(tag_names(text)) or sum(len(_LONG_WORD.findall(x)) for x in marked_lines(text)) >= 3


def _line_start(src: str, at: int) -> int:
    return src.rfind("\n", 0, at) + 1


def indent_at(src: str, at: int) -> str:
    lead = src[_line_start(src, at) : at]
    return "" if lead.strip() else lead


def removals(src: str, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits that take comments out: a line with nothing else goes whole, of another the code stays, without blanks at its end."""
    out = []
    for a, b in sorted(spans):
        while b > a and src[b - 1] in "\r\n":
            b -= 1
        first, end = _line_start(src, a), src.find("\n", b)
        end = len(src) if end < 0 else end + 1
        before, after = src[first:a], src[b:end]
        if not before.strip() and not after.strip():
            out.append((first, end, ""))
        elif not after.strip():
            out.append((first + len(before.rstrip()), b, ""))
        else:
            out.append((a, b, ""))
    return out


def edited(src: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """``src`` with the edits (start, end, text), which are made once each and do not overlap; of two at one place the first given comes first."""
    out, at = [], 0
    for a, b, text in sorted(dict.fromkeys(edits), key=lambda e: (e[0], e[1])):
        out += [src[at : max(at, a)], text]
        at = max(at, b)
    return "".join([*out, src[at:]])


def plan(src: str, wanted: dict[int, Comment], mode: str = "fill", known: list[Place] | None = None) -> list[tuple[Place, Comment]]:
    """Which comments are written where; ``wanted`` is by the offset of a declaration, and another offset is an error.

    ``fill`` leaves declarations that have documentation as they are, ``replace`` does not. Empty comments are none.
    """
    if mode not in ("fill", "replace"):
        raise ValueError(f"mode must be fill or replace, not {mode!r}")
    at = {p.decl.start: p for p in (places(src) if known is None else known)}
    stray = sorted(wanted.keys() - at.keys())
    if stray:
        raise ValueError(f"no declaration at {stray}")
    return [(at[k], c) for k, c in sorted(wanted.items()) if c and not (mode == "fill" and documents(src, at[k].doc))]


def document(src: str, wanted: dict[int, Comment], mode: str = "fill", style: str | None = None, width: int = WIDTH) -> tuple[str, int]:
    """The file with the comments written in, and how many were. A comment that says nothing is replaced in either mode."""
    style = style or style_of(src)
    edits, n = [], 0
    for p, c in plan(src, wanted, mode):
        text = layout(tag_lines(c, p.params, p.returns), style, indent_at(src, p.decl.start), width)
        if text:
            edits += removals(src, p.doc)
            at = _line_start(src, p.decl.start)
            edits.append((at, at, text + "\n"))
            n += 1
    return edited(src, edits), n


def attach(src: str, spans: list[list[int]] | None, start: int, comment: str) -> str:
    """The file with the spans of a declaration's comment taken out as they are and another one, line by line at its indent, put above it."""
    indent = indent_at(src, start)
    body = "\n".join(indent + x.strip() for x in comment.strip().splitlines() if x.strip())
    at = _line_start(src, start)
    return edited(src, [*((a, b, "") for a, b in spans or []), (at, at, body + "\n")])


def annotate(src: str, wanted: dict[int, str]) -> str:
    """The file with every comment above the given declarations, of whatever kind, replaced by one notice."""
    parts = solidity.spans(src)
    edits = []
    for start, text in wanted.items():
        above, at = [], start
        for kind, a, b in reversed([s for s in parts if s.end <= start or s.start < start]):
            if kind == "code":
                if src[a : min(b, at)].strip():
                    break
            elif kind == "string":
                break
            else:
                above.append((a, b))
            at = a
        edits += removals(src, above)
        line = _line_start(src, start)
        edits.append((line, line, f"{indent_at(src, start)}/// @notice {' '.join(text.split())}\n"))
    return edited(src, edits)


def without_comments(src: str) -> str:
    """The code alone, line by line, without blank lines and ends: equal for files that differ in comments only."""
    spans = [(a, b) for kind, a, b in solidity.spans(src) if kind not in ("code", "string")]
    return "\n".join(x.rstrip() for x in edited(src, ((a, b, "") for a, b in spans)).splitlines() if x.strip())


def without_documentation(src: str) -> str:
    """The file without the comments that belong to a declaration; all others, and the layout, stay."""
    return edited(src, removals(src, {s for p in places(src) for s in p.doc}))


def strip_lines(comment: str, claims: Iterable[str]) -> str:
    """A comment without the lines that hold one of the claims, or part of one; as it was if nothing would be left."""
    flat = lambda s: " ".join(s.lower().split())
    gone = [t for t in map(flat, claims) if t]
    lines = [(x, flat(x.lstrip("/ *"))) for x in comment.splitlines()]
    kept = "\n".join(x for x, body in lines if not (body and any(t in body or body in t for t in gone))).strip()
    return kept or comment


# columns ---------------------------------------------------------------------------------------------------------

def verify(original: str, emitted: str) -> dict:
    """Whether an emitted file has the original's code, and how many of its exposed members are documented; ``completeness`` is null of none."""
    members = comments.exposed_members(emitted)
    n, done = len(members), sum(m[2] for m in members)
    return {"code_unchanged": without_comments(original) == without_comments(emitted), "exposed": n, "documented": done, "completeness": done / n if n else None}


def verified(original: Column, emitted: Column) -> Column:
    """Column of ``verify``; null texts count as empty."""

    @F.arrow_udf("struct<code_unchanged:boolean,exposed:int,documented:int,completeness:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.struct([("code_unchanged", pa.bool_()), ("exposed", pa.int32()), ("documented", pa.int32()), ("completeness", pa.float64())])
        return pa.array([verify(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return run(original, emitted)


_RESULT = "struct<emitted:string,placed:int,skipped:array<string>,code_unchanged:boolean>"


def emit(src: str | None, records: list[dict] | None, mode: str = "fill") -> dict:
    """A file's documentation stripped and that of its ``records`` (``container``, ``signature``, ``fields``) written in; of two for one declaration the last wins."""
    if not src:
        return {"emitted": src, "placed": 0, "skipped": [r["signature"] for r in records or []], "code_unchanged": True}
    bare = without_documentation(src)
    offset = {}
    for p in places(bare):
        offset.setdefault((p.decl.container or "", p.signature), p.decl.start)
    wanted, skipped = {}, []
    for r in records or []:
        key = (r["container"] or "", r["signature"])
        if key in offset:
            wanted[offset[key]] = of_fields(dict(r["fields"] or {}))
        else:
            skipped.append(r["signature"])
    out, n = document(bare, wanted, mode)
    return {"emitted": out, "placed": n, "skipped": skipped, "code_unchanged": without_comments(out) == without_comments(src)}


def emitted(src: Column, records: Column, mode: str = "fill") -> Column:
    """Column of documented files; ``records`` is an array of structs of container, signature and a map of fields."""

    @F.arrow_udf(_RESULT)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.struct([("emitted", pa.string()), ("placed", pa.int32()), ("skipped", pa.list_(pa.string())), ("code_unchanged", pa.bool_())])
        return pa.array([emit(x, y, mode) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return run(src, records)


def _text_column(f):
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in col.to_pylist()], pa.string())

    return run


def normalised(comment: Column) -> Column:
    return _text_column(normalise)(comment)


def bare_code(src: Column) -> Column:
    return _text_column(without_comments)(src)


def undocumented(src: Column) -> Column:
    return _text_column(without_documentation)(src)


def accepted(compiles: Column, tags: Column, before: Column, after: Column) -> Column:
    """Whether a refined comment is taken: the file compiles with it, its tags are kept, and it has no more defects (arrays) than the draft."""
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return F.coalesce(compiles, F.lit(False)) & F.coalesce(tags, F.lit(False)) & (n(after) <= n(before))


def inheritdoc_target(overrides: Column, bases: Column, documented: Column) -> Column:
    """The first of ``bases`` that documents the declaration (``documented``: names of containers that do); null if it overrides nothing or none does."""
    some = F.filter(F.coalesce(bases, F.array().cast("array<string>")), lambda b: F.array_contains(documented, b))
    return F.when(F.coalesce(overrides, F.lit(False)) | (F.coalesce(F.size(bases), F.lit(0)) > 0), F.try_element_at(some, F.lit(1)))
