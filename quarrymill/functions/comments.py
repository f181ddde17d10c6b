"""Comments as data: fields, styles, rendering; and JSON found in prose."""

from __future__ import annotations

import json
import re
import textwrap

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import solidity

_MARK = re.compile(r"^[ \t]*(?:/\*\*?|\*/|\*(?!\*)|///?)?[ \t]*|[ \t]*\*/[ \t]*$")


def comment_fields(text: str | None) -> dict[str, str]:
    """notice, dev, param:<name>, return:<i> and other tags of a comment, with or without its marks; blank fields are left out."""
    lines = [_MARK.sub("", x) for x in re.split(r"\r\n|\r|\n", text or "")]
    out: dict[str, str] = {}
    returns = 0
    for tag, body in solidity.tags(lines):
        if tag == "param":
            name, _, body = body.partition(" ")
            tag = f"param:{name}"
        elif tag in ("return", "returns"):
            tag, returns = f"return:{returns}", returns + 1
        body = " ".join(body.split())
        if body:
            out[tag] = f"{out[tag]} {body}" if tag in out else body
    return out


def render(fields: dict[str, str], style: str = "block", indent: str = "", width: int = 100) -> str:
    """A comment from fields in canonical order, as a ``block`` or as ``lines``."""
    rank = {"notice": 0, "dev": 1, "param": 2, "return": 3}

    def order(k: str) -> tuple:
        head, _, rest = k.partition(":")
        return rank.get(head, 9), int(rest) if rest.isdigit() else 0, rest

    body: list[str] = []
    for k in sorted(fields, key=order):
        head, _, rest = k.partition(":")
        lead = f"@{head} {rest} " if head == "param" else f"@{head} "
        body += textwrap.wrap(lead + fields[k], max(20, width - len(indent) - 4), break_long_words=False, break_on_hyphens=False)
    if style == "lines":
        return "\n".join(f"{indent}/// {x}" for x in body)
    return "\n".join([f"{indent}/**", *(f"{indent} * {x}" for x in body), f"{indent} */"])


def recover_json(text: str | None) -> dict | None:
    """The first JSON object in a text that parses, whatever stands around it; None if there is none."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def fields(text: Column) -> Column:
    """Column of the fields of a column of comments."""

    @F.arrow_udf("map<string,string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([list(comment_fields(x).items()) for x in col.to_pylist()], pa.map_(pa.string(), pa.string()))

    return run(text)


def json_keys(text: Column) -> Column:
    """Keys of the recovered object; null if there is none."""

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        got = (recover_json(x) for x in col.to_pylist())
        return pa.array([None if g is None else sorted(g) for g in got], pa.list_(pa.string()))

    return run(text)


def exposed_members(src: str | None) -> list[tuple[str, str, bool]]:
    """(kind, signature, documented) of constructors, of public and external functions, of events and of errors."""
    if not src:
        return []
    parts = solidity.spans(src)
    code = solidity.code_view(src, parts)
    out = []
    decls = solidity.declarations(code)
    for d, doc in zip(decls, solidity.attach(decls, solidity.doc_units(src, parts), code)):
        h = solidity.header(code, d)
        if d.kind in ("constructor", "event", "error") or d.kind == "function" and h.visibility in ("public", "external"):
            out.append((d.kind, "constructor" if d.kind == "constructor" else solidity.signature(d, h), doc is not None))
    return out


def exposed(src: Column) -> Column:
    """Column of the exposed members of a column of files."""

    @F.arrow_udf("array<struct<kind:string,name:string,documented:boolean>>")
    def run(col: pa.Array) -> pa.Array:
        names = ("kind", "name", "documented")
        return pa.array([[dict(zip(names, m)) for m in exposed_members(x)] for x in col.to_pylist()], pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.bool_()))))))

    return run(src)
