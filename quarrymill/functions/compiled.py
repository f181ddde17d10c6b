"""What a compiler says a file documents (user and developer documentation, as JSON): read, compared, and matched with a declaration."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .emission import parse
from .solidity import split_top

#: The two kinds of documentation, where members stand in them, and what a contract has of its own.
KINDS, SECTIONS, OWN = ("userdoc", "devdoc"), ("methods", "errors", "events"), ("title", "author", "notice", "details")


def squeezed(value):
    """A value with every run of blanks in its texts as one."""
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, dict):
        return {k: squeezed(v) for k, v in value.items()}
    return [squeezed(v) for v in value] if isinstance(value, list) else value


def members(doc: dict | None) -> dict[str, dict]:
    """Members of a documentation by key; of an overloaded one, a list, the first."""
    out = {}
    for s in SECTIONS:
        for k, v in ((doc or {}).get(s) or {}).items():
            first = v[0] if isinstance(v, list) and v else v
            out[k] = first if isinstance(first, dict) else {}
    return out


def arity(key: str) -> int:
    """How many parameters a key has; those of a tuple are one."""
    return len(split_top(key[key.index("(") + 1 : key.rindex(")")])) if "(" in key and ")" in key else 0


def documented(contract: dict | None, signature: str) -> tuple[dict, dict]:
    """(user, developer) documentation of a declaration: by its signature, else that of the only member with its name and number of parameters."""
    user, dev = (members((contract or {}).get(kind)) for kind in KINDS)
    by_shape: dict[tuple, set[str]] = {}
    for key in (*user, *dev):
        by_shape.setdefault((key.partition("(")[0], arity(key)), set()).add(key)
    alike = by_shape.get((signature.partition("(")[0], arity(signature)), set())
    key = signature if signature in alike else next(iter(alike)) if len(alike) == 1 else None
    return user.get(key, {}), dev.get(key, {})


def entries(doc: dict | None) -> dict[str, object]:
    """Everything a documentation says, by path: contract, kind, and a field of the contract or a section and its member."""
    out: dict[str, object] = {}
    for contract, kinds in (doc or {}).items():
        for kind in KINDS:
            told = (kinds or {}).get(kind) or {}
            out |= {f"{contract}.{kind}.{f}": told[f] for f in OWN if f in told}
            out |= {f"{contract}.{kind}.{s}.{k}": v for s in SECTIONS for k, v in (told.get(s) or {}).items()}
    return out


def differences(a: dict | None, b: dict | None) -> list[str]:
    """Paths at which two documentations disagree, blanks aside, in order."""
    x, y = entries(squeezed(a)), entries(squeezed(b))
    return sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def _loaded(text: str | None) -> dict | None:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        value = None
    return value if isinstance(value, dict) else None


def differing(a: Column, b: Column) -> Column:
    """Column of the differences of two columns of JSON; null where either is null or broken, as nothing can be said then."""

    @F.arrow_udf("array<string>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = ((_loaded(p), _loaded(q)) for p, q in zip(x.to_pylist(), y.to_pylist()))
        return pa.array([None if p is None or q is None else differences(p, q) for p, q in pairs], pa.list_(pa.string()))

    return run(a, b)


def kept_tags(contract: Column, signature: Column, comment: Column) -> Column:
    """Whether a compiler has the notice and every parameter that a comment claims; and the parameters it dropped: (``kept``, ``dropped``)."""
    def of(c: str | None, s: str | None, text: str | None) -> dict:
        user, dev = documented(_loaded(c), s or "")
        claimed = parse(text)
        dropped = sorted(claimed.params.keys() - (dev.get("params") or {}).keys())
        return {"kept": not dropped and not (claimed.notice and not user.get("notice")), "dropped": dropped}

    @F.arrow_udf("struct<kept:boolean,dropped:array<string>>")
    def run(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return pa.array([of(*r) for r in zip(x.to_pylist(), y.to_pylist(), z.to_pylist())], pa.struct([("kept", pa.bool_()), ("dropped", pa.list_(pa.string()))]))

    return run(contract, signature, comment)


def repaired(data: Column, defaults: Column) -> Column:
    """A map with the defaults it lacks; a null value counts as lacking."""
    return F.map_zip_with(defaults, F.coalesce(data, F.create_map().cast("map<string,string>")), lambda _, d, v: F.coalesce(v, d))
