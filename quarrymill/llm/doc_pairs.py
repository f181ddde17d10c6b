"""Functions paired with their documentation.

Comment spans and declaration spans of a file are extracted independently, each sorted by offset; an
as-of interval join gives every declaration the nearest comment that ends before it, and a statement in
between rejects the match. Both span lists come from the same text, so the join runs where the text is:
no span is shuffled, and a file is the unit of work however many files one project holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solidity as sol

PAIR_SCHEMA = (
    "file string, project string, container string, kind string, name string, code_start int, code_end int, "
    "header string, has_body boolean, doc_start int, doc_end int, description string, "
    "tags array<struct<tag:string,text:string>>, code string, natspec string"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("project", pa.string()), ("container", pa.string()), ("kind", pa.string()), ("name", pa.string()),
        ("code_start", pa.int32()), ("code_end", pa.int32()), ("header", pa.string()), ("has_body", pa.bool_()),
        ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("description", pa.string()),
        ("tags", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))), ("code", pa.string()), ("natspec", pa.string()),
    ]
)
_KINDS = {"function", "constructor", "fallback", "receive"}


def pairs_of(file: str | None, project: str | None, src: str) -> Iterator[tuple]:
    parts = sol.spans(src)
    code = sol.code_view(src, parts)
    decls = [d for d in sol.declarations(code) if d.kind in _KINDS]
    docs = sol.doc_units(src, parts)
    for d, doc in zip(decls, sol.attach(decls, docs, code)):
        if doc is None:
            continue
        found = sol.tags(sol.strip_markers(src, doc))
        text = sol.description(found)
        if sol.is_trivial(text, d.name):
            continue
        header = " ".join(src[d.start : d.header_end].split())
        yield (
            file, project, d.container or None, d.kind, d.name, d.start, d.end, header, d.has_body, doc.start, doc.end, text,
            [{"tag": a, "text": b} for a, b in found], src[d.start : d.end], src[doc.start : doc.end],
        )


def _parsed(files: DataFrame, at: Column) -> DataFrame:
    """The pairs of every row of ``files`` that has text, with the row's ``at``, a number."""
    schema = pa.schema([*_ARROW, ("at", pa.int64())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for f, p, s, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows.extend((*r, t) for r in pairs_of(f, p, s))
                if len(rows) > 2000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return _with_text(files).select("file", "project", "src", at.cast("long").alias("at")).mapInArrow(run, PAIR_SCHEMA + ", at long")


def _with_text(files: DataFrame) -> DataFrame:
    return files.where(F.col("src").isNotNull() & (F.length(F.trim("src")) > 0))


def documented_functions(files: DataFrame) -> DataFrame:
    """Code-description pairs of Solidity files.

    Needs ``file``, ``project`` and ``src``; other columns are ignored. A row per documented declaration of
    each row of ``files``. A null, empty or blank ``src`` gives no rows; text that does not parse gives what
    stands before the broken part. A file fetched again gives its rows again. A null ``file`` is one file of
    its own. An empty table gives an empty result.
    """
    return _parsed(files, F.lit(0)).drop("at")


def pairs_once(files: DataFrame) -> DataFrame:
    """The pairs of each file as last fetched, each once.

    Needs ``fetched_at``, too. Where a file's text changed, its latest fetch counts (a null time is the
    earliest); of fetches at one time, each declaration is taken once. Files are compared by name and time,
    their texts stay where they are.
    """
    at = F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-(1 << 62)))
    newest = _with_text(files).groupBy(F.col("file").alias("f")).agg(F.max(at).alias("newest"))
    pairs = _parsed(files, at).join(newest, F.col("file").eqNullSafe(F.col("f")) & (F.col("at") == F.col("newest")), "left_semi")
    return pairs.drop("at").dropDuplicates(["file", "code_start"])


def found(files: DataFrame) -> DataFrame:
    """(file, code_start) of every documented declaration, once."""
    return documented_functions(files).select("file", "code_start").distinct()
