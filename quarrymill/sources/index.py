"""An index of source files and their functions, kept up to date file by file; and a cache of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solidity
from ..functions.text import code_tokens, exact_key

FUNCTIONS = "file string, contract string, name string, nparams int, sig string, start int, end int, text string, problem string"
_KINDS = pa.schema(
    [("file", pa.string()), ("contract", pa.string()), ("name", pa.string()), ("nparams", pa.int32()), ("sig", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("problem", pa.string())]
)


def functions_of(file: str | None, src: str) -> list[tuple]:
    """Functions with a body: their place, and their text with comments as blanks."""
    parts = solidity.spans(src)
    code = solidity.code_view(src, parts)
    bare = "".join(src[a:b] if kind in ("code", "string") else "".join(c if c in "\r\n" else " " for c in src[a:b]) for kind, a, b in parts)
    out = []
    for d in solidity.declarations(code):
        if d.kind == "function" and d.has_body:
            h = solidity.header(code, d)
            out.append((file, d.container or None, d.name, len(h.params), solidity.signature(d, h), d.start, d.end, bare[d.start : d.end], None))
    return out


def build(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, functions) of sources (``file``, ``src``), which have one row per file.

    files: ``file``, ``sha1``, ``nfuncs``, ``problem``; functions: ``file``, ``contract``, ``name``,
    ``nparams``, ``sig``, ``start``, ``end``, ``ekey``, ``bkey``, ``ntok``. A file that cannot be read
    stays in files with its ``problem`` and without functions; a null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += functions_of(f, s or "")
                except (ValueError, RecursionError, IndexError) as e:
                    rows.append((f, *[None] * 7, f"{type(e).__name__}: {e}"[:200]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _KINDS)], schema=_KINDS)

    found = sources.select("file", "src").mapInArrow(run, FUNCTIONS)
    keys = found.where("problem is null").select(
        "file", "contract", "name", "nparams", "sig", "start", "end", exact_key(F.col("text")).alias("ekey"), F.concat_ws("/", "name", F.col("nparams").cast("string")).alias("bkey"), F.size(code_tokens(F.col("text"))).alias("ntok")
    )
    per = found.groupBy("file").agg(F.count_if(F.col("problem").isNull()).alias("nfuncs"), F.max("problem").alias("problem"))
    files = sources.select("file", F.sha1(F.coalesce("src", F.lit(""))).alias("sha1")).join(per, "file", "left").withColumn("nfuncs", F.coalesce("nfuncs", F.lit(0)))
    return files.select("file", "sha1", "nfuncs", "problem"), keys


def changed(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that an index does not have, or has with another text."""
    return sources.withColumn("sha1", F.sha1(F.coalesce("src", F.lit("")))).join(files.select("file", "sha1"), ["file", "sha1"], "left_anti").drop("sha1")


def refresh(sources: DataFrame, files: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index with what has changed in ``sources`` replaced; only that is read again, files that are not among the sources stay."""
    new = changed(sources, files)
    more_files, more_functions = build(new)
    gone = new.select("file")
    return files.join(gone, "file", "left_anti").unionByName(more_files), functions.join(gone, "file", "left_anti").unionByName(more_functions)


def summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("nfuncs"), F.lit(0)).alias("functions"), F.count("problem").alias("unreadable"))


# calls ---------------------------------------------------------------------------------------------------------------


def call_key(request: Column) -> Column:
    """Digest of a request, a map: its entries in the order of their keys, nulls marked, so that the order in which it was written does not count."""
    entry = lambda e: F.concat(e["key"], F.lit("\x1f"), F.coalesce(e["value"], F.lit("\x00")))
    return F.sha1(F.array_join(F.transform(F.array_sort(F.map_entries(request)), entry), "\x1e"))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (``request``, a map): hits with the stored ``reply``, misses once per key."""
    keyed = requests.withColumn("key", call_key(F.col("request")))
    stored = cache.groupBy("key").agg(F.min("reply").alias("reply"))
    missed = keyed.join(stored.select("key"), "key", "left_anti")
    return keyed.join(stored, "key"), missed.dropDuplicates(["key"])


def put(cache: DataFrame, replies: DataFrame) -> DataFrame:
    """A cache with replies (``key``, ``reply``) it does not have; what it has stays."""
    return cache.select("key", "reply").unionByName(replies.select("key", "reply").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
