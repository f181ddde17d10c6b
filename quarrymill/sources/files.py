"""Scans of text and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_sources(spark: SparkSession, root: str, pattern: str = "*.sol") -> DataFrame:
    """``file`` (path below ``root``) and ``src`` of every file, byte for byte: bad UTF-8 is replaced, line ends stay."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in base) + "/", "")
    return raw.select(rel.alias("file"), F.expr("make_valid_utf8(cast(content as string))").alias("src"), F.sha1("content").alias("sha1"), F.col("length").alias("bytes"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, ``tolerant`` also drops broken ones (a half-written last line)."""
    return (
        spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 0) and ``text`` of one file, in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line", "text"))


def aligned_lines(spark: SparkSession, paths: dict[str, str], strict: bool = True) -> DataFrame:
    """Lines of several files side by side by number. ``strict`` wants equal counts, else the shortest rules."""
    parts = {k: read_lines(spark, p).withColumnRenamed("text", k) for k, p in paths.items()}
    if strict:
        counts = {k: d.count() for k, d in parts.items()}
        if len(set(counts.values())) > 1:
            raise ValueError(f"line counts differ: {counts}")
    out = None
    for d in parts.values():
        out = d if out is None else out.join(d, "line")
    return out


def longest_prefix(specs: DataFrame, trees: DataFrame) -> DataFrame:
    """For each import ``spec`` the tree (``prefix``, ``tree``, ``priority``) with the longest matching prefix, then the least priority, then the least name.

    Every beginning of a spec is joined with the prefixes by equality, so characters mean themselves and any
    number of trees will do. A spec that no tree fits has nulls.
    """
    s = specs.select("spec").distinct()
    begin = F.transform(F.sequence(F.lit(0), F.length("spec")), lambda n: F.substring(F.col("spec"), F.lit(1), n))
    hit = s.where("spec is not null").select("spec", F.explode(begin).alias("prefix")).join(trees.select("prefix", "tree", "priority"), "prefix")
    best = hit.groupBy("spec").agg(F.min(F.struct((-F.length("prefix")).alias("n"), "priority", "tree", "prefix")).alias("b"))
    return specs.join(best.select("spec", "b.prefix", "b.tree", "b.priority"), "spec", "left")


def project_of(file: Column, slugs: list[tuple[str, str]]) -> Column:
    """The slug of the first (part, slug) whose part a file's folder has, in the order of the list; else the folder itself."""
    folder = F.split_part(file, F.lit("/"), F.lit(1))
    out = folder
    for part, slug in reversed(slugs):
        out = F.when(F.contains(F.lower(folder), F.lit(part.lower())), slug).otherwise(out)
    return out


def verify_lines(spark: SparkSession, wanted: dict[str, tuple[int, str | None]]) -> DataFrame:
    """(``path``, ``lines``, ``sha1``, ``ok``) of files against their count of lines and, if given, their digest. A file that is not there raises."""
    out = None
    for path, (count, sha) in wanted.items():
        whole = spark.read.format("binaryFile").load(path)
        text = F.expr("make_valid_utf8(cast(content as string))")
        n = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))
        one = whole.select(F.lit(path).alias("path"), n.alias("lines"), F.sha1("content").alias("sha1"))
        one = one.withColumn("ok", (F.col("lines") == count) & (F.lit(sha is None) | (F.col("sha1") == F.lit(sha))))
        out = one if out is None else out.unionByName(one)
    return out


def differing_lines(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(``line``, ``a``, ``b``) where two files differ; a line one of them lacks is null."""
    x, y = (read_lines(spark, p).withColumnRenamed("text", n) for p, n in ((a, "a"), (b, "b")))
    return x.join(y, "line", "full").where(~F.col("a").eqNullSafe(F.col("b")))
