"""Incremental and versioned tables on plain Parquet."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def fresh(new: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not there yet."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def append_new(spark: SparkSession, new: DataFrame, path: str, *keys: str) -> int:
    """Appends rows whose keys the table lacks; a second run adds none. Gives the number added, counted while they are written."""
    new = new.dropDuplicates(list(keys))
    if _exists(spark, path):
        new = fresh(new, spark.read.parquet(path), *keys)
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert(old: DataFrame, new: DataFrame, key: str, sha: str) -> DataFrame:
    """``old`` with the rows of every changed key replaced: keys with equal ``sha`` stay, others come from ``new``."""
    changed = new.join(old.select(key, sha).distinct(), [key, sha], "left_anti")
    kept = old.join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changed)


def drop_errors(df: DataFrame, error: str = "error") -> DataFrame:
    return df.where(F.coalesce(F.col(error), F.lit("")) == "")


def next_version(spark: SparkSession, root: str) -> int:
    """One more than the greatest ``v<number>`` below ``root``."""
    if not _exists(spark, root):
        return 1
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return max([0, *(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))]) + 1


def write_version(df: DataFrame, root: str, refuse_empty: bool = True) -> str:
    """Writes the next version and gives its path; an empty result never becomes a version of a table that has one."""
    spark = df.sparkSession
    v = next_version(spark, root)
    if refuse_empty and v > 1 and df.isEmpty():
        raise ValueError("an empty result would replace a good one")
    path = f"{root}/v{v}"
    df.write.parquet(path)
    return path


def ledger_row(spark: SparkSession, run: int, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(run, datetime.now(UTC).isoformat(timespec="seconds"), files)], "run int, at string, files map<string,string>")


def call_key(*parts: Column) -> Column:
    """Digest of a call's parts in their order; nulls are marked, so they differ from empty texts."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))


def tree_digest(files: DataFrame, folders: int = 4096) -> DataFrame:
    """One digest of sorted paths and contents (``file``, ``sha1``), by way of one per bucket of paths, so that no task sees all files but for a digest of each bucket."""
    bucket = F.pmod(F.xxhash64("file"), F.lit(folders)).cast("int").alias("bucket")
    lines = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda r: F.concat_ws(" ", *(r[x].cast("string") for x in c))), "\n")
    per = files.groupBy(bucket).agg(F.sha1(lines("file", "sha1")).alias("part"))
    return per.agg(F.sha1(lines("bucket", "part")).alias("digest"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; nulls are written, so that every line has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def shard_key(source: Column, tool: str) -> Column:
    """Name of a shard: a digest of its content and of what made it, so that neither change finds an old shard."""
    return F.sha1(F.concat_ws("\x1f", F.lit(tool), F.coalesce(source, F.lit("\x00"))))


def unsharded(spark: SparkSession, sources: DataFrame, path: str, tool: str) -> DataFrame:
    """Sources (``src``) whose shard is not in the cache at ``path`` yet, with its ``shard``."""
    keyed = sources.withColumn("shard", shard_key(F.col("src"), tool))
    return fresh(keyed, spark.read.parquet(path), "shard") if _exists(spark, path) else keyed


def index_view(ledger: DataFrame) -> DataFrame:
    """The latest run of every file that a ledger (``run``, ``at``, ``files``) names: ``file``, ``path``, ``run``, ``at``."""
    each = ledger.select("run", "at", F.explode("files").alias("file", "path"))
    return each.groupBy("file").agg(F.max(F.struct("run", "at", "path")).alias("r")).select("file", "r.path", "r.run", "r.at")
