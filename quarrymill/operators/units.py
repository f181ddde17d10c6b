"""Units of source files: imports, their targets, and everything an entry file needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed value: how a file names another.
IMPORT = r"""import\s+(?:[^;'"]*?\bfrom\s*)?["']([^"']+)["']"""


def imports(files: DataFrame) -> DataFrame:
    """(``file``, ``spec``) of every import in ``src``, once."""
    return files.where("src is not null").select("file", F.explode(F.regexp_extract_all("src", F.lit(IMPORT), F.lit(1))).alias("spec")).distinct()


def normal_path(path: Column) -> Column:
    """A path without ``.`` and empty parts, each ``..`` taken with the part before it; one without such a part stays."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    fold = lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def relative_target(file: Column, spec: Column) -> Column:
    """The path a relative import names; null for any other, which only a package could satisfy."""
    return F.when(spec.startswith("."), normal_path(F.concat(F.regexp_extract(file, "^(.*/)?[^/]*$", 1), spec)))


def resolve_relative(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(``file``, ``spec``, ``target``, ``present``) of imports: where they lead and whether that file is there."""
    at = wanted.withColumn("target", relative_target(F.col("file"), F.col("spec")))
    there = files.select(F.col("file").alias("target")).distinct().withColumn("there", F.lit(True))
    return at.join(there, "target", "left").select("file", "spec", "target", F.coalesce("there", F.lit(False)).alias("present"))


def with_vendor(wanted: DataFrame, files: DataFrame, trees: DataFrame, vendored: DataFrame) -> DataFrame:
    """(``file``, ``spec``, ``target``, ``tree``): relative imports in the corpus first, others in vendored trees.

    ``trees`` has ``prefix``, ``tree``, ``root``, ``minor`` and ``priority``; ``vendored`` has ``file`` (a
    tree's root and the path below it); ``wanted`` may have ``minor``, the pragma's. The longest prefix of the import that has a file
    wins, then a tree of the pragma's version, then the least priority. Prefixes are compared by equality with those of each
    import, so any number of trees will do. An import that nothing satisfies has a null target.
    """
    known = files.select(F.col("file").alias("target")).distinct()
    at = wanted.withColumn("target", relative_target(F.col("file"), F.col("spec"))).join(known.withColumn("here", F.lit(True)), "target", "left")
    inner = at.where("here").select("file", "spec", "target", F.lit(None).cast("string").alias("tree"))
    rest = at.where("here is null").drop("target", "here")
    minor = F.col("minor") if "minor" in wanted.columns else F.lit(None).cast("int")
    ends = F.array_distinct(F.concat(F.array(F.col("spec")), F.transform(F.sequence(F.lit(1), F.length("spec")), lambda n: F.substring(F.col("spec"), F.lit(1), n))))
    tried = rest.select("file", "spec", minor.alias("want"), F.explode(ends).alias("prefix")).join(trees, "prefix")
    tried = tried.withColumn("target", F.concat("root", F.substring("spec", F.length("prefix") + 1, F.length("spec"))))
    tried = tried.join(vendored.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    order = F.struct(-F.length("prefix"), F.when(F.col("minor") == F.col("want"), 0).otherwise(1), "priority", "tree", "target")
    best = tried.groupBy("file", "spec").agg(F.min(order).alias("b")).select("file", "spec", "b.target", "b.tree")
    return inner.unionByName(rest.select("file", "spec").join(best, ["file", "spec"], "left").select("file", "spec", "target", "tree"))


def closure(entries: DataFrame, files: DataFrame, resolver: DataFrame, wanted: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Units: (``entry``, ``files``, ``sources``, ``unresolved``, ``complete``, ``digest``).

    ``files`` has ``file`` and ``src``; ``wanted`` the imports; ``resolver`` (``file``, ``spec``, ``target``)
    says where they lead, and may be any table. A unit holds what its entry reaches; an import without a
    target, or whose target is no file, is unresolved. The digest is of the entry and of every path and
    text, by path. Entries that are no file have no unit. Only paths travel, texts are digested first.
    """
    have = files.where("src is not null").groupBy("file").agg(F.max(F.sha1("src")).alias("sha"))
    edge = wanted.join(resolver, ["file", "spec"], "left").select("file", "spec", "target")
    edge = edge.join(have.select(F.col("file").alias("target"), F.lit(True).alias("there")), "target", "left")
    edge = cut(edge.select("file", "spec", F.when(F.col("there"), F.col("target")).alias("target")))
    step = cut(edge.where("target is not null").select("file", "target").distinct())
    seen = cut(entries.select("entry").join(have.select(F.col("file").alias("entry")), "entry", "left_semi").distinct().withColumn("file", F.col("entry")))
    front, layers = seen, [seen]
    for _ in range(max_rounds):
        new = front.join(step, "file").select("entry", F.col("target").alias("file")).distinct()
        for layer in layers:
            new = new.join(layer, ["entry", "file"], "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        layers.append(front)
    else:
        raise RuntimeError(f"more than {max_rounds} steps")
    seen = layers[0]
    for layer in layers[1:]:
        seen = seen.unionByName(layer)
    lost = seen.join(edge.where("target is null"), "file").groupBy("entry").agg(F.array_sort(F.collect_set("spec")).alias("lost"))
    parts = seen.join(have, "file").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("file", "sha"))).alias("u"))
    text = F.concat("entry", F.array_join(F.transform("u", lambda r: F.concat(r["file"], r["sha"])), ""))
    unit = parts.join(lost, "entry", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    return unit.select("entry", F.transform("u", lambda r: r["file"]).alias("files"), F.size("u").cast("long").alias("sources"), F.size("lost").cast("long").alias("unresolved"), (F.size("lost") == 0).alias("complete"), F.sha1(text).alias("digest"), F.col("lost").alias("unresolved_specs"))
