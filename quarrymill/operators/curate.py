"""Putting corpora together: promotion, staging, samples, run matrices, calibration and donor trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates


def pair_key() -> Column:
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("project", "container", "signature")))


def promote(verified: DataFrame, partial: DataFrame, keys: DataFrame, split: str) -> DataFrame:
    """Verified pairs, and those partial ones whose key is wanted and whose id is not there yet (``promoted``).

    Both have ``id``, ``project``, ``container`` and ``signature``; ``keys`` has ``key``. Pairs with a wanted
    key get ``split``, all others ``excluded``, which no stage reads.
    """
    want = keys.select("key").where("key is not null").distinct().withColumn("wanted", F.lit(True))
    more = partial.withColumn("key", pair_key()).join(want.select("key"), "key", "left_semi").join(verified.select("id"), "id", "left_anti")
    both = verified.withColumn("key", pair_key()).withColumn("promoted", F.lit(False)).unionByName(more.withColumn("promoted", F.lit(True)), allowMissingColumns=True)
    return both.join(want, "key", "left").withColumn("split", F.when(F.col("wanted"), split).otherwise("excluded")).drop("key", "wanted")


def allow_list(pairs: DataFrame, never: DataFrame) -> DataFrame:
    """Files that may be retrieved: those with training pairs, but for those with evaluation pairs and those in ``never`` (``file``): what is not allowed is denied."""
    s = F.lower(F.trim("split"))
    train, ev = (pairs.where(c).select("file").distinct() for c in (s == "train", s.isin("val", "test")))
    return train.join(ev, "file", "left_anti").join(never.select("file"), "file", "left_anti")


def stage(matched: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(placed, clashes) of matched functions: every file becomes a project of its own, numbered in the order of names with five digits.

    ``matched`` has ``file``, ``contract``, ``sig`` and ``index``. Of two with one key the first by index is
    placed, the others are clashes. Only the list of files is numbered in one place.
    """
    n = F.row_number().over(Window.orderBy("file")) - 1
    slug = matched.select("file").distinct().withColumn("project", F.format_string(f"{prefix}-%05d", n))
    keyed = matched.join(slug, "file").withColumn("key", F.concat_ws("|", "project", "contract", "sig"))
    first = keyed.groupBy("key").agg(F.min("index").alias("index")).withColumn("first", F.lit(True))
    both = keyed.join(first, ["key", "index"], "left")
    return both.where("first").drop("first"), both.where("first is null").drop("first")


def aligned_pairs(lines: DataFrame, declared: Column, prefix: str) -> DataFrame:
    """Pairs from lines of code and text side by side (``line``, ``code``, ``text``); a line whose code has no function (``declared``, see ``solidity.declared``) is dropped.

    A pair's id is the prefix and its line in four digits; the first declaration of a line counts.
    """
    x = lines.select("line", F.trim("code").alias("code"), F.trim("text").alias("notice"), F.get(declared, 0).alias("d")).where("d is not null and d.kind = 'function'")
    return x.select(F.format_string(f"{prefix}%04d", "line").alias("id"), "line", "d.name", "d.signature", "d.arity_key", F.coalesce("d.visibility", F.lit("public")).alias("visibility"), "d.mutability", "notice", "code")


def round_trip(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs (``index``, ``notice``) whose text is not that of the reference of their index, blanks aside, and those without one."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    j = pairs.select("index", "notice").join(references.select("index", "reference"), "index", "left")
    return j.where(F.col("reference").isNull() | (flat(F.col("notice")) != flat(F.col("reference"))))


# samples -----------------------------------------------------------------------------------------------------------


def hash_order(df: DataFrame, key: str, seed: int) -> Column:
    """The order of a seeded shuffle: a digest of the seed and the key."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values that occur most, ties by the lesser value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def gated_first(pairs: DataFrame, k: int, all_gates: Column, line: str = "line") -> DataFrame:
    """A sample of ``k``, the feature: functions with a caller gate first, in order, then every step-th of the others; all if there are no more.

    The counts are taken first, so only rows that can be in the sample are ranked.
    """
    x = pairs.withColumn("gated", F.size(gates.caller_gates(all_gates)) > 0)
    n = {r["gated"]: r["n"] for r in x.groupBy("gated").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    g, rest = n.get(True, 0), n.get(False, 0)
    if k >= g + rest:
        return x.drop("gated").orderBy(line)
    take = x.where("gated").orderBy(line).limit(k).drop("gated")
    if g < k and rest:
        step = max(1, rest // max(k - g, 1))
        others = x.where("not gated").orderBy(line).drop("gated").limit(step * (k - g))  # the rows up to the last one taken
        ranked = others.withColumn("rn", F.row_number().over(Window.orderBy(line)) - 1).where(F.col("rn") % step == 0).drop("rn")
        take = take.unionByName(ranked.orderBy(line).limit(k - g))
    return take.orderBy(line)


def matrix(configs: DataFrame, seeds: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Every configuration with every seed, without those that are ``done``; both are short lists."""
    every = configs.crossJoin(F.broadcast(seeds))
    return every if done is None else every.join(done.select("config", "seed").distinct(), ["config", "seed"], "left_anti")


def resolves(wanted: Column, tags: Column) -> Column:
    """Whether a model slot is served: its tag as it is, or, of a bare name, any tag of that name."""
    return F.array_contains(tags, wanted) | ~F.contains(wanted, F.lit(":")) & F.exists(tags, lambda t: F.substring_index(t, ":", 1) == wanted)


# calibration ----------------------------------------------------------------------------------------------------------


def calibration(partial: DataFrame, verified: DataFrame) -> DataFrame:
    """Per family of labelled defects the share of records in which the critic fired (``n``, ``recall``), and a row ``verified`` with its false positives.

    Both have ``reported``, an array of structs with ``severity``; ``partial`` has ``defects``, too. Among
    verified records only findings of high or medium severity count.
    """
    fired = F.coalesce(F.size("reported"), F.lit(0)) > 0
    family = partial.select(F.explode("defects").alias("d"), fired.alias("hit")).groupBy(F.substring_index("d", ":", 1).alias("family"))
    grave = F.coalesce(F.exists("reported", lambda r: r["severity"].isin("high", "medium")), F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("int")), 3).alias("recall")
    false = verified.agg(F.count(F.lit(1)).alias("n"), share(grave)).select(F.lit("verified").alias("family"), "n", "recall")
    return family.agg(F.count(F.lit(1)).alias("n"), share(F.col("hit"))).unionByName(false)


def stability(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Of verdicts on the same claims read in two orders (``id``, ``claim``, ``verdict``): ``compared``, ``agreement`` (null of none) and ``met``, 0.9 or more."""
    j = forward.select("id", "claim", F.col("verdict").alias("a")).join(backward.select("id", "claim", F.col("verdict").alias("b")), ["id", "claim"])
    return j.agg(F.count(F.lit(1)).alias("compared"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 3).alias("agreement")).withColumn("met", F.coalesce(F.col("agreement") >= 0.9, F.lit(False)))


# donor trees --------------------------------------------------------------------------------------------------------------


def split_spec() -> tuple[Column, Column]:
    """(package, path below it) of an import ``spec``: a scope and a name, or the first part."""
    package = F.regexp_extract("spec", r"^(@[^/]*/[^/]*/(?=.)|[^/]*/?)", 1)
    return F.when(package.endswith("/"), package).otherwise(F.concat(package, F.lit("/"))), F.substring(F.col("spec"), F.length(package) + 1, F.length("spec"))


def donor_trees(specs: DataFrame, donors: DataFrame, keep: int = 4) -> DataFrame:
    """(``package``, ``root``, ``version``, ``files``): per package the roots among ``donors`` (``path``, ``version``) that have most of the wanted files.

    A root is what is left of a path without the wanted one at its end. Of one version (the most frequent
    among a root's files, null if none) the best root stays; of versions the ``keep`` best, as the operator
    means it. Paths are compared by equality with the ends of donors' paths.
    """
    package, rest = split_spec()
    want = specs.select(package.alias("package"), rest.alias("rest")).where("rest <> ''").distinct()
    parts = F.split("path", "/")
    ends = donors.select("path", "version", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("rest"))
    hit = ends.join(want, "rest").withColumn("root", F.expr("substring(path, 1, length(path) - length(rest))")).where("root <> ''")
    version = hit.where("version is not null").groupBy("package", "root", "version").agg(F.count(F.lit(1)).alias("k"))
    top = version.groupBy("package", "root").agg(F.max(F.struct("k", "version")).alias("v")).select("package", "root", "v.version")
    size = hit.groupBy("package", "root").agg(F.count_distinct("rest").alias("files")).join(top, ["package", "root"], "left")
    best = size.groupBy("package", "version").agg(F.min(F.struct((-F.col("files")).alias("n"), "root", "files")).alias("b")).select("package", "version", "b.root", "b.files")
    w = Window.partitionBy("package").orderBy(F.desc("files"), "root")  # one row per version
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")
