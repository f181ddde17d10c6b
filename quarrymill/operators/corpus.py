"""Operators on the pair corpus: splits, leakage, crosstabs, length profiles, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_prose


def clean_split(c: str = "split") -> Column:
    return F.lower(F.trim(c))


#: Folders and names of files that are not the project's own.
VENDORED_FOLDER = r"(?i)(^|/)(node_modules|packages|external|vendor|lib|mocks?|tests?|test|echidna|scripts)(/|$)"
VENDORED_NAME = r"(^|/)(Mock|Test)[A-Z0-9_]"
KINDS = "function constructor fallback receive modifier event error".split()


def is_vendored(file: Column) -> Column:
    return file.rlike(VENDORED_FOLDER) | file.rlike(VENDORED_NAME)


def is_candidate(kind: str = "kind") -> Column:
    """Whether a declaration of this kind can be documented."""
    return F.col(kind).isin(*KINDS)


def in_scope(pairs: DataFrame, split: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Pairs of a split (all if None) and of some kinds; an unknown kind is an error."""
    unknown = sorted(set(kinds or []) - set(KINDS))
    if unknown:
        raise ValueError(f"no such kinds: {unknown}")
    out = pairs if split is None else pairs.where(clean_split() == split)
    return out.where(F.col("kind").isin(*kinds)) if kinds is not None else out


def assign_split(files: DataFrame, members: DataFrame) -> DataFrame:
    """``files`` (``file``, ``project``, ``role``) with the ``split`` of their project (``members``: ``project``, ``split``); dependencies and files of unknown projects are ``excluded``."""
    m = members.groupBy("project").agg(F.min("split").alias("split"))
    return files.join(m, "project", "left").withColumn("split", F.when(F.col("role") == "dependency", "excluded").otherwise(F.coalesce("split", F.lit("excluded"))))


def project_split(df: DataFrame, project: str = "project", shares: tuple[int, int, int] = (80, 10, 10)) -> DataFrame:
    """A split per project by hash, so no project is in two; the same on every run and partitioning."""
    h = F.conv(F.substring(F.sha1(F.col(project)), 1, 8), 16, 10).cast("long") % 100
    s = F.when(h < shares[0], "train").when(h < shares[0] + shares[1], "val").otherwise("test")
    return df.select(project).distinct().select(project, s.alias("split"))


def defect_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode("defects").alias("x")).groupBy(F.substring_index("x", ":", 1).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


def kind_crosstab(pairs: DataFrame, kinds: list[str]) -> DataFrame:
    return pairs.groupBy(F.coalesce(clean_split(), F.lit("none")).alias("split_name")).pivot("kind", kinds).agg(F.count(F.lit(1))).fillna(0)


def leaked(pairs: DataFrame) -> DataFrame:
    """Evaluation pairs whose notice, but for blanks and case, is a notice or dev of training: a semi join."""
    s = clean_split()
    train = pairs.where(s == "train").select(F.explode(F.array("notice", "dev")).alias("t")).select(norm_prose(F.col("t")).alias("k")).where("k <> ''").distinct()
    ev = pairs.where(s.isin("val", "test")).select("id", clean_split().alias("split"), norm_prose(F.col("notice")).alias("k")).where("k <> ''")
    return ev.join(train, "k", "left_semi").select("id", "split")


def length_profile(df: DataFrame, text: str, by: str) -> DataFrame:
    """Words per text: mean, median, and the 10th and 90th by position, from counts per length instead of sorted lists."""
    from pyspark.sql import Window

    n = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    cells = df.where(F.col(text).isNotNull()).select(by, n.alias("w")).where("w > 0").groupBy(by, "w").agg(F.count(F.lit(1)).alias("k"))
    run = F.sum("k").over(Window.partitionBy(by).orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    c = cells.withColumn("upto", run).withColumn("n", F.sum("k").over(Window.partitionBy(by)))
    low = F.greatest(F.lit(0), F.floor(F.col("n") * 0.10) - 1)
    high = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.90))
    return c.groupBy(by).agg(
        F.max("n").alias("n"), (F.sum(F.col("w") * F.col("k")) / F.max("n")).alias("mean"),
        F.min(F.when(F.col("upto") > low, F.col("w"))).alias("p10"), F.min(F.when(F.col("upto") > high, F.col("w"))).alias("p90"),
    )


def reference_fields() -> Column:
    """notice, dev, param:<name> and return:<i> of a pair in one map; blank texts are left out, a return is its name and text."""
    base = F.create_map(F.lit("notice"), F.col("notice"), F.lit("dev"), F.col("dev"))
    params = F.transform_keys(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("param:"), k))
    rets = F.map_from_entries(F.transform(F.coalesce("returns", F.array().cast("array<struct<name:string,text:string>>")), lambda r, i: F.struct(F.concat(F.lit("return:"), i.cast("string")), F.trim(F.concat_ws(" ", r["name"], r["text"])))))
    return F.map_filter(F.map_concat(base, params, rets), lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")


def canonical_text(fields: Column) -> Column:
    """Fields joined as notice, dev, parameters by name, returns by number."""
    head = lambda k: F.substring_index(k, ":", 1)
    rest = lambda k: F.when(F.contains(k, F.lit(":")), F.regexp_replace(k, "^[^:]*:", "")).otherwise(F.lit(""))
    order = lambda k: F.when(head(k) == "notice", 0).when(head(k) == "dev", 1).when(head(k) == "param", 2).when(head(k) == "return", 3).otherwise(9)
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(order(e["key"]), F.when(rest(e["key"]).rlike("^[0-9]+$"), rest(e["key"]).cast("int")).otherwise(0), rest(e["key"]), F.trim(e["value"]).alias("v")))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["v"]), " ")
