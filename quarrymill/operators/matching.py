"""Exact, then bucketed fuzzy matching with a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, exact_key, jaccard, shingles
from ..session import cut

#: Least likeness, least lead over the second best, length band, and the candidates of a query up to which each is compared.
THRESHOLD, MARGIN, BAND, CROWD = 0.85, 0.05, (0.6, 1.6), 400


def header_key(code: Column) -> Column:
    """``name/parameters`` of a function's header, null for anything else; commas inside brackets do not count."""
    flat = F.regexp_extract(code, r"(?s)^\s*function\s+([A-Za-z_$][\w$]*)\s*\(((?:[^()]|\([^()]*\))*)\)", 2)
    name = F.regexp_extract(code, r"(?s)^\s*function\s+([A-Za-z_$][\w$]*)\s*\(((?:[^()]|\([^()]*\))*)\)", 1)
    inner = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]", "")
    n = F.when(F.trim(flat) == "", 0).otherwise(F.size(F.split(inner, ",")))
    return F.when(name != "", F.concat(name, F.lit("/"), n.cast("string")))


def _prefixes(sets: DataFrame, ranks: DataFrame, name: str, floor: float) -> DataFrame:
    """(``bkey``, ``s``, ``name``, ``n``, ``size``): the rarest shingles of each set, one more than a set of likeness ``floor`` may lack."""
    each = sets.select("bkey", name, F.explode("shingles").alias("s")).join(ranks, ["bkey", "s"], "left")
    ordered = each.groupBy("bkey", name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "s"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * F.lit(max(floor, 0.0))).cast("int") + 1
    sizes = sets.select("bkey", name, "n", F.size("shingles").alias("size"))
    return ordered.select("bkey", name, F.explode(F.slice("o", F.lit(1), keep)["s"]).alias("s")).join(sizes, ["bkey", name])


def match(queries: DataFrame, index: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, crowd: int = CROWD) -> DataFrame:
    """(query_id, how, target_id, score, candidates): every query once.

    Both sides need ``id`` and ``code``. First by equal text but for blanks (the least id wins); the rest by
    the header bucket, within the length band, by likeness of token trigrams (their 64-bit hashes). A best
    that does not lead by the margin is no match; copies of it are as good, so they leave no lead.
    ``candidates`` counts the index rows of the bucket within the band. Up to ``crowd`` of them are compared
    one by one. Of more, those are compared that share one of their rarest shingles with the query: all
    that could win or take the lead from the best are among them, so both ways give the same. A query
    without a match is ``crowded`` if it has more than ``crowd`` candidates, else ``none``.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    q = queries.select(F.col("id").alias("query_id"), "code").withColumn("ekey", exact_key(F.col("code"))).withColumn("bkey", header_key(F.col("code")))
    t = index.select(F.col("id").alias("target_id"), "code").withColumn("ekey", exact_key(F.col("code"))).withColumn("bkey", header_key(F.col("code")))
    first = t.groupBy("ekey").agg(F.min("target_id").alias("target_id"), F.count(F.lit(1)).alias("candidates"))
    exact = q.join(first, "ekey").select("query_id", F.lit("exact").alias("how"), "target_id", F.lit(1.0).alias("score"), "candidates")
    rest = q.join(t.select("ekey").distinct(), "ekey", "left_anti")
    hashed = F.array_sort(F.transform(shingles(F.col("tokens")), lambda s: F.xxhash64(s)))
    body = lambda d: d.withColumn("tokens", code_tokens(F.col("code"))).withColumn("n", F.size("tokens")).withColumn("shingles", hashed).drop("code", "tokens", "ekey")
    # rows of equal length and shingles are compared once
    there = cut(body(t.where("bkey is not null")).groupBy("bkey", "n", "shingles").agg(F.max("target_id").alias("target_id"), F.count(F.lit(1)).alias("copies")))
    rest = cut(body(rest).withColumn("qkey", F.md5(F.array_join(F.transform("shingles", lambda s: s.cast("string")), ","))))
    band = F.col("tn").between(BAND[0] * F.col("n"), BAND[1] * F.col("n"))
    lengths = there.groupBy("bkey", F.col("n").alias("tn")).agg(F.sum("copies").alias("k"))
    sizes = rest.select("bkey", "n").distinct().join(lengths, "bkey").where(band).groupBy("bkey", "n").agg(F.sum("k").alias("candidates"))
    rest = rest.join(sizes, ["bkey", "n"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    asked = rest.where("candidates > 0").groupBy("bkey", "n", "qkey").agg(F.first("shingles").alias("shingles"), F.first("candidates").alias("candidates")).withColumn("asked", F.concat_ws("/", "n", "qkey"))
    targets = there.withColumnsRenamed({"n": "tn", "shingles": "ts"})
    near = asked.where(F.col("candidates") <= crowd).join(targets, "bkey").where(band).select("bkey", "asked", "target_id", "copies", "shingles", "ts")
    # below this likeness a candidate neither wins nor takes the lead
    floor = threshold - margin - 1e-9
    many = asked.where(F.col("candidates") > crowd)
    among = there.join(many.select("bkey").distinct(), "bkey", "left_semi")
    ranks = among.select("bkey", F.explode("shingles").alias("s")).groupBy("bkey", "s").agg(F.count(F.lit(1)).alias("rank"))
    right = _prefixes(among, ranks, "target_id", floor).withColumnsRenamed({"n": "tn", "size": "tsize"})
    meet = _prefixes(many, ranks, "asked", floor).join(right, ["bkey", "s"]).where(band & (F.col("tsize") >= floor * F.col("size")) & (F.col("size") >= floor * F.col("tsize")))
    met = meet.select("bkey", "asked", "target_id").distinct().join(many.select("bkey", "asked", "shingles"), ["bkey", "asked"]).join(targets.select("bkey", "target_id", "copies", "ts"), ["bkey", "target_id"])
    near = near.unionByName(met.select(*near.columns))
    scored = near.select("bkey", "asked", "target_id", "copies", jaccard(F.col("shingles"), F.col("ts")).alias("score"))
    w = Window.partitionBy("bkey", "asked").orderBy(F.desc("score"), F.desc("target_id"))
    two = scored.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best = two.groupBy("bkey", "asked").agg(F.max(F.when(F.col("rn") == 1, F.struct("target_id", "score", "copies"))).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    best = best.select("bkey", "asked", "b.target_id", "b.score", F.when(F.col("b.copies") > 1, F.col("b.score")).otherwise(F.coalesce("second", F.lit(0.0))).alias("second"))
    best = best.where((F.col("score") >= threshold) & (F.col("score") - F.col("second") >= margin)).drop("second")
    fuzzy = rest.withColumn("asked", F.concat_ws("/", "n", "qkey")).join(best, ["bkey", "asked"], "left")
    how = F.when(F.col("target_id").isNotNull(), "fuzzy").when(F.col("candidates") > crowd, "crowded").otherwise("none")
    return exact.unionByName(fuzzy.select("query_id", how.alias("how"), "target_id", "score", "candidates"))
