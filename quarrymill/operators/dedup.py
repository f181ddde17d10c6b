"""Keeping one row of many: latest delivery, first by an order, exact groups. All by aggregation, so a hot key is combined before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key, norm_prose


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``at``; of ties the one with the greatest values."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *columns)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in (at, *columns)))


def newest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """As ``latest``, for columns that have no order, such as maps: of ties any one, whole."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("r"), F.max(at).alias(at))
    return best.select(key, at, *(F.col(f"r.{c}").alias(c) for c in columns))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group by ``order``, which must be total; columns ``keep`` of it."""
    names = [f"k{i}" for i in range(len(keys))]
    ranks = [c.alias(f"o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*(c.alias(n) for c, n in zip(keys, names))).agg(F.min(F.struct(*ranks, *keep)).alias("r"))
    return picked.select(*(F.col(f"r.{c}").alias(c) for c in keep))


def has_body(code: Column) -> Column:
    return F.contains(code, F.lit("{")) & F.rtrim(code).endswith("}")


def split_rank(split: Column) -> Column:
    s = F.lower(F.trim(split))
    return F.when(s == "test", 0).when(s == "val", 1).when(s == "train", 2).otherwise(3)


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with one signature and one normalised description, the first by split rank, body, file and offset."""
    text = norm_prose(F.concat_ws("|", F.coalesce("notice", F.lit("")), F.coalesce("dev", F.lit(""))))
    order = [split_rank(F.col("split")), F.when(has_body(F.col("code")), 0).otherwise(1), F.col("file"), F.col("code_start"), F.col("id")]
    return keep_first(pairs, [F.col("signature"), text], order, ["id", "project", "split"])


def exact_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """Groups of rows whose text is equal but for blanks: key, size, least id."""
    return df.where(F.col(text).isNotNull()).groupBy(exact_key(F.col(text)).alias("exact_key")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))
