"""Inherited documentation: following ``inheritdoc`` from declaration to declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def chains(decls: DataFrame, max_hops: int = 8) -> DataFrame:
    """(``id``, ``target``, ``state``, ``hops``) of every declaration that inherits its text.

    Needs ``id``, ``container``, ``signature``, ``arity_key`` and ``inheritdoc``, one row per ``id``. A hop
    goes from a declaration to the one of the named container with the same signature (of several the least
    id), else to the only one there with its arity key. ``resolved``: ``target`` has text of its own.
    ``unresolved``: a hop leads nowhere, ``target`` is null. ``cycle``: the chain comes back to a hop it
    has made. ``deep``: more than ``max_hops`` hops. A null or empty container is the target of no hop.
    """
    own = decls.where("coalesce(container, '') <> ''")
    same = own.groupBy("container", "signature").agg(F.min("id").alias("by_signature"))
    only = own.groupBy("container", "arity_key").agg(F.min("id").alias("by_arity"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    asks = decls.where("inheritdoc is not null").select("id", F.col("inheritdoc").alias("container"), "signature", "arity_key")
    hop = asks.join(same, ["container", "signature"], "left").join(only, ["container", "arity_key"], "left")
    # one step per declaration, computed once
    hop = cut(hop.select(F.col("id").alias("cur"), F.concat_ws("|", "container", "signature").alias("made"), F.coalesce("by_signature", "by_arity").alias("next")))
    going = hop.select(F.col("cur").alias("id"), "cur", F.array().cast("array<string>").alias("path"))
    done = None
    for hops in range(1, max_hops + 2):
        step = going.join(hop, "cur", "left")
        state = (
            F.when(F.col("made").isNull(), "resolved").when(F.array_contains("path", F.col("made")), "cycle").when(F.lit(hops > max_hops), "deep").when(F.col("next").isNull(), "unresolved")
        )
        step = cut(step.select("id", "cur", "next", "path", "made", state.alias("state")))
        target = F.when(F.col("state") == "unresolved", F.lit(None).cast("string")).otherwise(F.col("cur"))
        ended = step.where("state is not null").select("id", target.alias("target"), "state", F.lit(hops - 1).alias("hops"))
        done = ended if done is None else done.unionByName(ended)
        going = step.where("state is null").select("id", F.col("next").alias("cur"), F.array_append("path", F.col("made")).alias("path"))
        if going.isEmpty():
            break
    return done


def broken(chain: DataFrame) -> DataFrame:
    """Chains that must not be: cycles and those that are too deep."""
    return chain.where(F.col("state").isin("cycle", "deep"))
