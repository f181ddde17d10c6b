"""Vector search over several views, fusion and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that meet all units at once; more go through in further blocks.
QUERY_BLOCK = 4096


def top_k(units: DataFrame, queries: DataFrame, k: int, unit: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """Exact best ``k`` units per query by inner product; ties by the lesser unit.

    Queries are a stated set that goes over all units in blocks of ``QUERY_BLOCK``. Each partition keeps
    its own best, so k rows per query and partition are shuffled. Null vectors match nothing.
    """
    out = None
    block: list = []

    def scan(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], np.float64)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # query, score, unit
            for pdf in it:
                if not len(pdf):
                    continue
                u = pdf[unit].to_numpy()
                s = q @ np.stack(pdf[vector].to_numpy()).astype(np.float64).T
                if exclude_self:
                    s[ids[:, None] == u[None, :]] = -np.inf
                # only scores not below a query's k-th are sorted; that keeps all ties
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -np.inf)
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                r, x, y = (np.concatenate(p) for p in zip(best, (r, s[r, c], u[c])))
                order = np.lexsort((y, -x, r))
                r, x, y = r[order], x[order], y[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                best = r[keep], x[keep], y[keep]
            r, x, y = best
            yield pd.DataFrame({"query_id": ids[r], "unit_id": y, "score": x})

        return units.where(F.col(vector).isNotNull()).select(unit, vector).mapInPandas(run, "query_id long, unit_id long, score double")

    for r in queries.where(F.col(vector).isNotNull()).select(unit, vector).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part, block = scan(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = scan(block) if block else units.sparkSession.createDataFrame([], "query_id long, unit_id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(hits: DataFrame, weights: dict[str, float], k: int, tau: float | None = None) -> DataFrame:
    """Z-scores per query and view over the union of pools, weighted and added; ties by the lesser unit; then the threshold.

    ``hits`` is (query_id, view, unit_id, score). A view's lone score counts 0, deviations under 1e-9 divide
    by 1, a unit that a view did not return counts 0 there.
    """
    w = Window.partitionBy("query_id", "view")
    sd = F.stddev_pop("score").over(w)
    z = F.when(F.count(F.lit(1)).over(w) < 2, F.lit(0.0)).otherwise((F.col("score") - F.avg("score").over(w)) / F.when(sd > 1e-9, sd).otherwise(F.lit(1.0)))
    weight = F.coalesce(*(F.when(F.col("view") == v, F.lit(x)) for v, x in weights.items()), F.lit(0.0))
    fused = hits.withColumn("z", z * weight).groupBy("query_id", "unit_id").agg(F.sum("z").alias("fused"))
    top = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "unit_id"))).where(F.col("rank") <= k)
    return top.where(F.col("fused") >= tau) if tau is not None else top


def recall_at(hits: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of queries with a unit of their own label among the first k; queries without hits count as misses."""
    q = labels.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    u = labels.select(F.col("id").alias("unit_id"), F.col("label").alias("got"))
    good = hits.join(q, "query_id").join(u, "unit_id").withColumn("ok", F.col("want") == F.col("got"))
    per = good.groupBy("query_id").agg(*(F.max((F.col("ok") & (F.col("rank") <= k)).cast("int")).alias(f"r{k}") for k in ks))
    asked = hits.select("query_id").distinct()
    return asked.join(per, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), *(F.avg(F.coalesce(f"r{k}", F.lit(0))).alias(f"recall_at_{k}") for k in ks))
