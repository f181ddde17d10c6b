"""Paired statistics over (configuration, unit, score) tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..session import cut

#: Fixed sizes: differences in a packed row, differences that a task holds (a multiple of the former), resamples that it adds up.
PACK, HELD, TURN = 1 << 16, 1 << 22, 25


def paired(scores: DataFrame, baseline: str, config: str = "config", unit: str = "pair_id", score: str = "score") -> DataFrame:
    """(config, unit, x, y): each configuration's score beside the baseline's, on the units both have. Nulls do not pair."""
    s = scores.where(F.col(score).isNotNull()).groupBy(config, unit).agg(F.avg(score).alias("x"))
    base = s.where(F.col(config) == baseline).select(unit, F.col("x").alias("y"))
    return s.where(F.col(config) != baseline).join(base, unit)


def sign_ranks(pairs: DataFrame, config: str = "config") -> DataFrame:
    """Signed-rank sums per configuration: zero differences dropped, ties at their average rank.

    Ranks come from counts per distinct absolute difference, so only distinct values are windowed.
    """
    d = pairs.select(config, (F.col("x") - F.col("y")).alias("d")).where("d <> 0").select(config, F.round(F.abs("d"), 12).alias("a"), (F.col("d") > 0).alias("up"))
    cells = d.groupBy(config, "a").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("ups"))
    before = F.sum("n").over(Window.partitionBy(config).orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cells.withColumn("rank", F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2)
    return ranked.groupBy(config).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("ups"))).alias("w_minus")
    )


def wilcoxon(pairs: DataFrame, config: str = "config") -> DataFrame:
    """Two-sided signed-rank test by the normal approximation with continuity correction and no tie term in the variance."""

    @F.arrow_udf("double")
    def erfc(z: pa.Array) -> pa.Array:
        return pa.array([None if x is None else math.erfc(x / math.sqrt(2)) for x in z.to_pylist()], pa.float64())

    all_ = pairs.select(config).distinct()
    r = all_.join(sign_ranks(pairs, config), config, "left").fillna(0, ["n", "w_plus", "w_minus"])
    mean, sd = F.col("n") * (F.col("n") + 1) / 4, F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    z = F.try_divide(F.greatest(F.abs(F.least("w_plus", "w_minus") - mean) - 0.5, F.lit(0.0)), sd)
    return r.withColumn("p", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), erfc(z))))


def cliffs_delta(pairs: DataFrame, config: str = "config") -> DataFrame:
    """(pairs x > y minus pairs x < y) / n^2 per configuration, by cumulative counts over distinct values instead of a cross join."""
    v = pairs.select(config, F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("is_x")), F.struct(F.col("y").alias("v"), F.lit(0).alias("is_x")))).alias("s")).select(config, "s.*")
    cells = v.groupBy(config, "v").agg(F.sum("is_x").alias("nx"), F.sum(1 - F.col("is_x")).alias("ny"))
    w = Window.partitionBy(config).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("below", F.coalesce(F.sum("ny").over(w), F.lit(0)))
    t = c.groupBy(config).agg(F.sum(F.col("nx") * F.col("below")).alias("gt"), F.sum(F.col("nx") * F.col("ny")).alias("eq"), F.sum("nx").alias("n"))
    delta = (2 * F.col("gt") + F.col("eq") - F.col("n") * F.col("n")) / (F.col("n") * F.col("n"))
    a = F.abs("delta")
    size = F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")
    return t.select(config, F.col("n"), delta.alias("delta")).withColumn("magnitude", size)


def holm(tests: DataFrame, p: str = "p", key: str = "config", alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p and rejection; the first that is kept keeps all after it. One row per test, so one window is fine."""
    w = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    out = tests.withColumn("raw", raw)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("adjusted", F.max("raw").over(upto)).withColumn("reject", F.col("adjusted") <= alpha).drop("raw")


def seed_spread(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of per-seed means; one seed has deviation 0."""
    per = scores.where("score is not null").groupBy("config", "seed").agg(F.avg("score").alias("m"))
    return per.groupBy("config").agg(F.count(F.lit(1)).alias("seeds"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"))


def mcnemar(outcomes: DataFrame, config: str = "config") -> DataFrame:
    """Exact two-sided test on discordant outcomes; needs booleans ``x`` and ``y``."""

    def tail_of(b: int, c: int) -> float:
        n, k = b + c, min(b, c)
        if not n:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    @F.arrow_udf("double")
    def tail(b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(list(map(tail_of, b.to_pylist(), c.to_pylist())), pa.float64())

    t = outcomes.groupBy(config).agg(F.count_if(F.expr("x and not y")).alias("gained"), F.count_if(F.expr("y and not x")).alias("lost"))
    return t.withColumn("p", tail("gained", "lost"))


def paired_bootstrap(pairs: DataFrame, resamples: int = 2000, seed: int = 7, config: str = "config", unit: str = "pair_id", alpha: float = 0.05) -> DataFrame:
    """Mean difference per configuration and its bounds by resampling: (config, ``n``, ``diff``, ``low``, ``high``).

    Each resample draws n of the n units with replacement; draw j of resample r takes the unit at place
    ``md5(seed:r:j) mod n`` in the order of units, so results hang on the data and the seed alone. The bounds
    are the resampled means at positions alpha / 2 R and (1 - alpha / 2) R. No row is made for a draw: the
    differences go packed, in the order of units, to tasks that make the draws of some resamples and add up
    those that fall to the differences they hold.
    """
    d = cut(pairs.select(config, unit, (F.col("x") - F.col("y")).alias("d")))
    size = d.groupBy(config).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("diff"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("d").cast("double").alias("d")))), lambda v: v["d"])
    packed = _places(d, config, unit).groupBy(config, F.expr(f"place div {PACK}").alias("pack")).agg(in_order.alias("values"))
    turns = F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(TURN))).alias("first")
    held = packed.join(size.select(config, "n"), config).select(F.col(config).alias("config"), "n", F.expr(f"pack div {HELD // PACK}").alias("held"), "pack", "values", turns)
    keys = ["config", "held", "first"]
    fields = [T.StructField("config", pairs.schema[config].dataType), T.StructField("r", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("k", T.LongType())]
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the bytes of packed rows say little about the work
    sums = held.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_resampled(seed, resamples), T.StructType(fields))
    means = sums.groupBy(F.col("config").alias(config), "r").agg(F.try_divide(F.sum("total"), F.sum("k")).alias("m"))
    at = means.withColumn("k", F.row_number().over(Window.partitionBy(config).orderBy("m", "r")) - 1)  # as many rows as resamples
    low, high = int(alpha / 2 * resamples), min(int((1 - alpha / 2) * resamples), resamples - 1)
    ends = at.groupBy(config).agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))
    return size.join(ends, config).select(config, "n", "diff", "low", "high")


def _resampled(seed: int, resamples: int):
    """Of packed differences of one configuration and the first of ``TURN`` resamples: a row per resample with the ``total`` of the drawn differences and how many (``k``) these are."""
    turn, pack = TURN, PACK

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pack")
        n, first, begin = (rows[c][0].as_py() for c in ("n", "first", "pack"))
        values = pc.list_flatten(rows["values"])
        x, there, begin = pc.fill_null(values, 0.0).to_numpy(), pc.is_valid(values).to_numpy(), begin * pack
        out = []
        for r in range(first, min(first + turn, resamples + 1)):
            total, k = 0.0, 0
            for heads in draws.md5_heads(f"{seed}:{r}:", n):
                at = heads.astype(np.int64) % n - begin
                if len(x) < n:
                    at = at[(at >= 0) & (at < len(x))]
                total += float(x[at].sum())
                k += int(there[at].sum())
            out.append((r, total, k))
        r, total, k = zip(*out)
        config = pa.chunked_array([rows["config"].slice(0, 1).combine_chunks().take(pa.array([0] * len(out)))])
        return pa.table({"config": config, "r": pa.array(r, pa.int32()), "total": pa.array(total, pa.float64()), "k": pa.array(k, pa.int64())})

    return run


def _places(d: DataFrame, config: str, unit: str) -> DataFrame:
    """(config, ``place``, ``d``): each unit's place from 0 in the order of units, counted by blocks of the sorted rows instead of one window per configuration."""
    rows = cut(d.repartitionByRange(config, unit).sortWithinPartitions(config, unit).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    per = rows.groupBy(config, "part").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(config).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    return rows.join(per.withColumn("before", before), [config, "part"]).select(config, (F.col("before") + F.col("at") - F.col("first")).alias("place"), "d")


def significant(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Tests with ``significant``: the interval excludes 0 and p is below ``alpha``."""
    return tests.withColumn("significant", ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col(p) < alpha))


def within_noise(differences: DataFrame, spread: DataFrame, baseline: str, config: str = "config") -> DataFrame:
    """Differences with ``within_noise``: no larger than the deviation of the baseline's seeds (of one seed: 0)."""
    sd = spread.where(F.col(config) == baseline).select(F.col("sd").alias("noise"))
    return differences.join(F.broadcast(sd), how="cross").withColumn("within_noise", ~(F.abs("diff") > F.col("noise")))  # one row


def dominates(spread: DataFrame, diff: float) -> DataFrame:
    return spread.withColumn("dominates", F.abs(F.lit(diff)) > F.col("sd"))


def compare_scopes(narrow: DataFrame, wide: DataFrame, config: str = "config") -> DataFrame:
    """(config, ``narrow``, ``wide``, ``change``) of two tables of verdicts (``finding``, a boolean): unchanged, lost or gained in the wide scope, or not run in both."""
    a, b = narrow.select(config, F.col("finding").alias("narrow")), wide.select(config, F.col("finding").alias("wide"))
    change = (
        F.when(F.col("narrow").isNull() | F.col("wide").isNull(), "not run in both").when(F.col("narrow") == F.col("wide"), "unchanged").when(F.col("narrow"), "LOST").otherwise("GAINED")
    )
    return a.join(b, config, "full").withColumn("change", change)
