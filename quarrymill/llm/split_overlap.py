"""Records of evaluation splits that recur, exactly or nearly, in training.

An exact prefix-filter join: words are ordered from rare to common, each evaluation record is indexed
under the first words of its own order (so many that a similar record must share one), training records
probe with theirs, pairs that length or position rule out are dropped before any text is fetched, and the
rest is verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .wordsets import KEY_ROWS, joined, likeness, meet, set_key, word_set

#: Words are counted in this many buckets: the counts that go to every task are of fixed size, whatever the
#: vocabulary. Any order is exact; counts only make it a good one.
BUCKETS = 1 << 18


def latest(pairs: DataFrame, *columns: str) -> DataFrame:
    """The valid row of each ``id``: that with the greatest ``written_at``; of ties the greatest values."""
    newest = F.max(F.struct("written_at", *columns)).alias("r")
    return pairs.where("id is not null").groupBy("id").agg(newest).select("id", *(F.col(f"r.{c}").alias(c) for c in columns))


def clean_split(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def rare_first(words: Column, counts: np.ndarray) -> Column:
    """The set's words from rare to common, by the counts of their buckets."""

    @F.arrow_udf("array<bigint>")
    def run(col: pa.Array) -> pa.Array:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
        flat = np.asarray(col.flatten()).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, counts[flat & (BUCKETS - 1)], row))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat[order]))

    return run(words)


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets a word of each bucket occurs. At most ``BUCKETS`` rows reach the driver."""
    out = np.zeros(BUCKETS, np.int64)
    got = sets.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out[got["k"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _prefix(ordered: DataFrame, name: str, threshold: float) -> DataFrame:
    n = F.size("ordered")
    keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
    return ordered.select(F.col("class").alias(name), n.alias(f"n_{name}"), F.posexplode(F.slice("ordered", F.lit(1), keep)).alias(f"at_{name}", "word"))


def similar(evals: DataFrame, train: DataFrame, threshold: float = 0.75, key_rows: int = KEY_ROWS) -> DataFrame:
    """Pairs (``e``, ``t``, ``likeness``) of classes of evaluation and training word sets at or above the threshold.

    Both need ``class`` and ``words``, one row per class. Exact: the prefix of a set of n words holds
    n - ceil(threshold n) + 1, and a pair is only dropped if its sizes, or the words left after the first
    shared one, cannot reach the threshold. A word that stands in very many prefixes is split (see ``meet``).
    """
    both = evals.unionByName(train)
    counts = bucket_counts(both)
    order = lambda d: cut(d.select("class", rare_first(F.col("words"), counts).alias("ordered")))
    index, probe = _prefix(order(evals), "e", threshold), _prefix(order(train), "t", threshold)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_e") + F.col("n_t")) - F.lit(1e-9))
    left = F.least(F.col("n_e") - F.col("at_e"), F.col("n_t") - F.col("at_t"))
    pairs = meet(probe, index, "word", "e", key_rows).where((F.least("n_e", "n_t") >= threshold * F.greatest("n_e", "n_t") - 1e-9) & (left >= need))
    pairs = pairs.select("e", "t").distinct()
    e = evals.select(F.col("class").alias("e"), F.col("words").alias("words_e"))
    t = train.select(F.col("class").alias("t"), F.col("words").alias("words_t"))
    return pairs.join(e.hint("merge"), "e").join(t.hint("merge"), "t").withColumn("likeness", likeness("words_e", "words_t")).where(F.col("likeness") >= threshold).select("e", "t", "likeness")


def _overlaps(pairs: DataFrame, threshold: float) -> DataFrame:
    """(eval id, its split and project, train id, likeness) of every overlap."""
    valid = latest(pairs, "split", "project", "notice", "dev").select("id", "project", clean_split(F.col("split")).alias("split"), "notice", "dev").where("split in ('train', 'val', 'test')")
    valid = valid.select("id", "project", "split", word_set(joined("notice", "dev")).alias("words"))
    # a filter on the words before the cut would be pushed below them and make them twice
    valid = cut(valid.withColumn("class", set_key(F.col("words")))).where(F.size("words") > 0)
    classes = lambda d: d.groupBy("class").agg(F.first("words").alias("words"))
    evals, train = valid.where("split <> 'train'"), valid.where("split = 'train'")
    got = similar(classes(evals), classes(train), threshold)
    return (
        got.join(evals.select(F.col("class").alias("e"), F.col("id").alias("eval_id"), "split", "project"), "e")
        .join(train.select(F.col("class").alias("t"), F.col("id").alias("train_id")), "t")
        .select("eval_id", "split", "project", "train_id", "likeness")
    )


def found(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of a valid training record and a valid evaluation record alike in description, the smaller id first.

    Needs ``id``, ``written_at``, ``split``, ``notice`` and ``dev``. Of the deliveries of an ``id`` the one
    with the greatest ``written_at`` is valid. Null texts are empty; records without words, of other
    splits or with a null ``id`` are no cases. Records with equal word sets are compared once and expanded
    by membership.
    """
    got = _overlaps(pairs, threshold)
    return got.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def report(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Overlaps per evaluation split and project: pairs, evaluation records concerned, exact ones among the pairs."""
    got = _overlaps(pairs, threshold)
    per = got.groupBy("split", "project", "eval_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("likeness") == 1).alias("same"))
    return per.groupBy("split", "project").agg(F.sum("n").alias("overlaps"), F.count(F.lit(1)).alias("records"), F.sum("same").alias("same_words"))
