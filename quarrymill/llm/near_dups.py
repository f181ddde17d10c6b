"""Near-duplicate records with small edits, by an exact prefix-filter join.

Words are ordered from rare to common, and records meet only if they share one of the first words of both
orders (so many that similar records must). Pairs that sizes, positions or the folded sets rule out are
dropped in the join, so that the words all code has in common propose nothing; the rest is verified by the
exact likeness of the word sets. Records with the same word set form one class first, so copies never meet
each other while pairs are looked for.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .split_overlap import bucket_counts, rare_first
from .wordsets import KEY_ROWS, joined, likeness, meet, set_key, with_sets, word_set

#: Of the circulant MinHash in ``signatures``: places of the ring; bands and coordinates of each.
RING, BANDS, ROWS = 1 << 18, 64, 6
SEED = 20_240_229


@cache
def _permutations(ring: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the ranking one doubled so that shifts need no modulo."""
    rng = np.random.default_rng(SEED)
    scatter, rank = rng.permutation(ring).astype(np.int32), rng.permutation(ring).astype(np.int32)
    return scatter, np.concatenate((rank, rank[:length]))


def signatures(values: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS, ring: int = RING) -> np.ndarray:
    """A 64-bit key per band for each set; sets must not be empty."""
    n = bands * rows
    scatter, rank = _permutations(ring, n)
    place = scatter[values.astype(np.uint64) % np.uint64(ring)]
    sets = len(offsets) - 1
    sig = np.empty((n, sets), np.int32)
    for k in range(n):
        sig[k] = np.minimum.reduceat(rank[place + k], offsets[:-1])
    keys = np.empty((bands, sets), np.uint64)
    for b in range(bands):
        h = np.full(sets, b + 1, np.uint64)
        for r in range(rows):
            h = (h ^ sig[b * rows + r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys[b] = h
    return keys.view(np.int64).T


def fold(col: pa.Array) -> pa.Array:
    """64 bits of each set: bit i is set if an odd number of words fall on it.

    Two sets differ by at least as many words as their folded sets differ by bits. Null and empty sets give 0.
    """
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
    flat = np.asarray(col.flatten()).astype(np.int64).view(np.uint64)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(np.uint64(1) << (flat >> np.uint64(58)), (np.cumsum(sizes) - sizes)[full])
    return pa.array(out.view(np.int64))


def folded(words: Column) -> Column:
    """Column of the folded sets of a column of sets."""
    return F.arrow_udf("bigint")(lambda col: fold(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col))(words)


def classed(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``pair_id``, ``class``) and classes (``class``, ``words``, ``n``, ``fold``) of the units that have words.

    ``words`` go from rare to common by counts over the units, which any order would do but for speed. A class is a distinct word set. It is numbered once the table of classes is written, so its number is
    short and stays while a query runs; results never show it. Members of repeated units appear once.
    """
    base = units.where("pair_id is not null").select("pair_id", word_set(joined("code", "natspec")).alias("words"))
    # a filter on the words before the cut would be pushed below them and make them twice
    base = cut(base.select("pair_id", "words", set_key(F.col("words")).alias("set"))).where(F.size("words") > 0)
    counts = bucket_counts(base)
    classes = base.groupBy("set").agg(F.first("words").alias("words")).withColumn("class", F.monotonically_increasing_id())
    classes = cut(classes.select("set", "class", rare_first(F.col("words"), counts).alias("words"), F.size("words").alias("n"), folded(F.col("words")).alias("fold")))
    members = cut(base.select("pair_id", "set").distinct().join(classes.select("set", "class").hint("merge"), "set").select("pair_id", "class"))
    return members, classes.drop("set")


def similar_classes(classes: DataFrame, threshold: float = 0.75, key_rows: int = KEY_ROWS) -> DataFrame:
    """Pairs of classes (``a`` < ``b``, ``likeness``) at or above the threshold.

    Exact: the prefix of a set of n words holds n - ceil(threshold n) + 1, and a pair is only dropped if its
    sizes, the words left after the first shared one, or the bits its folded sets differ by rule it out.
    That is before it is shuffled; hot words are split (see ``meet``), and a pair that meets at several
    words is verified once.
    """
    n = F.col("n")
    prefix = F.slice("words", F.lit(1), n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1)
    keyed = lambda x: classes.select(F.col("class").alias(x), n.alias(f"n_{x}"), F.col("fold").alias(f"fold_{x}"), F.posexplode(prefix).alias(f"at_{x}", "word"))
    both = F.col("n_a") + F.col("n_b")
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.ceil(F.lit(threshold / (1 + threshold)) * both - F.lit(1e-9))
    apart = F.bit_count(F.col("fold_a").bitwiseXOR(F.col("fold_b"))) <= F.lit((1 - threshold) / (1 + threshold)) * both + F.lit(1e-9)
    pairs = meet(keyed("a"), keyed("b"), "word", "b", key_rows).where((F.col("a") < F.col("b")) & sizes & left & apart).select("a", "b").distinct()
    sized = with_sets(pairs, classes, "a", "b", "class")
    return sized.withColumn("likeness", likeness("words_a", "words_b")).where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def found(units: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All pairs of different units whose likeness reaches the threshold, the smaller key first.

    Needs ``pair_id``, ``code`` and ``natspec``. Null and empty texts count as empty; units without words
    and null keys are no cases. A unit repeated with another text counts with each. Pairs of classes are
    expanded by membership at the end, copies by the class they share.
    """
    members, classes = classed(units)
    own = members.groupBy("class").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    pairs = similar_classes(classes, threshold).select("a", "b").union(own)
    left = members.select(F.col("class").alias("a"), F.col("pair_id").alias("x"))
    right = members.select(F.col("class").alias("b"), F.col("pair_id").alias("y"))
    out = meet(meet(pairs, left, "a", "x").select("b", "x", "a"), right, "b", "y").where("x <> y and (a <> b or x < y)")
    return out.select(F.least("x", "y").alias("pair_id_a"), F.greatest("x", "y").alias("pair_id_b")).distinct()


def groups(units: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per unit: ``class`` and ``group``, each named by the least ``pair_id`` in it, and ``links``, the number of similar classes.

    Units of one class have the same words; a group is what is alike, also through others. A unit repeated
    with another text holds its texts together in one group; its class is the one with the least name, its
    links are those of all its texts. Names and links hang on the units alone, not on how they lie in
    partitions.
    """
    members, classes = classed(units)
    pairs = cut(similar_classes(classes, threshold).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    least = members.groupBy("pair_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("pair_id", "a")
    same_unit = members.join(least.hint("merge"), "pair_id").where("class > a").select("a", F.col("class").alias("b"))
    comp = components(pairs.unionByName(same_unit)).select(F.col("node").alias("class"), "component")
    named = members.groupBy("class").agg(F.min("pair_id").alias("name")).join(links.hint("merge"), "class", "left").join(comp.hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    group = named.groupBy("component").agg(F.min("name").alias("group"))
    named = named.join(group.hint("merge"), "component").select("class", "name", "group", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(named.hint("merge"), "class").groupBy("pair_id").agg(F.min("name").alias("class"), F.min("group").alias("group"), F.sum("links").alias("links"))
