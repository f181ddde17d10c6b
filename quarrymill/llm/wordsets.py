"""Sets of words of short texts, and the joins on them, shared by the operators that compare records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are counted in this many cells to find hot ones: a histogram of fixed size.
CELLS = 1 << 20
#: Rows of a key that one task joins; keys of a hotter cell are split. Where more than one in ``FULLER`` cells
#: is, the table is large all over, and only cells ``FULLER`` times as full as the mean are hot.
KEY_ROWS, FULLER = 4096, 8


def word_set(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words (runs of a-z, 0-9 and _ in the lower-cased text)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))
    return F.array_sort(F.transform(found, lambda w: F.xxhash64(w)))


def joined(*parts: str) -> Column:
    """The columns with a blank between them, null as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in parts))


def set_key(words: Column) -> Column:
    """128 bits of a sorted set, from two hashes; equal sets have equal keys."""
    return F.concat(F.hex(F.xxhash64(words)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), words, F.size(words))))


def likeness(x: str, y: str) -> Column:
    """Shared words over words in either, of two columns of sets."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(F.col(x)) + F.size(F.col(y)) - both)


def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """``pairs`` with the word sets of both ends as ``words_a`` and ``words_b``."""
    left = sets.select(F.col(key).alias(a), F.col("words").alias("words_a"))
    right = sets.select(F.col(key).alias(b), F.col("words").alias("words_b"))
    return pairs.join(left.hint("merge"), a).join(right.hint("merge"), b)


def meet(left: DataFrame, right: DataFrame, key: str, row: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Inner join on ``key`` whose hot keys are split.

    ``right`` rows are counted by cells of the key's hash. Those of a hot cell are dealt by ``row``, a column
    of theirs, to parts of about ``key_rows``, and ``left`` rows of the cell go to each part: every two rows
    of a key still meet, once, but no task gets them all. Both sides are read twice, so they should be cut.
    Neither is broadcast: of exploded rows Spark's guess of the size is far too low, and they pass through
    the driver.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")
    cells = right.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    hot = cells.where(F.col("n") > key_rows).collect()  # CELLS rows at most
    if len(hot) > CELLS // FULLER:
        mean = sum(r["n"] for r in hot) / CELLS
        hot = [r for r in hot if r["n"] > FULLER * mean]
    if not hot:
        return left.join(right.hint("merge"), key)
    spark = left.sparkSession
    parts = F.broadcast(spark.createDataFrame([(r["cell"], -(-r["n"] // key_rows)) for r in hot], "cell int, parts int"))
    many = F.coalesce("parts", F.lit(1))
    right = right.withColumn("cell", cell).join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64(row, F.lit("part")), many).cast("int")).drop("cell", "parts")
    left = left.withColumn("cell", cell).join(parts, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("cell", "parts")
    return left.join(right.hint("merge"), [key, "part"]).drop("part")
