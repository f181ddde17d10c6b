"""Splits that keep related records together, by grouped iterative stratification.

Records tied by a shared project or group, also through others, form a component; its label vector says
how many records of each label it has. The label that is rarest among the records not yet placed comes
first: its components, those with most of it before the others, go into the split that needs it most and
has room for them; then the totals are updated and the next label follows. Components of about the same
size and count of the label are alike to that rule, so the driver decides by cells of a grid of fixed
size how many of each cell go where, and the components are told apart in place: one and a billion
components are placed by the same steps, and none of them is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .split_overlap import clean_split, latest

SPLITS = ("train", "val", "test")
#: Labels at most. All records together count as one more label, the last to be placed.
MAX_LABELS = 64
#: Steps of the grid from one power of two to the next; smaller numbers are exact.
STEPS = 32
#: Components of a cell that are ranked by one task; larger cells are split.
CELL_ROWS = 50_000
_ALL = ""


def tied_projects(units: DataFrame) -> DataFrame:
    """(``project``, ``component``): projects tied by a shared ``group_id``, also through others.

    Units of a project are tied anyway, so projects are the nodes, however many units they have. A null
    ``group_id`` ties nothing; a null ``project`` is no node.
    """
    both = units.where("project is not null").select("project", "group_id").distinct()
    least = both.where("group_id is not null").groupBy("group_id").agg(F.min("project").alias("b"))
    edges = both.join(least, "group_id").select(F.col("project").alias("a"), "b").union(both.select(F.col("project").alias("a"), F.col("project").alias("b")))
    return components(edges.distinct()).select(F.col("node").alias("project"), "component")


def found(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Projects whose tied units, taken together, have more than one of train, val and test.

    ``units`` needs ``pair_id``, ``project``, ``group_id``; ``pairs`` needs ``id``, ``split``,
    ``written_at``, of whose deliveries the latest is valid. Blanks and case of a split do not count, nor
    do null and other values; units without a pair have none. Repeated units change nothing. A unit without a
    project counts for the projects of its group.
    """
    ties = cut(tied_projects(units))
    split = latest(pairs, "split").select(F.col("id").alias("pair_id"), clean_split(F.col("split")).alias("split")).where(F.col("split").isin(*SPLITS))
    alone = units.where("project is null and group_id is not null").select("pair_id", "group_id").distinct().join(_of_groups(units, ties), "group_id").select("pair_id", "component")
    one = units.select("pair_id", "project").distinct().join(ties, "project").select("pair_id", "component").unionByName(alone).join(split, "pair_id").select("component", F.array("split").alias("labels"))
    mixed = label_vectors(one).where(F.size("v") > 2).select("component")  # two splits or more beside all records
    return ties.join(mixed, "component", "left_semi").select("project")


def _of_groups(units: DataFrame, ties: DataFrame) -> DataFrame:
    """(``group_id``, ``component``) of the groups that projects have."""
    return units.where("project is not null and group_id is not null").select("project", "group_id").distinct().join(ties, "project").groupBy("group_id").agg(F.min("component").alias("component"))


def label_vectors(one: DataFrame) -> DataFrame:
    """``component``, its label vector ``v`` (label -> records; ``_ALL`` counts them all) and ``n``, of rows with ``component`` and ``labels``."""
    counts = one.select("component", F.explode(F.concat("labels", F.array(F.lit(_ALL)))).alias("label")).groupBy("component", "label").agg(F.count(F.lit(1)).alias("k"))
    vectors = counts.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("label", "k"))).alias("v"))  # at most MAX_LABELS + 1 entries
    return vectors.withColumn("n", F.element_at("v", F.lit(_ALL)))


def default_labels() -> Column:
    """Labels of a unit: size of its code, whether it has a comment, number of views."""
    size = F.least(F.lit(14), F.floor(F.log2(F.length(F.coalesce("code", F.lit(""))) + 1)))
    return F.array(
        F.concat(F.lit("size:"), size.cast("string")),
        F.when(F.length(F.trim(F.coalesce("natspec", F.lit("")))) > 0, "comment:yes").otherwise("comment:no"),
        F.concat(F.lit("views:"), F.coalesce(F.least(F.lit(8), F.size("views")), F.lit(-1)).cast("string")),
    )


def labelled(units: DataFrame, labels: Column | None = None) -> DataFrame:
    """``pair_id``, ``project``, ``component`` and ``labels`` (without nulls and repeats) of every unit, once.

    The latest row of a repeated unit counts; all its rows tie. A unit without a project belongs to the
    component of its group, or to one of its own if it has no group either.
    """
    labels = F.array_compact(F.array_distinct(default_labels() if labels is None else labels))
    newest = F.max(F.struct("indexed_at", "project", "group_id", labels.alias("labels"))).alias("r")
    one = units.where("pair_id is not null").groupBy("pair_id").agg(newest).select("pair_id", "r.project", "r.group_id", "r.labels")
    ties = cut(tied_projects(units))
    named = one.where("project is not null").join(ties, "project")
    alone = one.where("project is null").join(_of_groups(units, ties).withColumnRenamed("component", "tied"), "group_id", "left")
    own = F.coalesce("tied", F.concat(F.lit("group:"), "group_id"), F.concat(F.lit("pair:"), F.col("pair_id").cast("string")))
    return named.unionByName(alone.withColumn("component", own).drop("tied")).select("pair_id", "project", "component", "labels")


def _grid(x: Column) -> Column:
    """``x`` rounded down to ``STEPS`` steps between powers of two."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(x)) - (STEPS.bit_length() - 1)))
    return (F.floor(x / step) * step).cast("long")


def _allot(cells: list, need: dict, room: dict, label: str) -> list[tuple]:
    """(cell, how many of it go to each split): cells with most of the label first, each time the split that needs it most and has room."""
    need = {s: need[s].get(label, 0.0) for s in SPLITS}
    room = dict(room)
    out = []
    for c in sorted(cells, key=lambda c: (-c["k"], -c["size"], c["part"])):
        got, left = dict.fromkeys(SPLITS, 0), c["m"]
        k, n = c["sum_k"] / c["m"], c["sum_n"] / c["m"]
        while left:
            some = max(1, left // 128)
            fits = [s for s in SPLITS if room[s] >= n] or [max(SPLITS, key=lambda s: room[s])]
            s = max(fits, key=lambda s: (need[s], room[s]))
            got[s] += some
            need[s] -= some * k
            room[s] -= some * n
            left -= some
        out.append((c["k"], c["size"], c["part"], got[SPLITS[0]], got[SPLITS[0]] + got[SPLITS[1]]))
    return out


def _place(mine: DataFrame, need: dict, room: dict, label: str) -> DataFrame:
    """The components ``mine``, all with the label, and their ``split``."""
    spark = mine.sparkSession
    mine = mine.withColumn("w", F.element_at("v", F.lit(label))).withColumns({"k": _grid(F.col("w")), "size": _grid(F.col("n")), "part": F.lit(0)})
    per = (F.count(F.lit(1)).alias("m"), F.sum("w").alias("sum_k"), F.sum("n").alias("sum_n"))
    cells = mine.groupBy("k", "size", "part").agg(*per).collect()  # no more than the grid has
    large = [(c["k"], c["size"], -(-c["m"] // CELL_ROWS)) for c in cells if c["m"] > CELL_ROWS]
    if large:
        parts = F.broadcast(spark.createDataFrame(large, "k long, size long, parts int"))  # one row for CELL_ROWS components at most
        mine = mine.join(parts, ["k", "size"], "left").withColumn("part", F.pmod(F.xxhash64("component", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        split = {(k, n) for k, n, _ in large}
        again = mine.join(parts, ["k", "size"], "left_semi").groupBy("k", "size", "part").agg(*per).collect()
        cells = [c for c in cells if (c["k"], c["size"]) not in split] + again
    rules = spark.createDataFrame(_allot(cells, need, room, label), "k long, size long, part int, first long, second long")
    rank = F.row_number().over(Window.partitionBy("k", "size", "part").orderBy(F.xxhash64("component"), "component"))
    pick = F.when(F.col("rank") <= F.col("first"), SPLITS[0]).when(F.col("rank") <= F.col("second"), SPLITS[1]).otherwise(SPLITS[2])
    return mine.withColumn("rank", rank).join(rules, ["k", "size", "part"]).select("component", "n", "v", pick.alias("split"))


def assign(units: DataFrame, proportions: tuple[float, float, float] = (0.8, 0.1, 0.1), labels: Column | None = None) -> DataFrame:
    """``pair_id``, ``project``, ``component``, ``labels`` and ``split`` of every unit, once; tied units share the split.

    ``labels`` is a column of an array of strings; null and repeated labels do not count, and a unit may have
    none. At most ``MAX_LABELS`` labels are balanced; more are an error, not dropped. An empty table gives an
    empty result. See ``labelled`` for repeated units and nulls.
    """
    one = cut(labelled(units, labels))
    comps = cut(label_vectors(one))
    totals = {r["label"]: r["k"] for r in comps.select(F.explode("v").alias("label", "k")).groupBy("label").agg(F.sum("k").alias("k")).limit(MAX_LABELS + 2).collect()}
    if len(totals) > MAX_LABELS + 1:
        raise ValueError(f"more than {MAX_LABELS} labels")
    need = {s: {x: p * k for x, k in totals.items()} for s, p in zip(SPLITS, proportions)}
    outstanding, rest, chosen = dict(totals), comps, None
    while open_ := [x for x in outstanding if outstanding[x] > 0]:
        label = min(open_, key=lambda x: (outstanding[x], x == _ALL, x))
        has = F.coalesce(F.element_at("v", F.lit(label)), F.lit(0)) > 0
        placed = cut(_place(rest.where(has), need, {s: need[s][_ALL] for s in SPLITS}, label))
        for r in placed.select("split", F.explode("v").alias("label", "k")).groupBy("split", "label").agg(F.sum("k").alias("k")).collect():
            need[r["split"]][r["label"]] -= r["k"]
            outstanding[r["label"]] -= r["k"]
        rest = rest.where(~has)
        chosen = placed if chosen is None else chosen.unionByName(placed)
    chosen = one.select("component", F.lit(SPLITS[0]).alias("split")).limit(0) if chosen is None else chosen.select("component", "split")
    return one.join(chosen, "component").select("pair_id", "project", "component", "labels", "split")


def balance(assigned: DataFrame) -> DataFrame:
    """Per split and label (``all``: every unit): ``units``, and their ``share`` of the label's units."""
    per = assigned.select("split", F.explode(F.concat(F.array(F.lit("all")), "labels")).alias("label")).groupBy("split", "label").agg(F.count(F.lit(1)).alias("units"))
    return per.withColumn("share", F.round(F.col("units") / F.sum("units").over(Window.partitionBy("label")), 6))  # at most MAX_LABELS + 1 labels
