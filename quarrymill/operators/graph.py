"""Graph operators: components, reachability with a resolver, bounded fixpoints and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) of every node of an undirected graph; a component is named by its least node.

    Alternates large-star and small-star steps: each node links its neighbours to the least node it sees,
    so paths shorten geometrically. Only edges are shuffled, minima are combined before the shuffle, and
    each round ends in a checkpoint. Null ends, loops and repeated edges are dropped; an isolated node
    may be given as an edge to itself and is its own component.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("p"))
        new = cut(small.select(F.col("p.x").alias("u"), F.col("p.y").alias("v")).where("u <> v").distinct())
        # a star forest that no longer changes: every edge already leads to a root
        done = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty()
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach(seeds: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(``node``, ``depth``): everything reachable from the seeds along ``src`` -> ``dst``, with the fewest steps.

    The edges are cut once. One round per step: only the newly reached nodes are joined with them, a node is
    new if no earlier step has it, and each step is kept as it is, so nothing is written twice; cycles end
    and lost executors cost one round.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_rounds + 1):
        new = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"more than {max_rounds} steps")


def unresolved(edges: DataFrame, nodes: DataFrame, node: str = "file") -> DataFrame:
    """Edges whose target is not a known node."""
    return edges.join(nodes.select(F.col(node).alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def _rings(edges: DataFrame, rounds: int) -> DataFrame:
    """(``node``, ``root``): nodes that reach their root and are reached from it. All that are found within ``rounds`` steps; any others are left out.

    Each node takes the root with most ways through it among those that reach it, then roots are walked to
    against the edges, among their own nodes. ``edges`` have no loops.
    """
    degree = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    ways = degree.groupBy("x.node").agg((-F.sum("x.o") * F.sum("x.i")).alias("w"))
    best = cut(ways.select("node", F.struct("w", F.col("node").alias("root")).alias("best"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        came = best.where("fresh").select(F.col("node").alias("src"), "best").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("best").alias("new"))
        best = cut(best.join(came, "node", "left").select("node", F.least("best", "new").alias("best"), F.coalesce(F.col("new") < F.col("best"), F.lit(False)).alias("fresh")))
        if best.where("fresh").isEmpty():
            break
    own = best.select("node", F.col("best.root").alias("root"))
    front = own.where("node = root")
    seen = front
    for _ in range(rounds):
        before = front.select(F.col("node").alias("dst"), "root").join(edges, "dst").select(F.col("src").alias("node"), "root").distinct()
        front = cut(before.join(own, ["node", "root"]).join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return cut(seen.where("node <> root"))


def fixpoint(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """Transitive closure of ``src`` -> ``dst`` by doubling, without self-loops, each pair once.

    Before each doubling, nodes that reach each other are made one class, as far as they are found in a few
    steps, so what is doubled does not grow with the square of such a ring. At the end the members are
    joined back, in cells of the source, so no task makes all pairs of a large class.
    """
    got = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    classes, ringed = got.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("class", F.col("node")), False
    got = got.where("src <> dst")
    for k in range(max_rounds):
        rings = _rings(got, 3 if k else 6)  # each doubling halves the ways
        if not rings.isEmpty():
            ringed = True
            to = rings.select(F.col("node").alias("class"), "root")
            classes = cut(classes.join(to, "class", "left").select("node", F.coalesce("root", "class").alias("class")))
            for end in ("src", "dst"):
                got = got.join(rings.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
            got = cut(got.where("src <> dst").select("src", "dst").distinct())
        n = got.count()
        step = got.select("src", F.col("dst").alias("mid")).join(got.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        got = cut(got.union(step.where("src <> dst")).distinct())
        if got.count() == n:
            return _members(got, classes) if ringed else got
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def _members(pairs: DataFrame, classes: DataFrame, cells: int = 64) -> DataFrame:
    """Pairs of members (``node``, ``class``) of classes that are a pair, or of one class."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the bytes of classes say little about the pairs
    every = pairs.union(classes.select(F.col("class").alias("src"), F.col("class").alias("dst")).distinct())
    left = classes.select(F.col("node").alias("s"), F.col("class").alias("src")).join(every, "src").select("s", "dst", F.pmod(F.hash("s"), F.lit(cells)).alias("cell"))
    right = classes.select(F.col("node").alias("t"), F.col("class").alias("dst"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    met = left.repartition(tasks, "dst", "cell").join(right.repartition(tasks, "dst", "cell"), ["dst", "cell"])
    return met.where("s <> t").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def _first_paths(starts: DataFrame, sons: DataFrame, max_nodes: int, width: int) -> DataFrame:
    """(``start``, ``n``, ``more``, ``lost``, ``paths``): the first ``width`` branches of each start, grown to their ends.

    No branch is the beginning of another, so their order stays and what is left out (``more``) comes after
    all that is kept. ``lost``: a branch went on beyond ``max_nodes`` steps.
    """
    state = starts.select("start", F.array("start").alias("path"), F.lit("open").alias("now"), F.lit(False).alias("more"))
    w = Window.partitionBy("start")
    branch = lambda path, now: F.struct(path.alias("path"), F.lit(now).alias("now"))
    further = F.filter("sons", lambda t: ~F.array_contains("path", t))
    for step in range(max_nodes + 1):
        on = F.transform(further, lambda t: branch(F.array_append("path", t), "open")) if step < max_nodes else F.array(branch(F.col("path"), "lost"))
        grown = F.when(F.col("now") != "open", F.array(F.struct("path", "now"))).when(F.coalesce(F.size(further), F.lit(0)) > 0, on).otherwise(F.array(branch(F.col("path"), "done")))
        every = state.withColumn("src", F.when(F.col("now") == "open", F.element_at("path", -1))).join(sons, "src", "left").select("start", "more", F.inline(grown))
        every = every.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("path")))
        state = cut(every.where(F.col("rn") <= width).select("start", "path", "now", (F.col("more") | (F.col("n") > width)).alias("more")))
        if state.where("now = 'open'").isEmpty():
            break
    done = F.col("now") == "done"
    return state.groupBy("start").agg(F.count_if(done).alias("n"), F.bool_or("more").alias("more"), F.bool_or(F.col("now") == "lost").alias("lost"), F.array_sort(F.collect_list(F.when(done, F.col("path")))).alias("paths"))


def acyclic_paths(starts: DataFrame, edges: DataFrame, max_nodes: int = 64, max_paths: int = 16) -> DataFrame:
    """(``start``, ``k``, ``path``, ``truncated``): paths without repeated nodes from each start to where they cannot go on.

    Paths of one start are kept in the order of their nodes. The start is marked as truncated if it has more
    than ``max_paths``, or one that goes on after ``max_nodes`` steps, which is left out: the operator's
    meaning. Only branches that can be among the first are grown; starts whose first branches all went on
    too long are grown again with more of them.
    """
    sons = cut(edges.where("dst is not null").groupBy("src").agg(F.collect_set("dst").alias("sons")))
    left = cut(starts.select(F.col(starts.columns[0]).alias("start")).distinct())
    out, width = None, max_paths + 1
    while True:
        got = cut(_first_paths(left, sons, max_nodes, width))
        short = (F.col("n") < max_paths) & F.col("more")
        part = got.where(~short).select("start", F.posexplode(F.slice("paths", 1, max_paths)).alias("k", "path"), ((F.col("n") > max_paths) | F.col("more") | F.col("lost")).alias("truncated"))
        out = part if out is None else out.unionByName(part)
        left, width = got.where(short).select("start"), width * 4
        if left.isEmpty():
            return out
