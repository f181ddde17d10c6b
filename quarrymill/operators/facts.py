"""Fact tables of functions: nested rows of a control-flow graph, what is derived from them, and their checks.

A table is one row; each of its families is an array of structs (see ``SCHEMA``). Everything is done inside
the row with higher-order functions, so no family is exploded or shuffled.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import _rows

SCHEMA = (
    "file string, contract string, function string, char_start int, char_end int, pair_id string, facts array<struct<id:string,kind:string,text:string>>, "
    "nodes array<struct<id:string,type:string,lo:int,hi:int,state_writes:array<string>>>, edges array<struct<from:string,to:string,label:string>>, "
    "paths array<struct<id:string,nodes:array<string>>>, calls array<struct<id:string,kind:string,target:string,node:string>>, "
    "deps array<struct<id:string,variable:string,depends_on:array<string>>>, reverts array<struct<id:string,kind:string,condition:string,message:string,node:string>>, "
    "events array<struct<id:string,event:string,args:array<string>,node:string>>, ast_types array<string>"
)
FAMILIES = "facts nodes edges paths calls deps reverts events".split()
#: Families whose rows have ids a comment may cite, in their order; kinds of call by priority.
CITED = "facts nodes paths calls deps reverts events".split()
CALL_KINDS = "library builtin external internal low_level".split()


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def ids(name: str) -> Column:
    return F.coalesce(F.transform(F.col(name), lambda r: r["id"]), _none())


def row_ids() -> Column:
    """Ids of all rows that may be cited, family by family."""
    return F.concat(*map(ids, CITED))


def numbered(rows: Column, prefix: str, **fields) -> Column:
    """``rows`` with ids ``prefix`` 1, 2, ... in their order; ``fields`` are functions of a row."""
    return F.transform(rows, lambda r, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"), *(f(r).alias(k) for k, f in fields.items())))


def drop_families(tables: DataFrame, *families: str) -> DataFrame:
    """Tables without the rows of some families. Without ``reverts`` the verdict on interaction order goes, too, as it rests on them."""
    unknown = sorted(set(families) - set(FAMILIES))
    if unknown:
        raise ValueError(f"no such row families: {unknown}")
    out = tables.withColumns({f: F.when(F.col(f).isNotNull(), F.slice(f, 1, 0)) for f in families}) if families else tables
    if "reverts" in families and "facts" not in families:
        out = out.withColumn("facts", F.filter("facts", lambda r: r["kind"] != "interaction_order"))
    return out


def fact_rows(decl: Column, modifiers: Column, reads: Column, writes: Column) -> Column:
    """What a declaration shows without reading its body, numbered in a fixed order: kind, visibility, mutability, parameters, returns, modifiers, state read and written, role, purity.

    ``decl`` is a struct of ``kind``, ``visibility``, ``mutability``, ``params`` and ``returns`` (texts of type
    and name); the others are arrays of names, which are sorted, as they are sets.
    """
    of = lambda kind, c: F.transform(F.coalesce(c, _none()), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    one = lambda kind, c: of(kind, F.array_compact(F.array(c)))
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, _none())))
    joined = lambda c: F.nullif(F.array_join(names(c), ", "), F.lit(""))
    still = F.when((F.coalesce(decl["mutability"], F.lit("")) != "view") & (F.size(names(reads)) == 0) & (F.size(names(writes)) == 0), "touches no state")
    rows = F.concat(
        one("kind", decl["kind"]), one("visibility", F.coalesce(decl["visibility"], F.lit("internal"))), one("mutability", decl["mutability"]), of("parameter", decl["params"]), of("return", decl["returns"]),
        of("modifier", modifiers), one("state_read", joined(reads)), one("state_written", joined(writes)), one("role", F.when(decl["kind"] == "constructor", "constructor")), one("purity", still),
    )
    return numbered(rows, "F", kind=lambda r: r["kind"], text=lambda r: r["text"])


def call_rows(nodes: Column) -> Column:
    """Numbered calls of nodes (``id`` and an array of targets per kind of call): the more specific kind wins within a node, then by kind and target.

    A target among the library calls of a node is no external or internal one there, one among the builtin
    calls is no internal one.
    """

    def of(n):
        names = lambda k: F.coalesce(n[k], _none())
        but = lambda k, *gone: reduce(lambda a, g: F.filter(a, lambda t: ~F.array_contains(names(g), t)), gone, names(k))
        kept = [names("library"), names("builtin"), but("external", "library"), but("internal", "builtin", "library"), names("low_level")]
        tagged = lambda p, k: F.transform(k, lambda t: F.struct(F.lit(p).alias("p"), t.alias("target"), n["id"].alias("node")))
        return F.array_sort(F.concat(*(tagged(p, k) for p, k in enumerate(kept))))

    kinds = F.array(*map(F.lit, CALL_KINDS))
    return numbered(F.flatten(F.transform(nodes, of)), "C", kind=lambda r: kinds[r["p"]], target=lambda r: r["target"], node=lambda r: r["node"])


def interaction_order() -> Column:
    """Whether state is written after a call out of the contract on some path, in words; null without such a call."""
    outer = F.transform(F.filter("calls", lambda c: c["kind"].isin("external", "low_level") & (F.coalesce(c["node"], F.lit("")) != "")), lambda c: c["node"])
    writing = F.transform(F.filter("nodes", lambda n: F.size(n["state_writes"]) > 0), lambda n: n["id"])

    def late(p):
        first = F.array_min(F.filter(F.transform(p["nodes"], lambda n, i: F.when(F.array_contains(outer, n), i)), lambda i: i.isNotNull()))
        after = F.filter(p["nodes"], lambda n, i: (i > first) & F.array_contains(writing, n) & ~F.array_contains(outer, n))
        return F.when(F.size(after) > 0, F.concat(F.lit("writes state at "), F.get(after, 0), F.lit(" after an external call on path "), p["id"]))

    found = F.array_compact(F.transform("paths", late))
    return (
        F.when(F.coalesce(F.size(outer), F.lit(0)) <= 0, F.lit(None).cast("string")).when(F.size(writing) == 0, "makes an external call and writes no state")
        .when(F.size(found) > 0, F.try_element_at(found, F.lit(1))).otherwise("every state write precedes the external calls on all enumerated paths")
    )


def cfg_view() -> Column:
    """Node types along the paths with the labels of their edges, or those of all nodes if there is no path; then calls and guards by kind."""
    kind_of = lambda n: F.coalesce(F.get(F.filter("nodes", lambda x: x["id"] == n), 0)["type"], F.lit("?"))

    def step(p, n, i):
        label = F.try_element_at(F.filter("edges", lambda e: (e["from"] == n) & (e["to"] == F.try_element_at(p["nodes"], i + 2))), F.lit(-1))["label"]
        more = F.when((i + 1 < F.size(p["nodes"])) & (F.coalesce(label, F.lit("")) != ""), F.array(F.concat(F.lit("["), label, F.lit("]"))))
        return F.concat(F.array(kind_of(n)), F.coalesce(more, _none()))

    along = F.flatten(F.transform("paths", lambda p: F.concat(F.flatten(F.transform(p["nodes"], lambda n, i: step(p, n, i))), F.array(F.lit("|")))))
    start = F.when(F.size("paths") > 0, along).otherwise(F.transform("nodes", lambda n: n["type"]))
    kinds = lambda c, w: F.transform(c, lambda r: F.concat(F.lit(w), r["kind"]))
    ends = [kinds("calls", "call:"), kinds("reverts", "revert:")]
    return F.array_join(F.concat(*(F.coalesce(x, _none()) for x in (start, *ends))), " ")


def evidence(max_nodes: int = 40, max_paths: int = 6) -> Column:
    """A table as lines that may be cited, family by family. Longer lists of nodes and paths are cut, and the text says so."""
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(c))))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = lambda name, f: F.coalesce(F.transform(name, f), _none())
    note = lambda name, most, what: F.when(F.coalesce(F.size(name), F.lit(0)) > most, F.array(F.concat(F.lit(".... "), (F.size(name) - most).cast("string"), F.lit(f" more {what} left out")))).otherwise(_none())
    said = lambda r: F.when(text(r["message"]) != "", F.concat(F.lit("   message: '"), r["message"], F.lit("'"))).otherwise("")
    writes = lambda n: F.when(F.size(n["state_writes"]) > 0, F.concat(F.lit("    [writes state: "), F.array_join(n["state_writes"], ", "), F.lit("]"))).otherwise("")
    at = lambda r: F.concat(F.lit("   at "), text(r["node"]))
    sections = {
        "FACTS": rows("facts", lambda r: F.concat_ws(" ", pad(r["id"], 4), pad(r["kind"], 18), text(r["text"]))),
        "REVERTS": rows("reverts", lambda r: F.concat(F.concat_ws(" ", pad(r["id"], 4), pad(r["kind"], 8), text(r["condition"])), said(r), at(r))),
        "EVENTS": rows("events", lambda r: F.concat(pad(r["id"], 4), F.lit(" "), text(r["event"]), F.lit("("), F.array_join(F.coalesce(r["args"], _none()), ", "), F.lit(")"), at(r))),
        "CFG": F.concat(
            F.slice(rows("nodes", lambda n: F.concat(pad(n["id"], 4), F.lit(" "), pad(n["type"], 12), writes(n))), 1, max_nodes), note("nodes", max_nodes, "nodes"),
            F.slice(rows("paths", lambda p: F.concat(pad(p["id"], 4), F.lit(" "), F.array_join(p["nodes"], " -> "))), 1, max_paths), note("paths", max_paths, "paths"),
        ),
        "CALLS": rows("calls", lambda r: F.concat(F.concat_ws(" ", pad(r["id"], 4), pad(r["kind"], 10), text(r["target"])), at(r))),
        "DEPS": rows("deps", lambda r: F.concat(pad(r["id"], 4), F.lit(" "), r["variable"], F.lit(" <- "), F.array_join(r["depends_on"], ", "))),
    }
    parts = [F.when(F.size(lines) > 0, F.concat(F.lit(f"[{title}]\n  "), F.array_join(lines, "\n  "))) for title, lines in sections.items()]
    return F.when(F.size(F.array_compact(F.array(*parts))) > 0, F.array_join(F.array_compact(F.array(*parts)), "\n\n")).otherwise("(no facts on this function)")


def ast_types(node: str | None, cap: int = 400) -> list[str]:
    """Types of the nodes of a syntax tree (JSON), parents before children, children by where they start; a documentation node is left out with all below it. At most ``cap``."""
    out: list[str] = []
    todo = [json.loads(node)] if node else []
    start = lambda n: int(str(n.get("src", "0")).split(":")[0] or 0)
    while todo and len(out) < cap:
        n = todo.pop()
        if n.get("nodeType") == "StructuredDocumentation":
            continue
        if isinstance(n.get("nodeType"), str):
            out.append(n["nodeType"])
        flat = [y for x in n.values() for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict) and "nodeType" in y]
        todo += sorted(flat, key=start)[::-1]
    return out


def ast_view(tree: Column) -> Column:
    """Column of the view of a column of syntax trees; null and broken trees have an empty one."""
    def of(t: str | None) -> str:
        try:
            return " ".join(ast_types(t))
        except ValueError:
            return ""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([of(x) for x in col.to_pylist()], pa.string())

    return run(tree)


def join_pairs(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tables with the ``id`` of the pair that starts where they do (null if none does); ``pairs`` has one row per place."""
    place = pairs.groupBy("file", F.col("code_start").alias("char_start")).agg(F.min("id").alias("id"))
    return tables.join(place, ["file", "char_start"], "left")


# checks: rows that violate ------------------------------------------------------------------------------------

_PLACE = ("file", "function")


def _key() -> Column:
    return F.concat_ws(":", *_PLACE)


def duplicate_tables(tables: DataFrame) -> DataFrame:
    g = tables.groupBy("file", "char_start").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(g, "tables_are_unique", F.concat_ws("@", "file", "char_start"), F.col("n"))


def stray_tables(tables: DataFrame, decls: DataFrame, files: DataFrame, tolerated: float = 0.05) -> DataFrame:
    """Tables that start at no declaration (``file``, ``start``), if one of them is not at a declaration's keyword in ``files`` or they are too many."""
    miss = tables.select("file", "function", "char_start").join(decls.select("file", F.col("start").alias("char_start")).distinct(), ["file", "char_start"], "left_anti")
    miss = miss.join(files.select("file", "src"), "file", "left").withColumn("at", F.substring("src", F.col("char_start") + 1, F.lit(40))).drop("src")
    miss = miss.withColumn("odd", ~F.coalesce(F.col("at").rlike(r"^\s*(function|modifier|constructor|receive|fallback|event|error)\b"), F.lit(False)))
    share = miss.agg(F.count(F.lit(1)).alias("m"), F.count_if("odd").alias("o")).crossJoin(tables.agg(F.count(F.lit(1)).alias("n")))  # one row each
    bad = share.where((F.col("o") > 0) | (F.col("m") > tolerated * F.col("n"))).select(F.lit(True).alias("bad"))
    return _rows(miss.join(bad, how="cross"), "tables_join_to_declarations", _key(), F.col("at"))


def odd_offsets(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Tables that do not start like a function, and nodes outside of their table."""
    t = tables.join(files.select("file", "src"), "file", "left").withColumn("at", F.ltrim(F.substring("src", F.col("char_start") + 1, F.lit(40)))).drop("src")
    head = _rows(t.where(~F.coalesce(F.col("at").rlike(r"^(function|constructor|fallback|receive|modifier)"), F.lit(False))), "offsets_are_sane", _key(), F.substring("at", 1, 24))
    out = t.select(*_PLACE, F.explode(F.filter("nodes", lambda n: (n["lo"] >= 0) & ((n["lo"] < F.col("char_start")) | (n["lo"] > F.col("char_end"))))).alias("n"))
    return head.unionByName(_rows(out, "offsets_are_sane", _key(), F.concat_ws("@", "n.id", "n.lo")))


#: What shows that a call's target is an operation instead of a name, and names of temporaries.
RAW_TARGET, TEMPORARY = r" = |dest:|arguments:|LIBRARY_CALL|INTERNAL_CALL|HIGH_LEVEL_CALL", "^(TMP_|REF_|CONST_)"


def malformed(tables: DataFrame) -> DataFrame:
    """Repeated ids, references to nodes that are not there, paths that come back, raw targets and temporaries."""
    known = ids("nodes")
    dangling = lambda c, f: F.transform(F.filter(F.col(c), lambda r: (F.coalesce(r[f], F.lit("")) != "") & ~F.array_contains(known, r[f])), lambda r: F.concat(F.lit(f"{c} "), r[f], F.lit(" is no node")))
    each = F.concat(*(F.coalesce(x, _none()) for x in (
        F.when(F.size(row_ids()) > F.size(F.array_distinct(row_ids())), F.array(F.lit("repeated row ids"))),
        dangling("edges", "from"), dangling("edges", "to"), dangling("calls", "node"), dangling("reverts", "node"), dangling("events", "node"),
        F.transform(F.filter("calls", lambda c: c["target"].rlike(RAW_TARGET)), lambda c: F.concat(F.lit("raw target of "), c["id"])),
        F.transform(F.filter("paths", lambda p: F.size(p["nodes"]) > F.size(F.array_distinct(p["nodes"]))), lambda p: F.concat(p["id"], F.lit(" comes back to a node"))),
        F.transform(F.filter("paths", lambda p: F.size(F.array_except(p["nodes"], known)) > 0), lambda p: F.concat(p["id"], F.lit(" has a node that is not there"))),
        F.transform(F.filter("deps", lambda r: F.exists(F.concat(F.array(r["variable"]), r["depends_on"]), lambda v: v.rlike(TEMPORARY))), lambda r: F.concat(r["id"], F.lit(" names a temporary"))),
    )))
    return _rows(tables.select(*_PLACE, F.explode(each).alias("what")), "rows_are_well_formed", _key(), F.col("what"))


def odd_pairs(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tables that name a pair which is unknown or stands elsewhere."""
    t = tables.where("coalesce(pair_id, '') <> ''").join(pairs.select(F.col("id").alias("pair_id"), F.col("file").alias("f"), "code_start"), "pair_id", "left")
    bad = t.where(F.col("f").isNull() | (F.col("f") != F.col("file")) | (F.col("code_start") != F.col("char_start")))
    return _rows(bad, "pair_ids_exist", F.col("pair_id"), _key())
