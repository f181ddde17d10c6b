"""Queries on fact tables, import graphs and units. Beside each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, units
from ..session import cut, table
from .catalogue import _PAIRS, pairs_, query

# A small fact table is read off each pair's code: a node for each of these words, in order, on one path.
_NODE_WORDS = r"\b(require|revert|emit|delete|push|call|return|unchecked)\b"
_NODES_SQL = f"regexp_extract_all(code, '{_NODE_WORDS}')"


def _tables(spark, d):
    p = pairs_(spark, d, "project", "file", "code", "code_start", "code_end")
    words = p.withColumn("w", F.regexp_extract_all("code", F.lit(_NODE_WORDS), F.lit(1)))
    node = lambda i: F.concat(F.lit("N"), (i + 1).cast("string"))
    writes = lambda w: F.when(w.isin("delete", "push", "unchecked"), F.array(w)).otherwise(F.array().cast("array<string>"))
    at = lambda *which: F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), node(i).alias("node"))), lambda r: r["w"].isin(*which))
    return words.select(
        "id", "project", "file", F.col("code_start").alias("char_start"), F.col("code_end").alias("char_end"), F.col("id").alias("function"), F.col("id").alias("pair_id"),
        F.array(F.struct(F.lit("F1").alias("id"), F.lit("interaction_order").alias("kind"), F.lit("x").alias("text")), F.struct(F.lit("F2").alias("id"), F.lit("kind").alias("kind"), F.lit("function").alias("text"))).alias("facts"),
        facts.numbered(F.col("w"), "N", type=lambda w: F.upper(w), lo=lambda w: F.lit(-1), hi=lambda w: F.lit(-1), state_writes=writes).alias("nodes"),
        F.transform(F.slice("w", 2, 1 << 20), lambda w, i: F.struct(node(i).alias("from"), node(i + 1).alias("to"), F.when(w == "revert", "yes").otherwise("").alias("label"))).alias("edges"),
        F.array(F.struct(F.lit("P1").alias("id"), F.transform("w", lambda w, i: node(i)).alias("nodes"))).alias("paths"),
        facts.numbered(at("call"), "C", kind=lambda r: F.lit("low_level"), target=lambda r: F.lit("call"), node=lambda r: r["node"]).alias("calls"),
        F.array().cast("array<struct<id:string,variable:string,depends_on:array<string>>>").alias("deps"),
        facts.numbered(at("require", "revert"), "R", kind=lambda r: r["w"], condition=lambda r: F.lit(""), message=lambda r: F.lit(""), node=lambda r: r["node"]).alias("reverts"),
        facts.numbered(at("emit"), "E", event=lambda r: F.lit("e"), args=lambda r: F.array().cast("array<string>"), node=lambda r: r["node"]).alias("events"),
    )


_W = f"w AS (SELECT id, project, {_NODES_SQL} AS w FROM {_PAIRS})"


@query(f"""WITH {_W}, c AS (SELECT id, w, list_position(w, 'call') AS first, list_filter(range(1, len(w) + 1), lambda i: list_contains(['delete', 'push', 'unchecked'], w[i])) AS writes FROM w)
SELECT id, CASE WHEN coalesce(first, 0) = 0 THEN NULL WHEN len(writes) = 0 THEN 'makes an external call and writes no state'
 WHEN len(list_filter(writes, lambda i: i > first)) > 0 THEN 'writes state at N' || list_filter(writes, lambda i: i > first)[1] || ' after an external call on path P1' ELSE 'every state write precedes the external calls on all enumerated paths' END AS verdict FROM c""")
def interaction_orders(spark, d):
    return _tables(spark, d).select("id", facts.interaction_order().alias("verdict"))


@query(f"""WITH {_W} SELECT id, array_to_string(list_concat(flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i < len(w) AND w[i + 1] = 'revert' THEN [upper(w[i]), '[yes]'] ELSE [upper(w[i])] END)), ['|'],
 list_transform(list_filter(w, lambda x: x = 'call'), lambda x: 'call:low_level'), list_transform(list_filter(w, lambda x: x IN ('require', 'revert')), lambda x: 'revert:' || x)), ' ') AS view FROM w""")
def cfg_views(spark, d):
    return _tables(spark, d).select("id", facts.cfg_view().alias("view"))


@query(f"""WITH {_W}, n AS (SELECT project, len(w) AS n, len(list_filter(w, lambda x: x = 'call')) AS c, len(list_filter(w, lambda x: x IN ('require', 'revert'))) AS r, len(list_filter(w, lambda x: x = 'emit')) AS e FROM w)
SELECT project, CAST(sum(2 + n + 1 + c + r + e) AS BIGINT) AS whole, CAST(sum(1 + n + 1 + c + e) AS BIGINT) AS no_guards, CAST(sum(n + 1 + c + r) AS BIGINT) AS no_facts_events FROM n GROUP BY project""")
def cited_rows(spark, d):
    """How many rows could be cited, with all families and without some."""
    t = _tables(spark, d)
    n = lambda df, c: df.groupBy("project").agg(F.sum(F.size(facts.row_ids())).alias(c))
    return n(t, "whole").join(n(facts.drop_families(t, "reverts"), "no_guards"), "project").join(n(facts.drop_families(t, "facts", "events"), "no_facts_events"), "project")


# Every seventh table by its id is moved, every fifth names another pair: a stated change of the input, for the checks to find.
@query(f"""WITH p AS (SELECT *, CAST('0x' || substr(sha1(id), 1, 4) AS INT) AS h FROM {_PAIRS}), t AS (SELECT *, CASE WHEN h % 7 = 0 THEN code_start + 3 ELSE code_start END AS char_start, CASE WHEN h % 5 = 0 THEN 'x' || id ELSE id END AS pid FROM p)
SELECT 'joined' AS "check", count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM p WHERE p.file = t.file AND p.code_start = t.char_start)
UNION ALL SELECT 'unjoined', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file = t.file AND p.code_start = t.char_start)
UNION ALL SELECT 'pair_ids_exist', count(*) FROM t LEFT JOIN p ON p.id = t.pid WHERE p.id IS NULL OR p.code_start <> t.char_start
UNION ALL SELECT 'tables_are_unique', count(*) FROM (SELECT file, char_start FROM t GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0""")
def fact_checks(spark, d):
    h = F.conv(F.substring(F.sha1("id"), 1, 4), 16, 10).cast("int")
    t = _tables(spark, d).withColumn("char_start", F.col("char_start") + F.when(h % 7 == 0, 3).otherwise(0)).withColumn("pair_id", F.when(h % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")))
    p = pairs_(spark, d, "file", "code_start")
    got = facts.join_pairs(t.drop("id"), p).groupBy(F.when(F.col("id").isNull(), "unjoined").otherwise("joined").alias("check")).agg(F.count(F.lit(1)).alias("n"))
    bad = facts.odd_pairs(t, p).unionByName(facts.duplicate_tables(t)).unionByName(facts.malformed(t))
    return got.unionByName(bad.groupBy("check").agg(F.count(F.lit(1)).alias("n")))


# imports ------------------------------------------------------------------------------------------------------

_IMPORT_SQL = "import\\s+(?:[^;''\"]*?\\bfrom\\s*)?[\"'']([^\"'']+)[\"'']"
# The test files import names that no file has, so an import counts as that of the file whose name sorts first
# among those of the same first letter: a stated resolver.
_FILES = "(SELECT file, max(src) AS src FROM source_files GROUP BY file)"
_BASE_SQL = "regexp_extract({x}, '([^/]+)$', 1)"
_EDGES = f"""f AS (SELECT * FROM {_FILES}), i AS (SELECT DISTINCT file, unnest(regexp_extract_all(src, '{_IMPORT_SQL}', 1)) AS spec FROM f WHERE src IS NOT NULL),
b AS (SELECT substr({_BASE_SQL.format(x="file")}, 1, 1) AS k, min(file) AS target FROM f WHERE src IS NOT NULL GROUP BY 1),
e AS (SELECT i.file, spec, target FROM i LEFT JOIN b ON k = substr({_BASE_SQL.format(x="spec")}, 1, 1) AND starts_with(spec, '.'))"""


def _imports(spark, d):
    f = table(spark, d, "source_files").groupBy("file").agg(F.max("src").alias("src"))
    return f, units.imports(f)


@query(f"""WITH {_EDGES}, r AS (SELECT file, spec, regexp_replace(file, '[^/]+$', '') || spec AS p FROM i WHERE starts_with(spec, '.')),
n AS (SELECT file, spec, regexp_replace(regexp_replace(replace(p, '/./', '/'), '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', '') AS target FROM r)
SELECT i.file, i.spec, n.target, coalesce(n.target IN (SELECT file FROM f), false) AS present FROM i LEFT JOIN n USING (file, spec)""")
def resolved_imports(spark, d):
    f, i = _imports(spark, d)
    return units.resolve_relative(i, f)


@query(f"""WITH RECURSIVE {_EDGES}, c(entry, file) AS (SELECT file, file FROM f WHERE src IS NOT NULL UNION SELECT c.entry, e.target FROM c JOIN e USING (file) WHERE e.target IS NOT NULL),
u AS (SELECT c.entry, count(DISTINCT e.spec) FILTER (e.target IS NULL AND e.spec IS NOT NULL) AS unresolved FROM c LEFT JOIN e USING (file) GROUP BY c.entry),
s AS (SELECT entry, count(*) AS sources, sha1(entry || string_agg(file || sha1(src), '' ORDER BY file)) AS digest FROM c JOIN f USING (file) GROUP BY entry)
SELECT entry, sources, unresolved, unresolved = 0 AS complete, digest FROM s JOIN u USING (entry)""")
def unit_closure(spark, d):
    f, i = _imports(spark, d)
    f = cut(f.where("src is not null"))
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    first = f.groupBy(F.substring(base("file"), 1, 1).alias("k")).agg(F.min("file").alias("target"))
    resolver = i.where(F.col("spec").startswith(".")).withColumn("k", F.substring(base("spec"), 1, 1)).join(first, "k").select("file", "spec", "target")
    u = units.closure(f.select(F.col("file").alias("entry")), f, resolver, i)
    return u.select("entry", "sources", "unresolved", "complete", "digest")
