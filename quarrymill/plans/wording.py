"""Queries on what comments say: gates, verbs, inherited text. Beside each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, inherit, runs, verbs
from ..session import table
from .catalogue import _OK, _PAIRS, _RUNS, pairs_, query, runs_

# The test pairs carry no modifiers, so these queries put one of these names, or none, on each declaration by
# its id, and end a run's comment with one of these sentences, or none, by its number: a stated change of the input.
_MODIFIERS = "onlyOwner onlyGov nonReentrant whenNotPaused onlyEnabledRoute onlyHolderOrDelegate auth locked onlyLive onlyFactoryOwner mutexed onlyOrchestrated".split()
_SAID = [
    ". Only the owner may call it", ". Can only be called by the admin", "\n@param x callable by the owner or the governance", ". Allows the holder to withdraw",
    ". Reverts unless the caller is the factory owner", ". Sets the owner. It can only be called once",
]


def _pick(n: int, values: list[str], sql: bool = False):
    if sql:
        return "CASE {n} " + " ".join("WHEN {i} THEN '{v}'".format(i=i, v=v.replace("\n", "' || chr(10) || '")) for i, v in enumerate(values)) + " ELSE '' END"
    out = F.lit("")
    for i, v in enumerate(values):
        out = F.when(n == i, v).otherwise(out)
    return out


def gated_code(code, key):
    mark = F.conv(F.substring(F.sha1(key), 1, 1), 16, 10).cast("int")
    return F.regexp_replace(code, F.lit(r"^([^)]*\))"), F.concat(F.lit("$1 "), _pick(mark, _MODIFIERS)))


_MARK = "CAST('0x' || substr(sha1(id), 1, 1) AS INT)"
_GATED = f"(SELECT id, regexp_replace(code, '^([^)]*\\))', '\\1 ' || {_pick(0, _MODIFIERS, True).replace('{n}', _MARK)}) AS code, notice, dev FROM {_PAIRS})"
_COMMENTED = f"(SELECT run_id, config, pair_id, final || {_pick(0, _SAID, True).replace('{n}', 'run_id % 9')} AS comment FROM {_RUNS} WHERE {_OK} AND final IS NOT NULL)"


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pieces_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z]+|[0-9]+'), lambda p: lower(p))"


_PHRASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in gates.PRINCIPALS.items()) + "}"
_WHO = f"list_filter(list_transform(list_filter(parts, lambda x: x <> 'only'), lambda x: {_PHRASES}[x]), lambda x: x IS NOT NULL)"
_GATES_CTE = f"""p AS (SELECT * FROM {_GATED}),
h AS (SELECT id, regexp_replace(regexp_replace(regexp_extract(code, '^[^)]*\\)([^{{]*)\\{{', 1), 'returns\\s*\\([^)]*\\)', ' ', 'g'), '\\([^)]*\\)', ' ', 'g') AS head FROM p),
n AS (SELECT id, pos, name FROM (SELECT id, unnest(regexp_extract_all(head, '[A-Za-z_]\\w*')) AS name, generate_subscripts(regexp_extract_all(head, '[A-Za-z_]\\w*'), 1) AS pos FROM h) WHERE NOT list_contains({_sql_list(gates.HEADER_WORDS)}, lower(name))),
q AS (SELECT *, {_pieces_sql("name")} AS parts FROM n),
k AS (SELECT id, pos, name, CASE WHEN list_contains({_sql_list(gates.REENTRANCY_NAMES)}, lower(name)) THEN 'reentrancy' WHEN list_contains({_sql_list(gates.BARE_CALLERS)}, lower(name)) THEN 'caller'
  WHEN parts[1] = 'when' THEN 'state' WHEN parts[1] = 'only' AND (list_contains({_sql_list(gates.STATE_ROOTS)}, array_to_string(parts[2:], '')) OR list_has_any(parts[2:], {_sql_list(gates.STATE_ROOTS)}) AND NOT list_has_any(parts[2:], {_sql_list(gates.PRINCIPALS)})) THEN 'state'
  WHEN parts[1] = 'only' THEN 'caller' ELSE 'other' END AS kind,
  nullif(CASE WHEN list_contains(parts, 'or') THEN array_to_string({_WHO}, ' or ') ELSE array_to_string({_WHO}, ' ') END, '') AS principal FROM q)"""


@query(f"WITH {_GATES_CTE} SELECT name, kind, principal, count(*) AS n FROM k GROUP BY ALL")
def gate_kinds(spark, d):
    g = pairs_(spark, d, "code").select(F.explode(gates.code_gates(gated_code(F.col("code"), F.col("id")))).alias("g"))
    return g.groupBy("g.name", "g.kind", "g.principal").agg(F.count(F.lit(1)).alias("n"))


_STATED = f"regexp_matches({{s}}, '{gates.RESTRICTION}')"
_WORDS = "list_concat([lower(name)], list_filter(regexp_split_to_array(coalesce(principal, ''), '[ ,]+'), lambda w: length(w) > 2))"
_RATES_CTE = f"""{_GATES_CTE},
c AS (SELECT run_id, config, pair_id AS id, comment, regexp_split_to_array(comment, '[.;\\n]') AS sents, list_transform(regexp_extract_all(comment, '@(?:param|return)([^@]*)', 1), lambda f: regexp_split_to_array(f, '[.;\\n]')) AS fields FROM {_COMMENTED} WHERE pair_id IN (SELECT id FROM p)),
w AS (SELECT id, pos, name, kind, {_WORDS} AS words, principal FROM k),
j AS (SELECT c.run_id, c.config, w.kind, w.words,
  len(list_filter(c.sents, lambda s: {_STATED.replace("{s}", "s")} AND len(list_filter(w.words, lambda t: contains(lower(s), t))) > 0)) > 0 AS stated,
  len(list_filter(list_transform(c.fields, lambda f: len(list_filter(f, lambda s: {_STATED.replace("{s}", "s")} AND len(list_filter(w.words, lambda t: contains(lower(s), t))) > 0)) > 0), lambda b: b)) > 0 AS elsewhere
  FROM c LEFT JOIN w USING (id)),
g AS (SELECT run_id, config, coalesce(bool_or(kind = 'caller'), false) AS gated, bool_and(CASE WHEN kind = 'caller' THEN stated ELSE true END) AS all_stated, bool_or(kind = 'caller' AND elsewhere) AS misplaced, coalesce(flatten(list(words) FILTER (words IS NOT NULL)), []) AS known FROM j GROUP BY run_id, config),
i AS (SELECT g.*, len(list_filter(list_transform(c.sents, lambda s: regexp_matches(s, '{gates.CLAIM}') AND ({" OR ".join(f"(regexp_matches(lower(s), '{chr(92)}b{w}{chr(92)}b') AND NOT list_contains(g.known, '{w}') AND NOT list_contains(g.known, '{p}'))" for w, p in gates.PRINCIPALS.items())})), lambda b: b)) > 0 AS inv FROM g JOIN c USING (run_id, config))"""


@query(f"""WITH {_RATES_CTE}, r AS (SELECT config, count(*) FILTER (gated) AS gated, count(*) FILTER (gated AND all_stated) AS stated, count(*) FILTER (gated AND misplaced) AS wrong_tag,
 count(*) FILTER (NOT gated) AS ungated, count(*) FILTER (NOT gated AND inv) AS invented FROM i GROUP BY config)
SELECT *, round(stated / nullif(gated, 0), 6) AS recall, round(wrong_tag / nullif(gated, 0), 6) AS wrong_tag_rate, round(invented / nullif(ungated, 0), 6) AS invention_rate FROM r""")
def gate_rates(spark, d):
    p = pairs_(spark, d, "code").select(F.col("id").alias("pair_id"), gates.gates(gated_code(F.col("code"), F.col("id"))).alias("gates"))
    c = F.concat("final", _pick(F.col("run_id") % 9, _SAID))
    r = runs_(spark, d, "config", "pair_id", "error", "final").where(~runs.failed()).where("final is not null").select("config", "pair_id", c.alias("comment"))
    tagged = F.regexp_extract_all("comment", F.lit("@(?:param|return)([^@]*)"), F.lit(1))
    fields = F.map_from_entries(F.transform(tagged, lambda t, i: F.struct(F.concat(F.lit("param:"), i.cast("string")), t)))
    return gates.rates(r.withColumn("fields", fields).join(p, "pair_id"), "config")


# verbs --------------------------------------------------------------------------------------------------


def _forms_sql(words: str) -> str:
    short = "CASE WHEN length(w) > 3 AND ends_with(w, 'e') THEN regexp_replace(w, 'e+$', '') ELSE w END"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN contains(w, ' ') THEN [w] ELSE [w, w || 's', w || 'es', w || 'd', w || 'ed', ({short}) || 'ing', ({short}) || 'ed', ({short}) || 'es'] END))"


def _words_sql(words: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {_sql_list(v)}" for k, v in words.items()) + "}"


_OPPOSITE = {k: sorted({*v, *(x for a in v for x in verbs.SYNONYMS.get(a, []) if x not in verbs.GENERAL)}) for k, v in verbs._antonyms().items()}
_VERBS_CTE = f"""r AS (SELECT r.run_id, r.config, r.function, r.final, p.notice FROM {_RUNS} r JOIN {_PAIRS} p ON p.id = r.pair_id WHERE {_OK} AND r.final IS NOT NULL),
v AS (SELECT *, list_filter({_pieces_sql("function")}, lambda x: NOT list_contains({_sql_list(verbs.EMPTY_OPENINGS)}, x))[1] AS verb, ' ' || regexp_replace(lower(final), '[^a-z ]+', ' ', 'g') || ' ' AS t FROM r),
s AS (SELECT *, len(list_filter({_forms_sql("list_concat([verb], coalesce(" + _words_sql(verbs.SYNONYMS) + "[verb], []))")}, lambda f: contains(t, ' ' || f || ' '))) > 0 AS named,
 len(list_filter({_forms_sql("coalesce(" + _words_sql(_OPPOSITE) + "[verb], [])")}, lambda f: contains(t, ' ' || f || ' '))) > 0 AS opposite,
 trim(regexp_replace(lower(regexp_extract(final, '@notice([^@]*)', 1)), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(notice), '\\s+', ' ', 'g')) AS again FROM v WHERE verb IS NOT NULL AND length(verb) > 1)"""


@query(f"""WITH {_VERBS_CTE}, b AS (SELECT *, 'all' AS rows FROM s UNION ALL SELECT *, 'not reproduced' FROM s WHERE NOT coalesce(again, false))
SELECT config, rows, count(*) AS n, count(*) FILTER (named) AS named, count(*) FILTER (opposite AND NOT named) AS inverted, round(count(*) FILTER (named) / count(*), 6) AS agreement, round(count(*) FILTER (opposite AND NOT named) / count(*), 6) AS inversion_rate
FROM b WHERE length(verb) > 2 OR verb = 'is' GROUP BY config, rows""")
def verb_inversion(spark, d):
    p = pairs_(spark, d, "notice").select(F.col("id").alias("pair_id"), "notice")
    r = runs_(spark, d, "config", "pair_id", "function", "error", "final").where(~runs.failed()).where("final is not null").join(p, "pair_id")
    again = text.norm_prose(F.regexp_extract("final", "@notice([^@]*)", 1)) == text.norm_prose(F.col("notice"))
    which = F.when(F.coalesce(again, F.lit(False)), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("not reproduced")))
    scored = r.select("config", verbs.intent(F.col("function")).alias("verb"), F.col("final").alias("comment"), F.explode(which).alias("rows"))
    return verbs.agreement(scored, "config", "rows")


# inherited text -------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE p AS (SELECT id, coalesce(container, '') AS container, signature, arity_key, inheritdoc FROM {_PAIRS}),
s AS (SELECT container, signature, min(id) AS nxt FROM p WHERE container <> '' GROUP BY ALL), a AS (SELECT container, arity_key, min(id) AS nxt FROM p WHERE container <> '' GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT id, id AS cur, 0 AS hops FROM p WHERE inheritdoc IS NOT NULL
  UNION ALL SELECT c.id, coalesce(s.nxt, a.nxt), c.hops + 1 FROM c JOIN p ON p.id = c.cur LEFT JOIN s ON s.container = p.inheritdoc AND s.signature = p.signature LEFT JOIN a ON a.container = p.inheritdoc AND a.arity_key = p.arity_key WHERE p.inheritdoc IS NOT NULL AND c.hops < 9),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1)
SELECT id, cur AS target, CASE WHEN cur IS NULL THEN 'unresolved' WHEN hops > 8 THEN 'cycle' ELSE 'resolved' END AS state, CAST(hops - CASE WHEN cur IS NULL THEN 1 ELSE 0 END AS INT) AS hops FROM l""")
def inherit_chain(spark, d):
    return inherit.chains(pairs_(spark, d, "container", "signature", "arity_key", "inheritdoc"))
