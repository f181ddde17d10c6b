"""All queries of the core and the SQL that must give the same rows.

Each query runs over its whole tables. Where SQL would be too slow on whole tables, or cannot state the
operator, a query has none and small tests compare it with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, solidity, text
from ..operators import checks, classify, corpus, dedup, graph, matching, retrieval, runs, stats, tables
from ..session import table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_PAIRS = "(SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC) = 1)"
_RUNS = "(SELECT * FROM run_records QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC) = 1)"
_CALLS = "(SELECT * FROM model_calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY loaded_at DESC) = 1)"
_UNITS = "(SELECT * FROM retrieval_units QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY indexed_at DESC) = 1)"
_OK = "coalesce(error, '') = ''"
_BASE = "full"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def pairs_(spark, d, *cols):
    return dedup.latest(table(spark, d, "pairs"), "id", "written_at", *cols)


def pairs_with_maps(spark, d, *cols):
    return dedup.newest(table(spark, d, "pairs"), "id", "written_at", *cols)


def runs_(spark, d, *cols):
    return runs.valid_runs(table(spark, d, "run_records"), *cols)


def units_(spark, d, *cols):
    return dedup.latest(table(spark, d, "retrieval_units"), "pair_id", "indexed_at", *cols)


# deduplication, splits, corpus -------------------------------------------------------------------------


@query(f"""SELECT id, project, split FROM (
  SELECT *, row_number() OVER (PARTITION BY signature, trim(regexp_replace(lower(concat_ws('|', coalesce(notice, ''), coalesce(dev, ''))), '\\s+', ' ', 'g'))
    ORDER BY CASE lower(trim(split)) WHEN 'test' THEN 0 WHEN 'val' THEN 1 WHEN 'train' THEN 2 ELSE 3 END,
      CASE WHEN contains(code, '{{') AND rtrim(code) LIKE '%}}' THEN 0 ELSE 1 END, file, code_start, id) AS rn FROM {_PAIRS}) WHERE rn = 1""")
def dedup_keep_first(spark, d):
    return dedup.dedup_pairs(pairs_(spark, d, "signature", "notice", "dev", "split", "code", "file", "code_start", "project"))


@query(f"SELECT id, written_at, split FROM {_PAIRS}")
def latest_delivery(spark, d):
    return pairs_(spark, d, "split")


@query("SELECT sha1(regexp_replace(text, '\\s+', '', 'g')) AS exact_key, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_key_groups(spark, d):
    return dedup.exact_groups(table(spark, d, "documents"), "text", "doc_id")


@query(f"SELECT split_part(u.x, ':', 1) AS defect, count(*) AS n FROM {_PAIRS} p, unnest(p.defects) AS u(x) GROUP BY 1")
def defect_histogram(spark, d):
    return corpus.defect_histogram(pairs_(spark, d, "defects"))


_KINDS = ["function", "constructor", "fallback", "receive", "modifier", "event", "error"]


@query("SELECT coalesce(lower(trim(split)), 'none') AS split_name, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in _KINDS) + f" FROM {_PAIRS} GROUP BY 1")
def kind_split_crosstab(spark, d):
    return corpus.kind_crosstab(pairs_(spark, d, "split", "kind"), _KINDS)


@query("""SELECT project, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT DISTINCT project, CAST('0x' || substr(sha1(project), 1, 8) AS BIGINT) % 100 AS h FROM pairs)""")
def project_split(spark, d):
    return corpus.project_split(table(spark, d, "pairs"))


@query(f"""SELECT group_id AS "key", CAST(count(DISTINCT lower(trim(split))) AS VARCHAR) AS detail, 'groups_do_not_straddle' AS "check"
FROM {_PAIRS} WHERE lower(trim(split)) IN ('train', 'val', 'test') GROUP BY group_id HAVING count(DISTINCT lower(trim(split))) > 1""")
def groups_straddling(spark, d):
    return checks.straddling_groups(pairs_(spark, d, "group_id", "split"))


@query(f"""WITH p AS (SELECT id, lower(trim(split)) AS split, trim(regexp_replace(lower(notice), '\\s+', ' ', 'g')) AS n, trim(regexp_replace(lower(dev), '\\s+', ' ', 'g')) AS v FROM {_PAIRS}),
t AS (SELECT n AS k FROM p WHERE split = 'train' UNION SELECT v FROM p WHERE split = 'train')
SELECT id, split FROM p WHERE split IN ('val', 'test') AND n <> '' AND n IN (SELECT k FROM t WHERE k <> '')""")
def leakage_semi(spark, d):
    return corpus.leaked(pairs_(spark, d, "split", "notice", "dev"))


@query("""WITH w AS (SELECT kind, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT kind, list_sort(list(w)) AS l FROM w WHERE w > 0 GROUP BY kind)
SELECT kind, CAST(len(l) AS BIGINT) AS n, round(list_avg(l), 6) AS mean, CAST(l[greatest(0, CAST(floor(len(l) * 0.10) AS INT) - 1) + 1] AS INT) AS p10,
  CAST(l[least(len(l) - 1, CAST(floor(len(l) * 0.90) AS INT)) + 1] AS INT) AS p90 FROM g""")
def length_profile(spark, d):
    p = corpus.length_profile(table(spark, d, "documents"), "text", "kind")
    return p.select("kind", "n", r6(F.col("mean"), "mean"), "p10", "p90")


@query(f"""SELECT project, count(*) AS n, round(avg(CAST(ends_with(t, '.') AS INT)), 6) AS stop_rate, round(avg(CAST(regexp_matches(t, '^[A-Z]') AS INT)), 6) AS capital_rate,
  round(avg(CAST(contains(t, '`') AS INT)), 6) AS code_rate, round(avg(len(regexp_split_to_array(t, '\\s+'))), 6) AS mean_words,
  CAST(median(len(regexp_split_to_array(t, '\\s+'))) AS DOUBLE) AS median_words, round(avg(CAST(len(list_filter(regexp_split_to_array(t || ' ', '[.!?]\\s'), lambda s: trim(s) <> '')) <= 1 AS INT)), 6) AS one_sentence,
  round(avg(CAST(regexp_matches(t, '(?i)^the ') AS INT)), 6) AS starts_the, round(avg(CAST(regexp_matches(t, '(?i)^this (function|method)') AS INT)), 6) AS starts_this, round(avg(CAST(regexp_matches(t, '^[A-Z][a-z]+s\\b') AS INT)), 6) AS third_person
  FROM (SELECT project, trim(notice) AS t FROM {_PAIRS}) WHERE t <> '' GROUP BY project""")
def house_style(spark, d):
    s = classify.house_style(pairs_(spark, d, "project", "notice"), "notice", "project")
    return s.select("project", "n", "median_words", *(r6(F.col(c), c) for c in ("stop_rate", "capital_rate", "code_rate", "mean_words", "one_sentence", "starts_the", "starts_this", "third_person")))


@query(f"""WITH k AS (SELECT project, regexp_extract(notice, '[A-Za-z]+') AS word, count(*) AS k FROM {_PAIRS} WHERE regexp_extract(notice, '[A-Za-z]+') <> '' GROUP BY ALL)
SELECT project, word, k, CAST(row_number() OVER (PARTITION BY project ORDER BY k DESC, word) AS INT) AS place FROM k QUALIFY place <= 5""")
def opening_words(spark, d):
    return classify.first_words(pairs_(spark, d, "project", "notice"), "notice", "project", 5)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t WHERE len(w) > 1)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def token_bigram_counts(spark, d):
    w = table(spark, d, "documents").where("text is not null").select(text.word_tokens(F.col("text")).alias("w"))
    return w.select(F.explode(text.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT id, notice, dev, params, returns FROM {_PAIRS}),
f AS (SELECT id, 'notice' AS field, notice AS v FROM p UNION ALL SELECT id, 'dev', dev FROM p
 UNION ALL SELECT id, 'param:' || u.k, params[u.k] FROM p, unnest(map_keys(params)) AS u(k)
 UNION ALL SELECT id, 'return:' || (i - 1), trim(concat_ws(' ', returns[i].name, returns[i].text)) FROM (SELECT id, returns, unnest(range(1, len(returns) + 1)) AS i FROM p))
SELECT id, field, v AS text FROM f WHERE trim(coalesce(v, '')) <> ''""")
def reference_fields(spark, d):
    p = pairs_with_maps(spark, d, "notice", "dev", "returns", "params")
    return p.select("id", F.explode(corpus.reference_fields()).alias("field", "text"))


@query(f"""WITH p AS (SELECT id, regexp_extract(trim(notice), '^[^A-Za-z]*([A-Za-z]+)', 1) AS w, name FROM {_PAIRS} WHERE kind = 'function' AND trim(notice) <> ''),
v AS (SELECT id, name, lower(w) AS w FROM p),
s AS (SELECT id, name, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS verb FROM v)
SELECT verb, count(*) AS n, count(*) FILTER (regexp_matches(name, '^' || verb || '([^a-z]|$)')) AS agree FROM s WHERE verb <> '' GROUP BY verb""")
def verb_agreement(spark, d):
    p = pairs_(spark, d, "kind", "notice", "name").where("kind = 'function' and trim(notice) <> ''").withColumn("verb", classify.leading_verb(F.col("notice"))).where("verb <> ''")
    return p.groupBy("verb").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.rlike("name", F.concat(F.lit("^"), "verb", F.lit("([^a-z]|$)")))).alias("agree"))


_STEMS = text.SUFFIXES


@query(
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(notice), '[a-z0-9_]+')) AS w FROM {_PAIRS})
SELECT CASE """ + " ".join(f"WHEN w LIKE '%{s}' AND length(w) >= {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in _STEMS) + " ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1"
)
def stem_counts(spark, d):
    w = pairs_(spark, d, "notice").select(F.explode(text.word_tokens(F.col("notice"))).alias("w"))
    return w.select(text.stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT p.id, regexp_extract_all(lower(p.code), '[a-z0-9_]+') AS a, regexp_extract_all(lower(u.code), '[a-z0-9_]+') AS b FROM {_PAIRS} p JOIN {_UNITS} u ON p.id = u.pair_id),
s AS (SELECT id, CASE WHEN len(a) < 3 THEN (CASE WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) END AS a,
 CASE WHEN len(b) < 3 THEN (CASE WHEN len(b) > 0 THEN [array_to_string(b, ' ')] ELSE [] END) ELSE list_distinct(list_transform(range(1, len(b) - 1), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2])) END AS b FROM t)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM s""")
def shingle_jaccard(spark, d):
    j = pairs_(spark, d, "code").select("id", F.col("code").alias("a")).join(units_(spark, d, "code").select(F.col("pair_id").alias("id"), F.col("code").alias("b")), "id")
    # one projection per step: an expression inside a lambda would be evaluated again for every element
    j = j.select("id", text.word_tokens(F.col("a")).alias("a"), text.word_tokens(F.col("b")).alias("b"))
    j = j.select("id", text.shingles(F.col("a")).alias("a"), text.shingles(F.col("b")).alias("b"))
    return j.select("id", r6(text.jaccard(F.col("a"), F.col("b")), "score"))


@query()
def declarations(spark, d):
    f = dedup.latest(table(spark, d, "source_files").where("src is not null"), "file", "fetched_at", "src")
    return f.select("file", F.explode(solidity.declared(F.col("src"))).alias("x")).select("file", "x.kind", "x.name", "x.container", "x.start", "x.body", "x.signature", "x.arity_key")


@query(f"""SELECT id, signature, arity_key, nullif(mutability, '') AS mutability, is_virtual, overrides, list_sort(list_filter(list_transform(regexp_split_to_array(regexp_extract(code, '^[^(]*\\(([^()]*)\\)', 1), ','),
 lambda x: regexp_extract(trim(x), '\\s([A-Za-z_$][\\w$]*)$', 1)), lambda x: x <> '')) AS params FROM {_PAIRS} WHERE kind = 'function'""")
def parsed_headers(spark, d):
    """What the declaration parser reads off each function's code; the corpus has the same on record."""
    x = pairs_(spark, d, "kind", "code").where("kind = 'function'").select("id", F.get(solidity.declared(F.col("code")), 0).alias("x"))
    return x.select("id", "x.signature", "x.arity_key", "x.mutability", "x.is_virtual", "x.overrides", F.array_sort("x.params").alias("params"))


# metrics -----------------------------------------------------------------------------------------------

_GRAMS = "list_transform(range(1, greatest(len({t}) - {n} + 2, 1)), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def bleu_sums_sql(rows: str, by: str) -> str:
    """Sums of corpus BLEU over ``rows`` (columns ``by``, word lists c and r): h1.., t1.., cand, ref, n, empty."""
    clip = lambda n: f"coalesce(list_sum(list_transform(list_distinct(c{n}), lambda g: least(len(list_filter(c{n}, lambda x: x = g)), len(list_filter(r{n}, lambda x: x = g))))), 0)"
    grams = ", ".join(f"{_GRAMS.format(t=t, n=n)} AS {t}{n}" for t in "cr" for n in (1, 2, 3, 4))
    return f"""SELECT {by}, count(*) AS n, CAST(sum(CAST(len(c) = 0 AS INT)) AS BIGINT) AS empty, CAST(sum(len(c)) AS BIGINT) AS cand, CAST(sum(len(r)) AS BIGINT) AS ref, """ + ", ".join(
        f"CAST(sum(greatest(1, len(c) - {n - 1})) AS BIGINT) AS t{n}, CAST(sum({clip(n)}) AS BIGINT) AS h{n}" for n in (1, 2, 3, 4)
    ) + f" FROM (SELECT *, {grams} FROM ({rows})) GROUP BY ALL"


def bleu_sql(weights) -> str:
    used = [(n + 1, w) for n, w in enumerate(weights) if w]
    none = " OR ".join(f"h{n} = 0" for n in sorted({1, *(n for n, _ in used)}))
    logs = " + ".join(f"{w} * (ln(greatest(h{n}, 1)) - ln(t{n}))" for n, w in used)
    return f"CASE WHEN {none} THEN 0.0 ELSE 100 * exp({logs}) * CASE WHEN cand > ref THEN 1.0 ELSE exp(1 - ref / cand) END END"


def split_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[\\s\\p{{Z}}]+'), lambda x: x <> '')"


_FINAL_DRAFT = f"SELECT config, {split_words('final')} AS c, {split_words('draft')} AS r FROM {_RUNS} WHERE {_OK} AND final IS NOT NULL AND regexp_matches(draft, '[^\\s\\p{{Z}}]')"


@query(f"SELECT config, n, empty, {', '.join(f'round({bleu_sql(w)}, 2) AS {k}' for k, w in tables.WEIGHTS.items())} FROM ({bleu_sums_sql(_FINAL_DRAFT, 'config')})")
def bleu_corpus(spark, d):
    r = runs_(spark, d, "config", "error", "final", "draft").where(~runs.failed()).where("final is not null")
    return tables.bleu_table(r, ["config"], "final", "draft", tuple(tables.WEIGHTS))


@query(f"""WITH t AS (SELECT run_id, config, list_filter(regexp_split_to_array(final, '\\s+'), lambda x: x <> '') AS c, list_filter(regexp_split_to_array(draft, '\\s+'), lambda x: x <> '') AS r
 FROM {_RUNS} WHERE {_OK} AND final IS NOT NULL AND draft IS NOT NULL),
h AS (SELECT run_id, sum(least(a.k, b.k)) AS hit FROM (SELECT run_id, g, count(*) AS k FROM (SELECT run_id, unnest(c) AS g FROM t) GROUP BY ALL) a JOIN (SELECT run_id, g, count(*) AS k FROM (SELECT run_id, unnest(r) AS g FROM t) GROUP BY ALL) b USING (run_id, g) GROUP BY run_id)
SELECT t.run_id, round(coalesce(2.0 * hit / (len(c) + len(r)), 0.0), 6) AS rouge_1 FROM t LEFT JOIN h USING (run_id)""")
def rouge_1(spark, d):
    r = runs_(spark, d, "config", "error", "final", "draft").where(~runs.failed()).where("final is not null and draft is not null")
    return r.select("run_id", r6(metrics.rouge_n(F.col("final"), F.col("draft"), 1), "rouge_1"))


@query()
def sentence_metrics(spark, d):
    r = runs_(spark, d, "pair_id", "error", "final").where(~runs.failed()).join(pairs_(spark, d, "notice").select(F.col("id").alias("pair_id"), "notice"), "pair_id").where("trim(notice) <> ''")
    c, g = F.col("final"), F.col("notice")
    return r.select("run_id", r6(metrics.sentence_bleu(c, g), "bleu"), r6(metrics.rouge_l(c, g), "rouge_l"), r6(metrics.meteor(c, g), "meteor"))


@query()
def hashed_vectors(spark, d):
    return units_(spark, d, "code").select("pair_id", metrics.hashing_encoder(F.col("code")).alias("vector"))


# runs --------------------------------------------------------------------------------------------------


@query(f"SELECT pair_id FROM {_RUNS} WHERE {_OK} GROUP BY pair_id HAVING count(DISTINCT config) = (SELECT count(DISTINCT config) FROM {_RUNS})")
def matched_ids(spark, d):
    return runs.matched_ids(runs_(spark, d, "pair_id", "config", "error"))


@query(f"""SELECT config, CASE WHEN grouping(f) = 1 THEN 'all' WHEN f THEN 'with' ELSE 'without' END AS block, count(*) AS n, round(avg(support_rate), 6) AS support,
 round(avg(CASE WHEN gate_verdict <> '' THEN CAST(gate_verdict = 'PASS' AS INT) END), 6) AS pass_rate, round(avg(CAST(gate_kept_draft AS INT)), 6) AS kept_draft, round(avg(rounds_used), 6) AS rounds
FROM (SELECT *, coalesce(has_sigma, false) AS f FROM {_RUNS} WHERE {_OK}) GROUP BY GROUPING SETS ((config, f), (config))""")
def condition_blocks(spark, d):
    b = runs.blocks(runs_(spark, d, "config", "error", "has_sigma", "support_rate", "gate_verdict", "gate_kept_draft", "rounds_used"))
    return b.select("config", "block", "n", *(r6(F.col(c), c) for c in ("support", "pass_rate", "kept_draft", "rounds")))


@query(f"""SELECT prompt_id, count(*) AS calls, count(*) FILTER (first_attempt_parsed) AS first_ok, count(*) FILTER (repaired) AS repaired, count(*) FILTER (cached) AS cached,
 round(avg(seconds), 6) AS mean_seconds, round(avg(CAST(first_attempt_parsed AS INT)), 6) AS first_rate, max(attempts) AS most_attempts FROM {_CALLS} GROUP BY prompt_id""")
def call_stats(spark, d):
    s = runs.call_stats(table(spark, d, "model_calls"))
    return s.select("prompt_id", "calls", "first_ok", "repaired", "cached", r6(F.col("mean_seconds"), "mean_seconds"), r6(F.col("first_rate"), "first_rate"), "most_attempts")


@query(f"""SELECT config, k AS prompt_id, CAST(sum(v) AS BIGINT) AS calls, count(*) AS runs, min(v) AS least, max(v) AS most
FROM (SELECT config, unnest(map_keys(calls)) AS k, unnest(map_values(calls)) AS v FROM {_RUNS}) WHERE k <> 'total' GROUP BY config, k""")
def call_counts(spark, d):
    r = table(spark, d, "run_records").select("run_id", "config", "calls").dropDuplicates(["run_id"])
    return runs.call_counts(r)


@query(f"""SELECT config, count(*) AS records, count(*) FILTER (coalesce(error, '') <> '') AS errors, min(finished_at) AS first, max(finished_at) AS last, round(sum(seconds), 4) AS seconds FROM {_RUNS} GROUP BY config""")
def run_progress(spark, d):
    p = runs.progress(runs_(spark, d, "config", "error", "finished_at", "seconds"))
    return p.withColumn("seconds", F.round("seconds", 4))


@query(f"SELECT run_id, config, coalesce(CASE WHEN final <> '' THEN final END, draft) AS prediction FROM {_RUNS} WHERE {_OK} AND coalesce(gate_verdict, '') <> 'FAIL' AND regexp_matches(coalesce(final, ''), '[^\\s\\p{{Z}}]')")
def eligible_predictions(spark, d):
    r = runs_(spark, d, "config", "error", "gate_verdict", "final", "draft").where(runs.eligible())
    return r.select("run_id", "config", runs.prediction().alias("prediction"))


@query(f"""SELECT r.config, coalesce(lower(trim(p.split)), 'none') AS pair_split, count(*) AS n, count(*) FILTER (lower(trim(r.split)) = lower(trim(p.split))) AS same
FROM {_RUNS} r JOIN {_PAIRS} p ON r.pair_id = p.id GROUP BY ALL""")
def runs_join_pairs(spark, d):
    p = pairs_(spark, d, "split").select(F.col("id").alias("pair_id"), corpus.clean_split().alias("ps"))
    r = runs_(spark, d, "config", "pair_id", "split").join(p, "pair_id")
    return r.groupBy("config", F.coalesce("ps", F.lit("none")).alias("pair_split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(corpus.clean_split() == F.col("ps")).alias("same"))


@query(f"""SELECT config, count(*) AS claims, count(*) FILTER (len(c.ids) > 0) AS backed, count(DISTINCT run_id) AS runs FROM (SELECT config, run_id, unnest(final_claims) AS c FROM {_RUNS}) GROUP BY config""")
def claim_support(spark, d):
    r = table(spark, d, "run_records").select("run_id", "config", "final_claims").dropDuplicates(["run_id"]).select("run_id", "config", F.explode("final_claims").alias("c"))
    return r.groupBy("config").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.size("c.ids") > 0).alias("backed"), F.count_distinct("run_id").alias("runs"))


@query(f"""WITH s AS (SELECT config, seed, avg(support_rate) AS m FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL GROUP BY config, seed)
SELECT config, count(*) AS seeds, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS sd FROM s GROUP BY config""")
def seed_spread(spark, d):
    s = stats.seed_spread(runs.per_config_means(runs_(spark, d, "config", "seed", "pair_id", "error", "support_rate")))
    return s.select("config", "seeds", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))


_SCORES = f"""s AS (SELECT config, pair_id, avg(support_rate) AS x FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL GROUP BY ALL),
j AS (SELECT a.config, a.pair_id, a.x, b.x AS y FROM s a JOIN s b ON a.pair_id = b.pair_id AND b.config = '{_BASE}' WHERE a.config <> '{_BASE}')"""


def _paired(spark, d):
    return stats.paired(runs.per_config_means(runs_(spark, d, "config", "seed", "pair_id", "error", "support_rate")), _BASE)


@query(f"WITH {_SCORES} SELECT config, count(*) AS n, round(avg(x - y), 6) AS diff, count(*) FILTER (x > y) AS better, count(*) FILTER (x < y) AS worse FROM j GROUP BY config")
def paired_difference(spark, d):
    p = _paired(spark, d)
    return p.groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("x") - F.col("y")), "diff"), F.count_if(F.expr("x > y")).alias("better"), F.count_if(F.expr("x < y")).alias("worse"))


@query(f"""WITH {_SCORES}, c AS (SELECT a.config, avg(CASE WHEN a.x > b.y THEN 1.0 WHEN a.x < b.y THEN -1.0 ELSE 0 END) AS delta FROM j a JOIN j b ON a.config = b.config GROUP BY a.config)
SELECT c.config, n, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude
FROM c JOIN (SELECT config, count(*) AS n FROM j GROUP BY config) USING (config)""")
def cliffs_delta(spark, d):
    c = stats.cliffs_delta(_paired(spark, d))
    return c.select("config", "n", r6(F.col("delta"), "delta"), "magnitude")


@query(f"""WITH {_SCORES}, q AS (SELECT config, round(abs(x - y), 12) AS a, x > y AS up FROM j WHERE x <> y),
r AS (SELECT config, up, rank() OVER (PARTITION BY config ORDER BY a) + (count(*) OVER (PARTITION BY config, a) - 1) / 2 AS rk FROM q)
SELECT config, count(*) AS n, CAST(sum(CASE WHEN up THEN rk ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN up THEN 0 ELSE rk END) AS DOUBLE) AS w_minus FROM r GROUP BY config""")
def signed_ranks(spark, d):
    return stats.sign_ranks(_paired(spark, d))


@query(f"""WITH {_SCORES}, p AS (SELECT config, 1 - abs(avg(x - y)) AS p FROM j GROUP BY config), o AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, config) + 1) * p) AS raw FROM p),
a AS (SELECT config, p, max(raw) OVER (ORDER BY p, config ROWS UNBOUNDED PRECEDING) AS adj FROM o)
SELECT config, round(p, 6) AS p, round(adj, 6) AS adjusted, adj <= 0.05 AS reject FROM a""")
def holm_steps(spark, d):
    p = _paired(spark, d).groupBy("config").agg((1 - F.abs(F.avg(F.col("x") - F.col("y")))).alias("p"))
    return stats.holm(p).select("config", r6(F.col("p"), "p"), r6(F.col("adjusted"), "adjusted"), "reject")


@query(f"""WITH {_SCORES}, g AS (SELECT config, count(*) FILTER (x >= 0.5 AND y < 0.5) AS gained, count(*) FILTER (y >= 0.5 AND x < 0.5) AS lost FROM j GROUP BY config)
SELECT config, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 6) AS p FROM g""")
def mcnemar(spark, d):
    o = _paired(spark, d).select("config", (F.col("x") >= 0.5).alias("x"), (F.col("y") >= 0.5).alias("y"))
    return stats.mcnemar(o).withColumn("p", F.round("p", 6))


def _bootstrap_sql(resamples: int) -> str:
    return f"""u AS (SELECT config, x - y AS d, row_number() OVER (PARTITION BY config ORDER BY pair_id) - 1 AS place FROM j), z AS (SELECT config, count(*) AS n, avg(d) AS diff FROM u GROUP BY config),
w AS (SELECT config, r, CAST('0x' || substr(md5('7:' || r || ':' || i), 1, 8) AS BIGINT) % n AS place FROM (SELECT config, n, r, unnest(range(1, n + 1)) AS i FROM (SELECT config, n, unnest(range(1, {resamples} + 1)) AS r FROM z))),
m AS (SELECT config, r, avg(d) AS m FROM w JOIN u USING (config, place) GROUP BY ALL), k AS (SELECT config, list_sort(list(m)) AS l FROM m GROUP BY config),
ci AS (SELECT config, n, diff, l[{int(0.025 * resamples) + 1}] AS low, l[{min(int(0.975 * resamples), resamples - 1) + 1}] AS high FROM z JOIN k USING (config))"""


@query(f"WITH {_SCORES}, {_bootstrap_sql(400)} SELECT config, n, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def bootstrap_interval(spark, d):
    b = stats.paired_bootstrap(_paired(spark, d), 400)
    return b.select("config", "n", *(r6(F.col(c), c) for c in ("diff", "low", "high")))


@query(f"SELECT rounds_allowed, rounds_used, count(*) AS n, count(*) FILTER (best_round = 0) AS first_best, count(*) FILTER (gate_verdict = 'PASS') AS passed FROM {_RUNS} WHERE {_OK} GROUP BY ALL")
def round_table(spark, d):
    r = runs_(spark, d, "rounds_allowed", "rounds_used", "best_round", "gate_verdict", "error").where(~runs.failed())
    return r.groupBy("rounds_allowed", "rounds_used").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("best_round = 0")).alias("first_best"), F.count_if(F.expr("gate_verdict = 'PASS'")).alias("passed"))


# joins and checks --------------------------------------------------------------------------------------


@query(f"SELECT p.project, count(*) AS pairs, count(u.pair_id) AS units, count(*) FILTER (u.natspec IS NULL) AS no_text FROM {_PAIRS} p LEFT JOIN {_UNITS} u ON p.id = u.pair_id GROUP BY p.project")
def pairs_left_units(spark, d):
    u = units_(spark, d, "natspec").select(F.col("pair_id").alias("id"), F.lit(1).alias("has"), "natspec")
    return pairs_(spark, d, "project").join(u, "id", "left").groupBy("project").agg(F.count(F.lit(1)).alias("pairs"), F.count("has").alias("units"), F.count_if(F.expr("natspec is null")).alias("no_text"))


@query("SELECT DISTINCT m.file, u.x AS target FROM file_manifest m, unnest(m.unresolved_imports) AS u(x) WHERE u.x NOT IN (SELECT file FROM file_manifest)")
def unresolved_imports(spark, d):
    m = table(spark, d, "file_manifest")
    e = m.select(F.col("file").alias("src"), F.explode("unresolved_imports").alias("dst"))
    return graph.unresolved(e, m).select(F.col("src").alias("file"), F.col("dst").alias("target")).distinct()


@query("""SELECT CASE WHEN m.file IS NULL THEN 'extra' WHEN s.file IS NULL THEN 'missing' ELSE 'both' END AS state, count(*) AS n
FROM (SELECT DISTINCT file FROM file_manifest) m FULL JOIN (SELECT DISTINCT file FROM source_files) s ON m.file = s.file GROUP BY 1""")
def manifest_diff(spark, d):
    m = table(spark, d, "file_manifest").select("file").distinct().withColumn("m", F.lit(1))
    s = table(spark, d, "source_files").select("file").distinct().withColumn("s", F.lit(1))
    return m.join(s, "file", "full").groupBy(F.when(F.col("m").isNull(), "extra").when(F.col("s").isNull(), "missing").otherwise("both").alias("state")).agg(F.count(F.lit(1)).alias("n"))


# The checks run over all deliveries, and some of those are spoilt by a hash of their id: a stated change of the
# input, so that each check has something to find.
_SPOILT = """(SELECT id, file, code, code_start, code_end, doc_start, verified, params, CASE WHEN h % 13 = 0 THEN ' ' ELSE notice END AS notice, CASE WHEN h % 13 = 0 THEN NULL ELSE dev END AS dev,
 CASE WHEN h % 11 = 0 THEN doc_end + 500 ELSE doc_end END AS doc_end, CASE WHEN h % 17 = 0 THEN 'gone_' ELSE '' END AS prefix FROM (SELECT *, CAST('0x' || substr(sha1(id), 1, 6) AS INT) AS h FROM pairs))"""


@query(f"""WITH p AS (SELECT * FROM {_SPOILT}), places AS (SELECT DISTINCT id, file, doc_start, doc_end FROM p WHERE doc_start IS NOT NULL)
SELECT 'verified_have_prose' AS "check", count(*) AS n FROM p WHERE verified AND trim(coalesce(notice, '')) = '' AND trim(coalesce(dev, '')) = '' HAVING count(*) > 0
UNION ALL SELECT 'offsets_are_ordered', count(*) FROM p WHERE doc_start >= doc_end OR code_start >= code_end OR doc_end > code_start HAVING count(*) > 0
UNION ALL SELECT 'no_overlapping_docs', count(*) FROM (SELECT doc_start, lag(doc_end) OVER (PARTITION BY file ORDER BY doc_start, doc_end, id) AS b FROM places) WHERE b > doc_start HAVING count(*) > 0
UNION ALL SELECT 'unique_places', count(*) FROM (SELECT file, code_start FROM p GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'units_have_pairs', count(*) FROM (SELECT pair_id FROM retrieval_units WHERE pair_id NOT IN (SELECT id FROM p) GROUP BY pair_id) HAVING count(*) > 0
UNION ALL SELECT 'runs_have_pairs', count(*) FROM (SELECT pair_id FROM run_records WHERE pair_id NOT IN (SELECT id FROM p WHERE prefix = '') GROUP BY pair_id) HAVING count(*) > 0
UNION ALL SELECT 'params_round_trip', count(*) FROM (SELECT list_transform(regexp_split_to_array(regexp_extract(code, '^[^(]*\\(([^()]*)\\)', 1), ','), lambda x: regexp_extract(trim(x), '\\s([A-Za-z_$][\\w$]*)$', 1)) AS names, unnest(map_keys(params)) AS k, prefix FROM p) WHERE NOT list_contains(names, prefix || k) HAVING count(*) > 0""")
def violations(spark, d):
    h = F.conv(F.substring(F.sha1("id"), 1, 6), 16, 10).cast("int")
    p = table(spark, d, "pairs").select(
        "id", "file", "code", "code_start", "code_end", "doc_start", "verified", F.when(h % 13 == 0, " ").otherwise(F.col("notice")).alias("notice"), F.when(h % 13 != 0, F.col("dev")).alias("dev"),
        (F.col("doc_end") + F.when(h % 11 == 0, 500).otherwise(0)).alias("doc_end"), F.transform_keys("params", lambda k, _: F.concat(F.when(h % 17 == 0, "gone_").otherwise(""), k)).alias("params"), (h % 17 == 0).alias("odd"),
    )
    v = checks.violations(
        checks.verified_without_prose(p), checks.bad_offsets(p), checks.overlapping_docs(p.select("id", "file", "doc_start", "doc_end").distinct()), checks.duplicate_keys(p, "unique_places", "file", "code_start"),
        checks.dangling(table(spark, d, "retrieval_units"), p, "units_have_pairs", "pair_id", "id"), checks.dangling(table(spark, d, "run_records"), p.where(~F.col("odd")), "runs_have_pairs", "pair_id", "id"), checks.unknown_params(p),
    )
    return v.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT DISTINCT run_id, pair_id AS q, r.pair_id AS u, rn FROM (SELECT run_id, pair_id, unnest(retrieved) AS r, unnest(range(1, len(retrieved) + 1)) AS rn FROM {_RUNS})),
m AS (SELECT run_id, max(CAST(a.project = b.project AND rn <= 1 AS INT)) AS r1, max(CAST(a.project = b.project AND rn <= 3 AS INT)) AS r3 FROM e JOIN {_PAIRS} a ON a.id = q JOIN {_PAIRS} b ON b.id = u GROUP BY run_id)
SELECT count(*) AS queries, round(avg(coalesce(r1, 0)), 6) AS recall_at_1, round(avg(coalesce(r3, 0)), 6) AS recall_at_3 FROM (SELECT DISTINCT run_id FROM e) LEFT JOIN m USING (run_id)""")
def retrieved_recall(spark, d):
    r = table(spark, d, "run_records").select("run_id", "pair_id", "retrieved").dropDuplicates(["run_id"])
    e = r.select("run_id", F.col("pair_id").alias("q"), F.posexplode("retrieved").alias("at", "r")).select("run_id", "q", F.col("r.pair_id").alias("u"), (F.col("at") + 1).alias("rank"))
    p = pairs_(spark, d, "project")
    lab = e.join(p.select(F.col("id").alias("q"), F.col("project").alias("a")), "q").join(p.select(F.col("id").alias("u"), F.col("project").alias("b")), "u")
    per = lab.groupBy("run_id").agg(*(F.max(((F.col("a") == F.col("b")) & (F.col("rank") <= k)).cast("int")).alias(f"r{k}") for k in (1, 3)))
    return e.select("run_id").distinct().join(per, "run_id", "left").agg(F.count(F.lit(1)).alias("queries"), *(r6(F.avg(F.coalesce(f"r{k}", F.lit(0))), f"recall_at_{k}") for k in (1, 3)))


@query(f"""SELECT project, round(avg(CAST(coalesce(trim(views['code']), '') <> '' AS INT)), 6) AS code, round(avg(CAST(coalesce(trim(views['ast']), '') <> '' AS INT)), 6) AS ast,
 round(avg(CAST(coalesce(trim(views['cfg']), '') <> '' AS INT)), 6) AS cfg FROM (SELECT * FROM retrieval_units QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY indexed_at DESC) = 1) GROUP BY project""")
def view_coverage(spark, d):
    u = dedup.newest(table(spark, d, "retrieval_units"), "pair_id", "indexed_at", "project", "views")
    has = lambda v: F.avg((F.coalesce(F.trim(F.col("views")[v]), F.lit("")) != "").cast("int"))
    return u.groupBy("project").agg(*(r6(has(v), v) for v in ("code", "ast", "cfg")))


@query(f"""WITH p AS (SELECT id, signature, lower(trim(split)) AS split FROM {_PAIRS})
SELECT split, count(*) AS n, count(*) FILTER (signature IN (SELECT signature FROM p WHERE split = 'train')) AS known FROM p WHERE split IN ('val', 'test') GROUP BY split""")
def label_ceiling(spark, d):
    p = pairs_(spark, d, "signature", "split").withColumn("split", corpus.clean_split())
    t = p.where("split = 'train'").select("signature").distinct().withColumn("has", F.lit(1))
    return p.where("split in ('val', 'test')").join(t, "signature", "left").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("known"))


# retrieval and matching --------------------------------------------------------------------------------

_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[]))"


@query(f"""SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round({_DOT}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, u.vec_id) AS INT) AS rank
FROM embeddings q, embeddings u WHERE q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id QUALIFY rank <= 5""")
def vector_top_k(spark, d):
    e = table(spark, d, "embeddings")
    t = retrieval.top_k(e, e.where("vec_id % 20 = 0"), 5)
    return t.select("query_id", "unit_id", r6(F.col("score"), "score"), "rank")


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, u.vec_id) AS rank, q.label AS want, u.label AS got
 FROM embeddings q, embeddings u WHERE q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id),
m AS (SELECT query_id, max(CAST(want = got AND rank <= 1 AS INT)) AS r1, max(CAST(want = got AND rank <= 5 AS INT)) AS r5 FROM h GROUP BY query_id)
SELECT count(*) AS queries, round(avg(r1), 6) AS recall_at_1, round(avg(r5), 6) AS recall_at_5 FROM m""")
def recall_leave_one_out(spark, d):
    e = table(spark, d, "embeddings")
    r = retrieval.recall_at(retrieval.top_k(e, e.where("vec_id % 20 = 0"), 5), e.select(F.col("vec_id").alias("id"), "label"))
    return r.select("queries", r6(F.col("recall_at_1"), "recall_at_1"), r6(F.col("recall_at_5"), "recall_at_5"))


def _half_sql(name: str, lo: int, hi: int) -> str:
    dot = f"list_dot_product(CAST(q.embedding AS DOUBLE[])[{lo}:{hi}], CAST(u.embedding AS DOUBLE[])[{lo}:{hi}])"
    return f"SELECT q.vec_id AS query_id, '{name}' AS view, u.vec_id AS unit_id, {dot} AS score FROM embeddings q, embeddings u WHERE q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {dot} DESC, u.vec_id) <= 20"


@query(f"""WITH h AS ({_half_sql("left", 1, 32)} UNION ALL {_half_sql("right", 33, 64)}),
z AS (SELECT query_id, unit_id, CASE view WHEN 'left' THEN 0.6 ELSE 0.4 END * (score - avg(score) OVER w) / (CASE WHEN stddev_pop(score) OVER w > 1e-9 THEN stddev_pop(score) OVER w ELSE 1 END) AS z FROM h WINDOW w AS (PARTITION BY query_id, view)),
f AS (SELECT query_id, unit_id, round(sum(z), 6) AS fused FROM z GROUP BY ALL)
SELECT query_id, unit_id, fused FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, unit_id) <= 5) WHERE fused >= 1.0""")
def fused_search(spark, d):
    e = table(spark, d, "embeddings")
    hits = None
    for name, lo in (("left", 1), ("right", 33)):
        v = e.select("vec_id", F.slice("embedding", lo, 32).alias("embedding"))
        h = retrieval.top_k(v, v.where("vec_id % 20 = 0"), 20).withColumn("view", F.lit(name)).drop("rank")
        hits = h if hits is None else hits.unionByName(h)
    fused = retrieval.fuse(hits, {"left": 0.6, "right": 0.4}, 40).select("query_id", "unit_id", r6(F.col("fused"), "fused"))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "unit_id")
    return fused.withColumn("rn", F.row_number().over(w)).where("rn <= 5").where("fused >= 1.0").drop("rn")  # the best first, the threshold then


@query(f"""WITH k AS (SELECT sha1(regexp_replace(code, '\\s+', '', 'g')) AS e, min(id) AS target_id, count(*) AS candidates FROM {_PAIRS} WHERE code IS NOT NULL GROUP BY 1)
SELECT u.pair_id AS query_id, target_id, candidates FROM {_UNITS} u JOIN k ON k.e = sha1(regexp_replace(u.code, '\\s+', '', 'g'))""")
def match_exact(spark, d):
    q = units_(spark, d, "code").select(F.col("pair_id").alias("id"), "code")
    return matching.match(q, pairs_(spark, d, "code").select("id", "code")).where("how = 'exact'").select("query_id", "target_id", "candidates")


# graphs ------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.project AS s, b.project AS t FROM (SELECT pair_id, unnest(retrieved).pair_id AS u FROM {_RUNS}) x JOIN {_PAIRS} a ON a.id = x.pair_id JOIN {_PAIRS} b ON b.id = x.u),
c(s, t) AS (SELECT s, t FROM e UNION SELECT c.s, e.t FROM c JOIN e ON c.t = e.s) SELECT s AS src, t AS dst FROM c WHERE s <> t""")
def project_reach(spark, d):
    r = table(spark, d, "run_records").select("run_id", "pair_id", "retrieved").dropDuplicates(["run_id"]).select("pair_id", F.explode("retrieved.pair_id").alias("u"))
    p = pairs_(spark, d, "project")
    e = r.join(p.select(F.col("id").alias("pair_id"), F.col("project").alias("src")), "pair_id").join(p.select(F.col("id").alias("u"), F.col("project").alias("dst")), "u").select("src", "dst")
    return graph.fixpoint(e)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.project AS s, b.project AS t FROM retrieval_units a JOIN retrieval_units b ON a.group_id = b.group_id),
c(s, t) AS (SELECT s, t FROM e UNION SELECT c.s, e.t FROM c JOIN e ON c.t = e.s) SELECT s AS node, min(t) AS component FROM c GROUP BY s""")
def project_components(spark, d):
    u = table(spark, d, "retrieval_units").select("project", "group_id").distinct()
    e = u.join(u.groupBy("group_id").agg(F.min("project").alias("b")), "group_id").select(F.col("project").alias("a"), "b")
    return graph.components(e)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT pair_id AS s, unnest(retrieved).pair_id AS t FROM {_RUNS}), seed AS (SELECT id FROM {_PAIRS} WHERE lower(trim(split)) = 'test'),
c(node, depth) AS (SELECT id, 0 FROM seed UNION SELECT t, depth + 1 FROM c JOIN e ON c.node = e.s WHERE depth < 24) SELECT node, CAST(min(depth) AS INT) AS depth FROM c GROUP BY node""")
def exemplar_closure(spark, d):
    r = table(spark, d, "run_records").select("run_id", F.col("pair_id").alias("src"), "retrieved").dropDuplicates(["run_id"]).select("src", F.explode("retrieved.pair_id").alias("dst"))
    seeds = pairs_(spark, d, "split").where(corpus.clean_split() == "test").select("id")
    return graph.reach(seeds, r)


@query("""WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 1, a.n_nationkey + 5, a.n_nationkey - 5)),
p(start, path) AS (SELECT n_nationkey, [n_nationkey] FROM nation UNION ALL SELECT start, list_append(path, dst) FROM p JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, dst)),
f AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY path) - 1 AS k, count(*) OVER (PARTITION BY start) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = path[-1] AND NOT list_contains(path, dst)))
SELECT start, CAST(k AS INT) AS k, path, n > 16 AS truncated FROM f WHERE k < 16""")
def acyclic_paths(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    e = n.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.col("n_nationkey") + 1, F.col("n_nationkey") + 5, F.col("n_nationkey") - 5)).alias("dst"))
    return graph.acyclic_paths(n, e.join(n.select(F.col("n_nationkey").alias("dst")), "dst", "left_semi"))


# tables beside the corpus ------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount"), "avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = per.join(t("orders"), "o_orderkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, d):
    from ..streaming.append import sessions

    e = table(spark, d, "events")
    return sessions(e, "ts", "1 hour", "user_id").select("user_id", "start", "n")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    from ..streaming.append import windowed_counts

    w = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 minutes", "1 hour", None, "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
