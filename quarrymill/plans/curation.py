"""Queries on critics, samples, promotion, files and samples. Beside each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import emission
from ..operators import corpus, critics, curate, dedup, experiment, runs, tables
from ..session import table
from ..sources import index
from .catalogue import _OK, _PAIRS, _RUNS, pairs_, query, runs_, units_

# critics -------------------------------------------------------------------------------------------------------------

# The deterministic findings of a run are its pair's defects, and one on style for each run divisible by 5; the semantic
# ones are its claims without evidence, graded by their place, the first of each third run as contradicted, the second
# about the parameter of the pair's first defect: a stated input, as the test tables hold no findings.
_CRITICS = f"""r AS (SELECT r.run_id, r.config, list_concat(coalesce(p.defects, []), CASE WHEN run_id % 5 = 0 THEN ['style_citation:[F1]'] ELSE [] END) AS det, list_filter(list_transform(range(1, len(coalesce(final_claims, [])) + 1),
 lambda i: {{'i': i, 't': CASE WHEN run_id % 3 = 0 AND i = 1 THEN 'CONTRADICTED: ' ELSE 'UNSUPPORTED: ' END || trim(final_claims[i].text), 's': CASE i % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END, 'subject': CASE WHEN i = 2 AND contains(coalesce(p.defects, [])[1], ':') THEN split_part(coalesce(p.defects, [])[1], ':', 2) END, 'n': len(final_claims[i].ids)}}),
 lambda f: f.n = 0 OR (run_id % 2 = 0)) AS sem FROM {_RUNS} r JOIN {_PAIRS} p ON p.id = r.pair_id WHERE {_OK}),
n AS (SELECT *, list_transform(list_filter(det, lambda x: split_part(x, ':', 1) IN ('param_missing', 'param_empty', 'return_missing', 'return_empty', 'tag_dropped') AND contains(x, ':')), lambda x: regexp_replace(x, '^[^:]*:', '')) AS needed FROM r),
k AS (SELECT *, list_filter(sem, lambda f: f.subject IS NULL OR NOT list_contains(needed, f.subject)) AS kept, len(list_filter(det, lambda x: starts_with(x, 'style_') OR starts_with(x, 'access_'))) AS steer FROM n),
g AS (SELECT run_id, config, len(det) - steer AS blocking, len(det) + len(kept) AS total, len(sem) - len(kept) AS suppressed,
 CASE WHEN steer > 0 THEN 'style_citation:[F1]' ELSE list_sort(list_transform(kept, lambda f: {{'a': CASE WHEN starts_with(f.t, 'CONTRADICTED') THEN 0 ELSE 1 END, 'b': CASE f.s WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, 'i': f.i, 't': f.t}}))[1].t END AS first FROM k)"""


def _groups(spark, d):
    p = pairs_(spark, d, "defects").select(F.col("id").alias("pair_id"), F.coalesce("defects", F.array().cast("array<string>")).alias("defects"))
    r = dedup.latest(table(spark, d, "run_records"), "run_id", "loaded_at", "config", "pair_id", "error", "final_claims").where(~runs.failed()).join(p, "pair_id")
    style = F.when(F.col("run_id") % 5 == 0, F.array(F.lit("style_citation:[F1]"))).otherwise(F.array().cast("array<string>"))
    about = F.when(F.contains(F.try_element_at("defects", F.lit(1)), F.lit(":")), F.split_part(F.try_element_at("defects", F.lit(1)), F.lit(":"), F.lit(2)))

    def claim(c, i):
        verdict = F.when((F.col("run_id") % 3 == 0) & (i == 0), "CONTRADICTED").otherwise("UNSUPPORTED")
        severity = F.when((i + 1) % 3 == 0, "high").when((i + 1) % 3 == 1, "low").otherwise("medium")
        quote = F.trim(c["text"])
        return F.struct(F.size(c["ids"]).alias("k"), critics.finding("semantic", F.concat(verdict, F.lit(": "), quote), severity, None, c["ids"], F.when(i == 1, about)).alias("f"))

    claims = F.filter(F.transform(F.coalesce("final_claims", F.array().cast("array<struct<text:string,ids:array<string>>>")), claim), lambda x: (x["k"] == 0) | (F.col("run_id") % 2 == 0))
    return r.select("run_id", "config", critics.merge(critics.of_defects(F.concat("defects", style)), F.transform(claims, lambda x: x["f"])).alias("g"))


@query(f"WITH {_CRITICS} SELECT run_id, blocking, total, suppressed, total = 0 AS clean, first FROM g")
def critic_groups(spark, d):
    return _groups(spark, d).select("run_id", "g.blocking", "g.total", F.size("g.suppressed").alias("suppressed"), "g.clean", F.try_element_at("g.should_fix", F.lit(1))["text"].alias("first"))


@query(f"WITH {_CRITICS} SELECT config, count(*) AS n, CAST(sum(blocking) AS BIGINT) AS blocking, count(*) FILTER (total = 0) AS clean, CAST(sum(suppressed) AS BIGINT) AS suppressed FROM g GROUP BY config")
def critic_summary(spark, d):
    g = _groups(spark, d)
    return g.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum("g.blocking").alias("blocking"), F.count_if("g.clean").alias("clean"), F.sum(F.size("g.suppressed")).alias("suppressed"))


@query(f"""SELECT pair_id, config, arg_min(run_id, (b, t, -run_id)) AS run_id FROM (SELECT pair_id, config, run_id, CASE WHEN gate_verdict = 'PASS' THEN 0 ELSE 1 END AS b, coalesce(rounds_used, 0) AS t FROM {_RUNS} WHERE {_OK}) GROUP BY ALL""")
def chosen_round(spark, d):
    """Of the runs of a pair under a configuration, taken as its rounds, the one the loop would keep."""
    r = runs_(spark, d, "pair_id", "config", "error", "gate_verdict", "rounds_used").where(~runs.failed())
    attempt = F.struct(F.when(F.col("gate_verdict") == "PASS", 0).otherwise(1).alias("blocking"), F.coalesce("rounds_used", F.lit(0)).alias("total"), F.col("run_id").alias("round"))
    w = r.groupBy("pair_id", "config").agg(F.collect_list(attempt).alias("rounds"))  # the rounds of one function
    return w.select("pair_id", "config", critics.best_round(F.col("rounds"))["round"].alias("run_id"))


@query(f"""SELECT config, max(rounds_allowed) AS allowed, count(*) AS n, round(avg(rounds_used), 6) AS mean_rounds, count(*) FILTER (best_round > 0) AS later, CAST(min(calls['total']) AS INT) AS least_calls, CAST(max(calls['total']) AS INT) AS most_calls, round(avg(calls['total']), 6) AS mean_calls,
 round(sum(coalesce(calls['L7'], 0)) / count(*), 6) AS l7, round(sum(coalesce(calls['L2'], 0)) / count(*), 6) AS l2, round(count(*) FILTER (gate_verdict = 'FAIL') / nullif(count(gate_verdict), 0), 6) AS blocking FROM {_RUNS} WHERE {_OK} GROUP BY config""")
def loop_report(spark, d):
    r = dedup.newest(table(spark, d, "run_records"), "run_id", "loaded_at", "config", "error", "rounds_allowed", "rounds_used", "best_round", "calls", "gate_verdict").where(~runs.failed())
    per = lambda k: F.round(F.sum(F.coalesce(F.col("calls")[k], F.lit(0))) / F.count(F.lit(1)), 6)
    total = F.col("calls")["total"]
    return r.groupBy("config").agg(
        F.max("rounds_allowed").alias("allowed"), F.count(F.lit(1)).alias("n"), F.round(F.avg("rounds_used"), 6).alias("mean_rounds"), F.count_if(F.expr("best_round > 0")).alias("later"), F.min(total).alias("least_calls"),
        F.max(total).alias("most_calls"), F.round(F.avg(total), 6).alias("mean_calls"), per("L7").alias("l7"), per("L2").alias("l2"), F.round(F.try_divide(F.count_if(F.expr("gate_verdict = 'FAIL'")), F.count("gate_verdict")), 6).alias("blocking"),
    )


# curation -----------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT *, coalesce(project, '') || '|' || coalesce(container, '') || '|' || coalesce(signature, '') AS key FROM {_PAIRS}), k AS (SELECT DISTINCT key FROM p WHERE lower(trim(split)) = 'test'),
v AS (SELECT * FROM p WHERE verified), a AS (SELECT id, key, false AS promoted FROM v UNION ALL SELECT id, key, true FROM p WHERE NOT coalesce(verified, false) AND key IN (SELECT key FROM k) AND id NOT IN (SELECT id FROM v))
SELECT id, promoted, CASE WHEN key IN (SELECT key FROM k) THEN 'val' ELSE 'excluded' END AS split FROM a""")
def promoted_pairs(spark, d):
    p = pairs_(spark, d, "project", "container", "signature", "verified", "split")
    keys = p.where(corpus.clean_split() == "test").select(curate.pair_key().alias("key"))
    out = curate.promote(p.where("verified").drop("split"), p.where("not coalesce(verified, false)").drop("split"), keys, "val")
    return out.select("id", "promoted", "split")


@query(f"""WITH p AS (SELECT file, lower(trim(split)) AS s FROM {_PAIRS}) SELECT DISTINCT file FROM p WHERE s = 'train' AND file NOT IN (SELECT file FROM p WHERE s IN ('val', 'test')) AND file NOT IN (SELECT file FROM file_manifest WHERE role = 'dependency')""")
def retrieval_allow_list(spark, d):
    return curate.allow_list(pairs_(spark, d, "file", "split"), table(spark, d, "file_manifest").where("role = 'dependency'"))


@query(f"""WITH m AS (SELECT file, container AS contract, signature AS sig, CAST(row_number() OVER (ORDER BY id) AS INT) AS "index" FROM {_PAIRS}), s AS (SELECT file, 'st-' || printf('%05d', CAST(row_number() OVER (ORDER BY file) - 1 AS INT)) AS project FROM (SELECT DISTINCT file FROM m)),
k AS (SELECT project, project || '|' || contract || '|' || sig AS key, "index" FROM m JOIN s USING (file) WHERE contract IS NOT NULL) SELECT key, min("index") AS "index", count(*) - 1 AS clashes FROM k GROUP BY key""")
def staged_projects(spark, d):
    m = pairs_(spark, d, "file", "container", "signature").withColumn("index", F.row_number().over(Window.orderBy("id")))
    placed, clashes = curate.stage(m.where("container is not null").select("file", F.col("container").alias("contract"), F.col("signature").alias("sig"), "index").unionByName(m.where("container is null").select("file", F.lit("?").alias("contract"), F.col("signature").alias("sig"), "index")), "st")
    n = clashes.groupBy("key").agg(F.count(F.lit(1)).alias("clashes"))
    return placed.where("contract <> '?'").join(n, "key", "left").select("key", "index", F.coalesce("clashes", F.lit(0)).alias("clashes"))


@query(f"SELECT container_kind, count(*) AS n FROM {_PAIRS} WHERE container_kind IS NOT NULL GROUP BY 1 ORDER BY n DESC, container_kind LIMIT 3")
def most_common_kinds(spark, d):
    return curate.most_common(pairs_(spark, d, "container_kind"), "container_kind", 3)


@query(f"""WITH c AS (SELECT DISTINCT config FROM {_RUNS}), s AS (SELECT CAST(unnest(range(1, 41)) AS INT) AS seed), d AS (SELECT DISTINCT config, seed FROM {_RUNS} WHERE {_OK} AND run_id % 3 = 0) SELECT c.config, s.seed FROM c, s WHERE (config, seed) NOT IN (SELECT (config, seed) FROM d)""")
def open_runs(spark, d):
    r = runs_(spark, d, "config", "seed", "error")
    seeds = spark.range(1, 41).select(F.col("id").cast("int").alias("seed"))
    return curate.matrix(r.select("config").distinct(), seeds, r.where(~runs.failed()).where("run_id % 3 = 0"))


@query(f"""WITH r AS (SELECT p.defects, p.verified, list_transform(list_filter(final_claims, lambda c: len(c.ids) = 0), lambda c: CASE WHEN length(c.text) % 2 = 0 THEN 'high' ELSE 'low' END) AS rep FROM {_RUNS} r JOIN {_PAIRS} p ON p.id = r.pair_id WHERE {_OK}),
f AS (SELECT split_part(unnest(defects), ':', 1) AS family, coalesce(len(rep), 0) > 0 AS hit FROM r WHERE len(defects) > 0)
SELECT family, count(*) AS n, round(avg(CAST(hit AS INT)), 3) AS recall FROM f GROUP BY family UNION ALL SELECT 'verified', count(*), round(avg(CAST(coalesce(list_contains(rep, 'high'), false) AS INT)), 3) FROM r WHERE verified""")
def critic_calibration(spark, d):
    p = pairs_(spark, d, "defects", "verified").select(F.col("id").alias("pair_id"), "defects", "verified")
    r = dedup.latest(table(spark, d, "run_records"), "run_id", "loaded_at", "pair_id", "error", "final_claims").where(~runs.failed()).join(p, "pair_id")
    rep = F.transform(F.filter("final_claims", lambda c: F.size(c["ids"]) == 0), lambda c: F.struct(F.when(F.length(c["text"]) % 2 == 0, "high").otherwise("low").alias("severity")))
    r = r.withColumn("reported", rep)
    return curate.calibration(r.where("size(defects) > 0"), r.where("verified"))


@query("""WITH s AS (SELECT DISTINCT regexp_extract(u.x, '^(@[^/]*/[^/]*/)', 1) AS package, regexp_replace(u.x, '^@[^/]*/[^/]*/', '') AS rest FROM file_manifest m, unnest(m.unresolved_imports) AS u(x) WHERE starts_with(u.x, '@')),
d AS (SELECT DISTINCT 'donor' || (length(rest) % 3) || '/' || rest AS path, '0.' || (length(rest) % 2 + 7) AS version, rest, package FROM s WHERE length(rest) > 0),
h AS (SELECT package, regexp_replace(path, '/.*$', '/') AS root, rest, version FROM d), v AS (SELECT package, root, version, count(*) AS k FROM h GROUP BY ALL),
t AS (SELECT package, root, version FROM v QUALIFY row_number() OVER (PARTITION BY package, root ORDER BY k DESC, version DESC) = 1), z AS (SELECT package, root, count(DISTINCT rest) AS files FROM h GROUP BY ALL),
b AS (SELECT package, version, root, files FROM z JOIN t USING (package, root) QUALIFY row_number() OVER (PARTITION BY package, version ORDER BY files DESC, root) = 1) SELECT package, version, root, files FROM b QUALIFY row_number() OVER (PARTITION BY package ORDER BY files DESC, root) <= 4""")
def donor_trees(spark, d):
    """The imports that no file satisfies, looked for in donors that hold them by the length of their paths: a stated input."""
    spec = table(spark, d, "file_manifest").select(F.explode("unresolved_imports").alias("spec")).where("startswith(spec, '@')").distinct()
    _, rest = curate.split_spec()
    donors = spec.select(rest.alias("rest")).where("rest <> ''").select(F.concat(F.lit("donor"), F.length("rest") % 3, F.lit("/"), "rest").alias("path"), F.concat(F.lit("0."), F.length("rest") % 2 + 7).alias("version")).distinct()
    return curate.donor_trees(spec, donors)


# files ---------------------------------------------------------------------------------------------------------------


def _files(spark, d):
    return dedup.latest(table(spark, d, "source_files").where("src is not null"), "file", "fetched_at", "src")


@query()
def emitted_files(spark, d):
    """Each file with its documentation replaced by a sentence on every second function: how many were written, and whether the code stayed."""
    from ..functions import solidity

    f = _files(spark, d).select("file", "src", solidity.declared(F.col("src")).alias("d"))
    some = F.filter("d", lambda x: (x["kind"] == "function") & (F.length(x["name"]) % 2 == 0))
    record = F.transform(some, lambda x: F.struct(x["container"].alias("container"), x["signature"].alias("signature"), F.create_map(F.lit("notice"), F.concat(F.lit("Says what "), x["name"], F.lit(" does"))).alias("fields")))
    e = f.select("file", "src", F.size(some).alias("wanted"), emission.emitted(F.col("src"), record).alias("e"))
    e = e.withColumn("v", emission.verified(F.col("src"), F.col("e.emitted")))
    return e.select("file", "wanted", "e.placed", F.size("e.skipped").alias("skipped"), "v.code_unchanged", "v.exposed", "v.documented", F.round("v.completeness", 6).alias("completeness"))


@query()
def function_index(spark, d):
    """The index of all files' functions, refreshed from one that lacks or has an older text of a third of them."""
    f = _files(spark, d).select("file", "src")
    old = f.where("length(file) % 3 > 0").withColumn("src", F.when(F.length("file") % 3 == 1, F.concat(F.lit("// old\n"), "src")).otherwise(F.col("src")))
    files, functions = index.refresh(f, *index.build(old))
    return functions.select("file", "contract", "name", "nparams", "sig", "start", "ekey", "bkey", "ntok")


@query("""WITH m AS (SELECT file, sha1, bytes FROM file_manifest QUALIFY row_number() OVER (PARTITION BY file ORDER BY seen_at DESC, sha1) = 1), s AS (SELECT file, sha1(max(src)) AS sha1, max(octet_length(CAST(src AS BLOB))) AS bytes FROM source_files WHERE src IS NOT NULL GROUP BY file)
SELECT CASE WHEN m.file IS NULL THEN 'extra' WHEN s.file IS NULL THEN 'missing' WHEN m.sha1 <> s.sha1 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM m FULL JOIN s USING (file) GROUP BY 1""")
def manifest_hashes(spark, d):
    from ..operators import checks

    m = table(spark, d, "file_manifest").groupBy("file").agg(F.min(F.struct(F.col("seen_at").cast("timestamp"), "sha1")).alias("a"), F.max(F.struct("seen_at", "sha1")).alias("b"))
    s = table(spark, d, "source_files").where("src is not null").groupBy("file").agg(F.max("src").alias("src"))
    return checks.manifest_states(m.select("file", "b.sha1"), s.select("file", F.sha1("src").alias("sha1"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS (SELECT pair_id, views, natspec FROM retrieval_units QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY indexed_at DESC) = 1), p AS (SELECT id, kind, doc_raw, doc_spans, doc_start, doc_end FROM {_PAIRS})
SELECT 'docs_are_single_comments' AS "check", count(*) AS n FROM p WHERE length(doc_raw) - length(replace(doc_raw, '/**', '')) > 3 OR (contains(doc_raw, '/**') AND (contains(doc_raw, '///') OR len(doc_spans) <> 1)) HAVING count(*) > 0
UNION ALL SELECT 'spans_have_ends', count(*) FROM p WHERE len(doc_spans) > 0 AND (doc_spans[1][1] <> doc_start OR doc_spans[len(doc_spans)][2] <> doc_end) HAVING count(*) > 0
UNION ALL SELECT 'candidates', count(*) FROM p WHERE kind IN ('function', 'constructor', 'fallback', 'receive', 'modifier', 'event', 'error') HAVING count(*) > 0""")
def doc_checks(spark, d):
    from ..operators import checks

    p = pairs_(spark, d, "kind", "doc_raw", "doc_spans", "doc_start", "doc_end")
    v = checks.not_single_docs(p).unionByName(checks.odd_spans(p)).unionByName(p.where(corpus.is_candidate()).select(F.lit("candidates").alias("check"), F.col("id").alias("key"), F.lit("").alias("detail")))
    return v.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT final FROM {_RUNS} WHERE {_OK}) SELECT CASE WHEN starts_with(ltrim(coalesce(final, '')), '/**') THEN '/**' WHEN starts_with(ltrim(coalesce(final, '')), '///') THEN '///' WHEN starts_with(ltrim(coalesce(final, '')), '//') THEN '//' ELSE 'bare or empty' END AS marker, count(*) AS n FROM r GROUP BY 1""")
def comment_markers(spark, d):
    r = runs_(spark, d, "error", "final").where(~runs.failed())
    return r.groupBy(runs.marker(F.col("final")).alias("marker")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT p.id AS pair_id, c.config, s.seed, p.name FROM {_PAIRS} p, (SELECT unnest(['full', 'bare']) AS config) c, (SELECT CAST(unnest([1, 2]) AS INT) AS seed) s WHERE p.kind = 'function'),
d AS (SELECT DISTINCT 'full' AS config, 1 AS seed, pair_id FROM {_RUNS} WHERE {_OK})
SELECT config, seed, count(*) AS n, count(*) FILTER (length(name) % 7 = 0) AS errors, min(CASE WHEN length(name) % 7 <> 0 THEN '@notice ' || upper(name) || ' ' || seed || ' ' || config END) AS first FROM t WHERE (config, seed, pair_id) NOT IN (SELECT (config, seed, pair_id) FROM d) GROUP BY config, seed""")
def experiment_matrix(spark, d):
    """A stub generator over every function, configuration and seed that is not done; names of a length divisible by 7 make it fail."""
    contexts = pairs_(spark, d, "name", "kind").where("kind = 'function'").select(F.col("id").alias("pair_id"), "name")
    configs, seeds = (spark.createDataFrame(x, s) for x, s in (([("full",), ("bare",)], "config string"), ([(1,), (2,)], "seed int")))
    done = runs_(spark, d, "pair_id", "error").select(F.lit("full").alias("config"), F.lit(1).alias("seed"), "pair_id", "error")

    def make(seed: int):
        def write(row: dict) -> str:
            if len(row["name"]) % 7 == 0:
                raise ValueError("no answer")
            return f"@notice {row['name'].upper()} {seed} {row['config']}"

        return write

    out = experiment.generate(experiment.open_tasks(contexts, curate.matrix(configs, seeds), done), make)
    return out.groupBy("config", "seed").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"), F.min("final").alias("first"))


@query(f"""WITH w AS (SELECT config, pair_id, avg(support_rate) AS s FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL GROUP BY ALL), g AS (SELECT pair_id, round(max(s) - min(s), 6) AS score FROM w GROUP BY pair_id)
SELECT * FROM (SELECT 'gap' AS how, pair_id, score FROM g ORDER BY score DESC, pair_id DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'worst', pair_id, score FROM g ORDER BY score, pair_id LIMIT 10)
UNION ALL SELECT 'spread', pair_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pair_id DESC) - 1 AS rn, count(*) OVER () // 10 AS step FROM g) WHERE rn % step = 0 AND rn < 10 * step""")
def example_units(spark, d):
    s = runs.per_config_means(runs_(spark, d, "config", "seed", "pair_id", "error", "support_rate")).groupBy("config", "pair_id").agg(F.avg("score").alias("score"))
    g = tables.gaps(s).withColumn("score", F.round("score", 6))
    out = [tables.picked(g, how, 10).select(F.lit(how).alias("how"), "pair_id", "score") for how in ("gap", "worst", "spread")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE '(no gold comment)' END AS gold FROM (SELECT id, list_concat(list_filter([CASE WHEN trim(notice) <> '' THEN '@notice ' || trim(notice) END, CASE WHEN trim(dev) <> '' THEN '@dev ' || trim(dev) END], lambda x: x IS NOT NULL),
 list_transform(list_sort(coalesce(map_keys(params), [])), lambda k: '@param ' || k || ' ' || coalesce(params[k], '')), list_transform(coalesce(returns, []), lambda r: '@return ' || trim(concat_ws(' ', r.name, r.text)))) AS l FROM {_PAIRS})""")
def gold_comments(spark, d):
    return dedup.newest(table(spark, d, "pairs"), "id", "written_at", "notice", "dev", "params", "returns").select("id", tables.gold_comment().alias("gold"))
