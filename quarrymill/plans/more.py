"""Further queries of the core: projections, set operations, samples, windows, composite joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import comments, metrics, solidity, text
from ..operators import corpus, dedup, runs, stats
from ..session import table
from .catalogue import _CALLS, _OK, _PAIRS, _RUNS, _UNITS, pairs_, query, r6, runs_, units_

# projections and filters -------------------------------------------------------------------------------


@query("""SELECT project, count(*) AS files, count(*) FILTER (regexp_matches(file, '(?i)(^|/)(node_modules|packages|external|vendor|lib|mocks?|tests?|test|echidna|scripts)(/|$)') OR regexp_matches(file, '(^|/)(Mock|Test)[A-Z0-9_]')) AS vendored
FROM (SELECT file, project FROM file_manifest UNION SELECT regexp_replace(file, '/[^/]*/([^/]*)$', '/' || CASE length(file) % 4 WHEN 0 THEN 'Lib/' WHEN 1 THEN 'mocks/' WHEN 2 THEN 'core/Test_' ELSE 'libs/' END || '\\1'), project FROM file_manifest) GROUP BY project""")
def vendored_paths(spark, d):
    """The manifest's files, and the same once more in other folders by the length of their names: a stated addition, so that some are vendored."""
    m = table(spark, d, "file_manifest").select("file", "project")
    n = F.length("file") % 4
    moved = F.regexp_replace("file", F.lit("/[^/]*/([^/]*)$"), F.concat(F.lit("/"), F.when(n == 0, "Lib/").when(n == 1, "mocks/").when(n == 2, "core/Test_").otherwise("libs/"), F.lit("$1")))
    m = m.union(m.select(moved, "project")).distinct()
    return m.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.count_if(corpus.is_vendored(F.col("file"))).alias("vendored"))


@query(f"SELECT id, kind, file FROM {_PAIRS} WHERE lower(trim(split)) = 'test' AND kind IN ('function', 'constructor')")
def scope_filter(spark, d):
    return pairs_(spark, d, "split", "kind", "file").where((corpus.clean_split() == "test") & F.col("kind").isin("function", "constructor")).select("id", "kind", "file")


@query(f"SELECT CASE WHEN starts_with(lstrip_, '///') THEN 'lines' WHEN starts_with(lstrip_, '/**') THEN 'block' ELSE 'other' END AS style, count(*) AS n FROM (SELECT ltrim(doc_raw) AS lstrip_ FROM {_PAIRS} WHERE doc_raw IS NOT NULL) GROUP BY 1")
def comment_styles(spark, d):
    t = F.ltrim("doc_raw")
    style = F.when(t.startswith("///"), "lines").when(t.startswith("/**"), "block").otherwise("other")
    return pairs_(spark, d, "doc_raw").where("doc_raw is not null").groupBy(style.alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file, CAST(regexp_extract(pragma, '(\\d+)\\.(\\d+)\\.(\\d+)', 2) AS INT) AS minor, CAST(regexp_extract(pragma, '(\\d+)\\.(\\d+)\\.(\\d+)', 3) AS INT) AS patch FROM (SELECT DISTINCT file, pragma FROM file_manifest) WHERE regexp_matches(pragma, '\\d+\\.\\d+\\.\\d+')")
def pragma_floor(spark, d):
    p = r"(\d+)\.(\d+)\.(\d+)"
    m = table(spark, d, "file_manifest").select("file", "pragma").distinct().where(F.col("pragma").rlike(p))
    return m.select("file", F.regexp_extract("pragma", p, 2).cast("int").alias("minor"), F.regexp_extract("pragma", p, 3).cast("int").alias("patch"))


_TAGGED = "list_sort(list_distinct(regexp_extract_all(r.final, '@param\\s+(\\w+)', 1)))"


@query(f"""WITH x AS (SELECT r.run_id, {_TAGGED} AS got, list_sort(coalesce(map_keys(p.params), [])) AS want, len(regexp_extract_all(r.final, '@return')) AS rets, len(coalesce(p.returns, [])) AS n, trim(regexp_extract(r.final, '@notice([^@]*)', 1)) <> '' AS has_notice
 FROM {_RUNS} r JOIN {_PAIRS} p ON r.pair_id = p.id WHERE {_OK} AND r.final IS NOT NULL)
SELECT run_id, got = want AS param_exact, len(list_filter(got, lambda x: NOT list_contains(want, x))) > 0 AS param_invented, len(list_filter(want, lambda x: NOT list_contains(got, x))) > 0 AS param_missing, rets = n AS return_arity_ok, has_notice FROM x""")
def structural_predicates(spark, d):
    p = dedup.newest(table(spark, d, "pairs"), "id", "written_at", "params", "returns").withColumnRenamed("id", "pair_id")
    r = runs_(spark, d, "pair_id", "error", "final").where(~runs.failed()).where("final is not null").join(p, "pair_id")
    got = F.array_sort(F.array_distinct(F.regexp_extract_all("final", F.lit(r"@param\s+(\w+)"), F.lit(1))))
    want = F.array_sort(F.coalesce(F.map_keys("params"), F.array().cast("array<string>")))
    n = F.when(F.col("returns").isNull(), 0).otherwise(F.size("returns"))
    has = F.trim(F.regexp_extract("final", "@notice([^@]*)", 1)) != ""
    return r.select("run_id", (got == want).alias("param_exact"), (F.size(F.array_except(got, want)) > 0).alias("param_invented"), (F.size(F.array_except(want, got)) > 0).alias("param_missing"), (F.regexp_count("final", F.lit("@return")) == n).alias("return_arity_ok"), has.alias("has_notice"))


@query(f"SELECT id, sha1(concat_ws('|', project, signature)) AS group_key, split_part(arity_key, '/', 1) AS name, CAST(split_part(arity_key, '/', 2) AS INT) AS arity FROM {_PAIRS}")
def derived_keys(spark, d):
    p = pairs_(spark, d, "project", "signature", "arity_key")
    return p.select("id", F.sha1(F.concat_ws("|", "project", "signature")).alias("group_key"), F.split_part("arity_key", F.lit("/"), F.lit(1)).alias("name"), F.split_part("arity_key", F.lit("/"), F.lit(2)).cast("int").alias("arity"))


@query("SELECT CAST(doc_id % 1000 AS INT) AS shard, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents GROUP BY 1")
def shards(spark, d):
    return table(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(1000)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


_NOT_CODE = r"""("(?:\\.|[^"\\\r\n])*"?|''(?:\\.|[^''\\\r\n])*''?)|//[^\r\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**$)"""


@query(f"""SELECT file, length(src) AS chars, CAST(length(regexp_replace(regexp_replace(src, '{_NOT_CODE}', '', 'g'), '\\s+', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(src, '{_NOT_CODE}', 1), lambda x: length(x))), 0) AS INT) AS code_chars
FROM (SELECT * FROM source_files WHERE src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY fetched_at DESC, src DESC) = 1)""")
def stripped_code(spark, d):
    f = dedup.latest(table(spark, d, "source_files").where("src is not null"), "file", "fetched_at", "src")
    return f.select("file", F.length("src").alias("chars"), solidity.visible_code(F.col("src")).alias("code_chars"))


# joins -------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT file, signature, min(id) AS id FROM {_PAIRS} GROUP BY ALL)
SELECT r.run_id, m.id, m.id = r.pair_id AS same FROM {_RUNS} r JOIN m ON r.file = m.file AND r.signature = m.signature""")
def composite_key_join(spark, d):
    m = pairs_(spark, d, "file", "signature").groupBy("file", "signature").agg(F.min("id").alias("id"))
    return runs_(spark, d, "pair_id", "file", "signature").join(m, ["file", "signature"]).select("run_id", "id", (F.col("id") == F.col("pair_id")).alias("same"))




@query(f"""WITH p AS (SELECT id, container, signature, arity_key, inheritdoc FROM {_PAIRS}), x AS (SELECT container, signature, min(id) AS id FROM p WHERE inheritdoc IS NULL GROUP BY ALL)
SELECT p.id, x.id AS target FROM p LEFT JOIN x ON x.container = p.inheritdoc AND x.signature = p.signature WHERE p.inheritdoc IS NOT NULL""")
def inherit_resolution(spark, d):
    p = pairs_(spark, d, "container", "signature", "inheritdoc")
    x = p.where("inheritdoc is null").groupBy("container", "signature").agg(F.min("id").alias("target"))
    q = p.where("inheritdoc is not null").select("id", F.col("inheritdoc").alias("container"), "signature")
    return q.join(x, ["container", "signature"], "left").select("id", "target")




@query(f"""WITH b AS (SELECT project, lower(trim(split)) AS s FROM {_PAIRS} WHERE lower(trim(split)) IN ('train', 'val', 'test'))
SELECT a.s AS split_a, b.s AS split_b, count(DISTINCT a.project) AS shared FROM (SELECT DISTINCT * FROM b) a JOIN (SELECT DISTINCT * FROM b) b ON a.project = b.project AND a.s < b.s GROUP BY ALL""")
def split_overlaps(spark, d):
    s = pairs_(spark, d, "project", "split").select("project", corpus.clean_split().alias("s")).where("s in ('train', 'val', 'test')").distinct()
    return s.select("project", F.col("s").alias("split_a")).join(s.select("project", F.col("s").alias("split_b")), "project").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


@query(f"SELECT project FROM {_PAIRS} WHERE lower(trim(split)) = 'train' INTERSECT SELECT project FROM {_UNITS} EXCEPT SELECT project FROM {_PAIRS} WHERE lower(trim(split)) = 'test'")
def set_operations(spark, d):
    p = pairs_(spark, d, "project", "split").withColumn("s", corpus.clean_split())
    train, test = p.where("s = 'train'").select("project"), p.where("s = 'test'").select("project")
    return train.intersect(units_(spark, d, "project").select("project")).subtract(test)


# aggregates --------------------------------------------------------------------------------------------


@query(f"SELECT coalesce(lower(trim(split)), 'none') AS split_name, count(*) AS n, count(DISTINCT file) AS files, count(DISTINCT project) AS projects, count(DISTINCT group_id) AS groups FROM {_PAIRS} GROUP BY 1")
def distinct_counts(spark, d):
    p = pairs_(spark, d, "split", "file", "project", "group_id")
    return p.groupBy(F.coalesce(corpus.clean_split(), F.lit("none")).alias("split_name")).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"{c[:-3] if c.endswith('_id') else c}s") for c in ("file", "project", "group_id")))


@query(f"SELECT project, round(avg(CAST(verified AS INT)), 6) AS verified, round(avg(CAST(len(defects) = 0 AS INT)), 6) AS clean, round(avg(CAST(overrides AS INT)), 6) AS overrides FROM {_PAIRS} GROUP BY project")
def boolean_shares(spark, d):
    p = pairs_(spark, d, "project", "verified", "overrides", "defects")
    return p.groupBy("project").agg(r6(F.avg(F.col("verified").cast("int")), "verified"), r6(F.avg((F.size("defects") == 0).cast("int")), "clean"), r6(F.avg(F.col("overrides").cast("int")), "overrides"))


@query(f"""SELECT model, prompt_id, count(*) AS n, round(avg(CAST(coalesce(first_attempt_parsed, false) AS INT)), 6) AS parsed, round(avg(attempts), 6) AS attempts, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
 count(*) FILTER (loaded_at - started_at > INTERVAL 1 DAY) AS late FROM {_CALLS} GROUP BY ALL""")
def parse_rates(spark, d):
    c = dedup.latest(table(spark, d, "model_calls"), "call_id", "loaded_at", "model", "prompt_id", "first_attempt_parsed", "attempts", "prompt_tokens", "completion_tokens", "started_at")
    return c.groupBy("model", "prompt_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.coalesce("first_attempt_parsed", F.lit(False)).cast("int")), "parsed"), r6(F.avg("attempts"), "attempts"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count_if(F.expr("loaded_at - started_at > interval 1 day")).alias("late"),
    )


@query(f"""SELECT pair_id, config, run_id, round(support_rate, 6) AS support FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pair_id, config ORDER BY support_rate DESC, rounds_used NULLS FIRST, run_id DESC) = 1""")
def best_run(spark, d):
    r = runs_(spark, d, "pair_id", "config", "error", "support_rate", "rounds_used").where(~runs.failed()).where("support_rate is not null")
    key = F.struct(-F.col("support_rate"), F.col("rounds_used"), -F.col("run_id"), "run_id", "support_rate")
    return r.groupBy("pair_id", "config").agg(F.min(key).alias("b")).select("pair_id", "config", "b.run_id", r6(F.col("b.support_rate"), "support"))


@query(f"""SELECT config, day, n, CAST(sum(n) OVER (PARTITION BY config ORDER BY day) AS BIGINT) AS running FROM (SELECT config, strftime(finished_at, '%Y-%m-%d') AS day, count(*) AS n FROM {_RUNS} WHERE finished_at IS NOT NULL GROUP BY ALL)""")
def running_totals(spark, d):
    g = runs_(spark, d, "config", "finished_at").where("finished_at is not null").groupBy("config", F.date_format("finished_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy("config").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""WITH s AS (SELECT a.x AS seed, p.signature, CAST('0x' || substr(sha1(p.id || ':' || a.x), 1, 8) AS BIGINT) < 3435973836 AS train FROM {_PAIRS} p, (SELECT unnest(range(1, 6)) AS x) a),
k AS (SELECT DISTINCT seed, signature FROM s WHERE train), e AS (SELECT s.seed, count(*) AS n, count(k.signature) AS known FROM s LEFT JOIN k ON s.seed = k.seed AND s.signature = k.signature WHERE NOT train GROUP BY s.seed)
SELECT round(avg(known / n), 6) AS mean, round(stddev_pop(known / n), 6) AS sd, round(min(known / n), 6) AS least, round(max(known / n), 6) AS most FROM e""")
def split_effect(spark, d):
    p = pairs_(spark, d, "signature").select("id", "signature", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    h = F.conv(F.substring(F.sha1(F.concat_ws(":", "id", F.col("seed").cast("string"))), 1, 8), 16, 10).cast("long")
    s = p.withColumn("train", h < 3435973836)
    k = s.where("train").select("seed", "signature").distinct().withColumn("has", F.lit(1))
    e = s.where("not train").join(k, ["seed", "signature"], "left").groupBy("seed").agg((F.count("has") / F.count(F.lit(1))).alias("r"))
    return e.agg(r6(F.avg("r"), "mean"), r6(F.stddev_pop("r"), "sd"), r6(F.min("r"), "least"), r6(F.max("r"), "most"))




# samples, top-k, tables beside the corpus --------------------------------------------------------------


@query(f"SELECT id, project FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY project ORDER BY sha1(id), id) <= 5")
def stratified_sample(spark, d):
    p = pairs_(spark, d, "project").withColumn("h", F.sha1("id"))
    w = Window.partitionBy("project").orderBy("h", "id")
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("id", "project")


@query(f"SELECT id FROM {_PAIRS} ORDER BY sha1('7:' || id), id LIMIT 50")
def seeded_shuffle(spark, d):
    return pairs_(spark, d, "split").orderBy(F.sha1(F.concat(F.lit("7:"), F.col("id"))), "id").limit(50).select("id")


@query(f"SELECT config, run_id, rn AS place FROM (SELECT config, run_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY config) AS n FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL WINDOW w AS (PARTITION BY config ORDER BY support_rate, run_id)) WHERE (rn - 1) % greatest(1, n // 5) = 0")
def spread_examples(spark, d):
    r = runs_(spark, d, "config", "error", "support_rate").where(~runs.failed()).where("support_rate is not null")
    w = Window.partitionBy("config").orderBy("support_rate", "run_id")
    x = r.withColumn("place", F.row_number().over(w).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("config")))
    return x.where("(place - 1) % greatest(1, n div 5) = 0").select("config", "run_id", "place")


@query("""SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY spent DESC, c_custkey LIMIT 100""")
def top_customers(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count(F.lit(1)).alias("orders"))
    return o.join(table(spark, d, "customer"), "c_custkey").orderBy(F.desc("spent"), "c_custkey").limit(100).select("c_custkey", "c_name", "spent", "orders")


@query("""SELECT r_name, n_name, round(sum(s_acctbal), 2) AS balance, count(*) AS suppliers, grouping(n_name) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name))""")
def balance_by_region(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupingSets([["r_name", "n_name"], ["r_name"]], "r_name", "n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("balance"), F.count(F.lit(1)).alias("suppliers"), F.grouping("n_name").cast("long").alias("level"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, count(DISTINCT user_id) AS users, count(*) FILTER (props IS NULL) AS bare FROM events GROUP BY event_type""")
def event_quantiles(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(r6(F.percentile("value", 0.5), "median"), r6(F.percentile("value", 0.9), "p90"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("props").isNull()).alias("bare"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def event_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT p_brand, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 1 AND 15 AND l_quantity < 25 GROUP BY p_brand""")
def brand_revenue(spark, d):
    p = table(spark, d, "part").where("p_size between 1 and 15").select("p_partkey", "p_brand")
    li = table(spark, d, "lineitem").where("l_quantity < 25").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT file, CAST(count(*) AS BIGINT) AS deliveries, max(length(src)) AS chars FROM source_files GROUP BY file HAVING count(*) > 1 OR max(length(src)) IS NULL OR max(length(src)) = 0""")
def repeated_files(spark, d):
    f = table(spark, d, "source_files").groupBy("file").agg(F.count(F.lit(1)).alias("deliveries"), F.max(F.length("src")).cast("long").alias("chars"))
    return f.where("deliveries > 1 or chars is null or chars = 0")


@query("""SELECT coalesce(lang, 'none') AS lang, kind, count(*) AS n, count(text) AS texts, count(DISTINCT sha1(text)) AS distinct_texts, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY ALL""")
def document_census(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count_distinct(F.sha1("text")).alias("distinct_texts"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))


# comments as data --------------------------------------------------------------------------------------


#: Fields of runs' comments: (run_id, config, pair_id, key, body).
FIELDS_SQL = f"""c AS (SELECT run_id, config, pair_id, regexp_replace(replace(replace(final, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[ \\t]*(?:/\\*\\*?|\\*/|\\*|///?)?[ \\t]*|[ \\t]*\\*/[ \\t]*$', '', 'g') AS t FROM {_RUNS} WHERE {_OK} AND final IS NOT NULL),
s AS (SELECT run_id, config, pair_id, unnest(string_split(chr(10) || t, chr(10) || '@')) AS x, generate_subscripts(string_split(chr(10) || t, chr(10) || '@'), 1) AS i FROM c),
f AS (SELECT run_id, config, pair_id, i, CASE WHEN i = 1 THEN 'notice' ELSE replace(regexp_extract(x, '^[A-Za-z][\\w:-]*'), 'returns', 'return') END AS tag, trim(regexp_replace(CASE WHEN i = 1 THEN x ELSE regexp_replace(x, '^[A-Za-z][\\w:-]*', '') END, '\\s+', ' ', 'g')) AS body FROM s),
k AS (SELECT run_id, config, pair_id, i, CASE WHEN tag = 'param' THEN 'param:' || regexp_extract(body, '^\\S+') WHEN tag = 'return' THEN 'return:' || (row_number() OVER (PARTITION BY run_id, tag ORDER BY i) - 1) ELSE tag END AS key, CASE WHEN tag = 'param' THEN trim(regexp_replace(body, '^\\S+', '')) ELSE body END AS body FROM f),
fields AS (SELECT run_id, config, pair_id, key, string_agg(body, ' ' ORDER BY i) AS body FROM k WHERE body <> '' GROUP BY ALL)"""


@query(f"WITH {FIELDS_SQL} SELECT config, split_part(key, ':', 1) AS kind, count(*) AS n, count(DISTINCT run_id) AS runs FROM fields GROUP BY ALL")
def hypothesis_fields(spark, d):
    r = runs_(spark, d, "config", "error", "final").where(~runs.failed())
    f = r.select("config", "run_id", F.explode(comments.fields(F.col("final"))).alias("field", "text"))
    return f.groupBy("config", F.substring_index("field", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


@query()
def json_recovery(spark, d):
    c = dedup.latest(table(spark, d, "model_calls"), "call_id", "loaded_at", "prompt_id", "raw").withColumn("keys", comments.json_keys(F.col("raw")))
    need = F.when(F.col("prompt_id") == "L2", F.array(F.lit("verdict"), F.lit("defects"), F.lit("summary"))).when(F.col("prompt_id") == "L1b", F.array(F.lit("purpose"), F.lit("invariants"))).otherwise(F.array(F.lit("natspec"), F.lit("claims")))
    lacks = F.size(F.array_except(need, F.coalesce("keys", F.array().cast("array<string>"))))
    return c.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"), F.count("keys").alias("recovered"), F.count_if(F.col("keys").isNotNull() & (lacks > 0)).alias("incomplete"))


@query()
def exposed_completeness(spark, d):
    f = dedup.latest(table(spark, d, "source_files").where("src is not null"), "file", "fetched_at", "src")
    m = f.select("file", F.explode(comments.exposed(F.col("src"))).alias("m"))
    return m.groupBy("file").agg(F.count(F.lit(1)).alias("exposed"), F.count_if("m.documented").alias("documented"))
