"""Queries that compare systems: metrics on slices, tests, baselines, matching. Beside each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments, metrics, text
from ..operators import classify, corpus, dedup, matching, retrieval, runs, stats, tables
from ..session import table
from .more import FIELDS_SQL
from .catalogue import _BASE, _CALLS, _OK, _PAIRS, _RUNS, _SCORES, _UNITS, _bootstrap_sql, _paired, bleu_sql, bleu_sums_sql, pairs_, pairs_with_maps, query, r6, runs_, split_words, units_

# No run of the test tables repeats its reference, so each run whose number is divisible by 11 is taken to have said
# just that, and one divisible by 7 a notice of training: stated changes of the input.
_NOTICE = "trim(regexp_replace(regexp_replace(regexp_extract(final, '@notice([^@]*)', 1), '[/*]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_FIRST = f"(SELECT min(trim(notice)) AS first_train FROM {_PAIRS} WHERE lower(trim(split)) = 'train' AND trim(notice) <> '')"
_SAID = f"""(SELECT r.run_id, r.config, r.seed, r.pair_id, r.support_rate, r.has_sigma, p.kind, CASE WHEN run_id % 7 = 0 THEN first_train ELSE p.notice END AS notice,
 CASE WHEN run_id % 11 = 0 THEN CASE WHEN run_id % 7 = 0 THEN first_train ELSE p.notice END ELSE {_NOTICE} END AS said FROM {_RUNS} r JOIN {_PAIRS} p ON p.id = r.pair_id, {_FIRST} WHERE {_OK} AND final IS NOT NULL)"""


def notice_of(c):
    """The text under notice in a comment as models write it, in one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, "@notice([^@]*)", 1), "[/*]+", " "), r"\s+", " "))


def _said(spark, d):
    p = pairs_(spark, d, "notice", "kind", "split")
    first = p.where((corpus.clean_split() == "train") & (F.trim("notice") != "")).agg(F.min(F.trim("notice")).alias("first_train"))
    r = runs_(spark, d, "config", "seed", "pair_id", "error", "final", "support_rate", "has_sigma").where(~runs.failed()).where("final is not null")
    x = r.join(p.select(F.col("id").alias("pair_id"), "notice", "kind"), "pair_id").join(F.broadcast(first), how="cross")  # one row
    x = x.withColumn("notice", F.when(F.col("run_id") % 7 == 0, F.col("first_train")).otherwise(F.col("notice")))
    return x.withColumn("said", F.when(F.col("run_id") % 11 == 0, F.col("notice")).otherwise(notice_of(F.col("final")))).drop("first_train", "final", "error")


def _rows(extra: str = "config", where: str = "true", source: str = _SAID) -> str:
    return f"SELECT {extra}, {split_words('coalesce(said, chr(32))')} AS c, {split_words('notice')} AS r FROM {source} WHERE trim(notice) <> '' AND ({where})"


_TRAIN = f"(SELECT DISTINCT trim(notice) AS k FROM {_PAIRS} WHERE lower(trim(split)) = 'train')"
_LADDER = f"(SELECT *, trim(notice) = trim(said) AS same, trim(notice) IN (SELECT k FROM {_TRAIN} WHERE k IS NOT NULL) AS leaked FROM {_SAID} WHERE trim(notice) <> '')"
_STEPS = {"all": "true", "not reproduced": "NOT same", "not leaked": "NOT leaked", "neither": "NOT same AND NOT leaked"}


@query(f"SELECT config, subset, n, empty, round({bleu_sql(tables.WEIGHTS['ba'])}, 2) AS ba FROM ({bleu_sums_sql(' UNION ALL '.join(_rows(f'config, {chr(39)}{k}{chr(39)} AS subset', w, _LADDER) for k, w in _STEPS.items()), 'config, subset')})")
def subset_ladder(spark, d):
    train = pairs_(spark, d, "split", "notice").where(corpus.clean_split() == "train").select(F.col("notice").alias("text"))
    x = _said(spark, d).where("trim(notice) <> ''")
    return tables.bleu_table(tables.ladder(x, "notice", "said", train), ["config", "subset"], "said", "notice")


@query(f"SELECT run_id, config FROM {_LADDER} WHERE leaked AND run_id % 7 = 0 UNION ALL SELECT run_id, config FROM {_LADDER} WHERE leaked AND run_id % 7 <> 0")
def seen_in_training(spark, d):
    train = pairs_(spark, d, "split", "notice").where(corpus.clean_split() == "train").select(F.trim("notice").alias("k")).where("k is not null").distinct()
    x = _said(spark, d).where("trim(notice) <> ''")
    return x.withColumn("k", F.trim("notice")).join(train, "k", "left_semi").select("run_id", "config")


_SYSTEMS = f"(SELECT config, 'run' AS system, leaked, notice, said FROM {_LADDER} UNION ALL SELECT config, 'first words', leaked, notice, array_to_string(({split_words('coalesce(said, chr(32))')})[1:6], ' ') FROM {_LADDER})"


@query(f"""SELECT config, system, slice, n, round({bleu_sql(tables.WEIGHTS['ba'])}, 2) AS ba, round({bleu_sql(tables.WEIGHTS['b1'])}, 2) AS b1 FROM ({bleu_sums_sql(_rows("config, system, 'all' AS slice", "true", _SYSTEMS) + " UNION ALL " + _rows("config, system, CASE WHEN leaked THEN 'seen' ELSE 'unseen' END", "true", _SYSTEMS), "config, system, slice")})""")
def seen_unseen_bleu(spark, d):
    """Runs and a baseline, the first six words of each, over the same rows, by whether training has the reference."""
    train = pairs_(spark, d, "split", "notice").where(corpus.clean_split() == "train").select(F.trim("notice").alias("k")).where("k is not null").distinct().withColumn("leaked", F.lit(True))
    x = _said(spark, d).where("trim(notice) <> ''").withColumn("k", F.trim("notice")).join(train, "k", "left")
    x = x.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("leaked"), "seen").otherwise("unseen"))))
    words = F.filter(F.split(F.coalesce("said", F.lit("")), r"\s+"), lambda w: w != "")
    system = lambda name, c: F.struct(F.lit(name).alias("system"), c.alias("hyp"))
    x = x.withColumn("s", F.explode(F.array(system("run", F.col("said")), system("first words", F.array_join(F.slice(words, 1, 6), " "))))).select("*", "s.*")
    return tables.bleu_table(x, ["config", "system", "slice"], "hyp", "notice", ("ba", "b1")).drop("empty")


_ORDER = ["full", "looped", "draft_only", "no_retrieval"]


@query(f"""WITH s AS ({bleu_sums_sql(_rows("config"), "config")}),
g AS (SELECT config, avg(r1) AS r1 FROM (SELECT config, coalesce(2.0 * list_sum(list_transform(list_distinct(c), lambda g: least(len(list_filter(c, lambda x: x = g)), len(list_filter(r, lambda x: x = g))))) / (len(c) + len(r)), 0) AS r1 FROM ({_rows("config")})) GROUP BY config)
SELECT CASE config WHEN 'full' THEN 1 WHEN 'looped' THEN 2 WHEN 'draft_only' THEN 3 WHEN 'no_retrieval' THEN 4 ELSE 5 END AS place, config, n, empty, {", ".join(f"round({bleu_sql(w)}, 2) AS {k}" for k, w in tables.WEIGHTS.items())}, round(100 * r1, 2) AS rouge_1 FROM s JOIN g USING (config)""")
def metric_table(spark, d):
    x = _said(spark, d).where("trim(notice) <> ''").withColumn("said", F.coalesce("said", F.lit("")))
    t = tables.bleu_table(x, ["config"], "said", "notice", tuple(tables.WEIGHTS))
    rouge = x.groupBy("config").agg(F.round(100 * F.avg(metrics.rouge_n(F.col("said"), F.col("notice"), 1)), 2).alias("rouge_1"))
    return tables.in_order(t.join(rouge, "config"), "config", _ORDER)


@query(f"""WITH s AS ({bleu_sums_sql(_rows("config, seed"), "config, seed")}), f AS (SELECT config, seed, {bleu_sql(tables.WEIGHTS['ba'])} AS ba FROM s)
SELECT config, count(*) AS folds, round(avg(round(ba, 2)), 6) AS mean FROM f GROUP BY config""")
def fold_means(spark, d):
    x = _said(spark, d)
    per = tables.bleu_table(x, ["config", "seed"], "said", "notice")
    return tables.mean_of_groups(per, ["config"], "seed", "ba").select("config", "folds", r6(F.col("mean"), "mean"))


# one function's score ---------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9_]+')"


def sentence_bleu_sql(c: str, r: str) -> str:
    """Sentence BLEU of two lists of words, as an expression over columns ``c`` and ``r``."""
    gram = lambda t, n: f"list_transform(range(1, greatest(len({t}) - {n} + 2, 1)), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"
    hit = lambda n: f"coalesce(list_sum(list_transform(list_distinct({gram(c, n)}), lambda g: least(len(list_filter({gram(c, n)}, lambda x: x = g)), len(list_filter({gram(r, n)}, lambda x: x = g))))), 0)"
    logs = " + ".join(f"CASE WHEN len({c}) < {n} THEN 0 ELSE ln(({hit(n)} + {int(n > 1)}) / (len({c}) - {n - 1} + {int(n > 1)})) END" for n in (1, 2, 3, 4))
    return f"CASE WHEN len({c}) = 0 OR len({r}) = 0 OR {hit(1)} = 0 THEN 0.0 ELSE exp(({logs}) / least(4, len({c}))) * CASE WHEN len({c}) > len({r}) THEN 1.0 ELSE exp(1 - len({r}) / len({c})) END END"


_SCORED = f"(SELECT *, {_TOKENS.format(x='said')} AS c, {_TOKENS.format(x='notice')} AS r FROM {_SAID})"
_METRIC = f"coalesce(support_rate, CASE WHEN trim(notice) <> '' THEN {sentence_bleu_sql('c', 'r')} END, 0.0)"


@query(f"SELECT run_id, round({sentence_bleu_sql('c', 'r')}, 6) AS bleu FROM {_SCORED} WHERE trim(notice) <> ''")
def sentence_bleu(spark, d):
    x = _said(spark, d).where("trim(notice) <> ''")
    return x.select("run_id", r6(metrics.sentence_bleu(F.col("said"), F.col("notice")), "bleu"))


def _metric():
    bleu = F.when(F.trim("notice") != "", metrics.sentence_bleu(F.col("said"), F.col("notice")))
    return F.coalesce("support_rate", bleu, F.lit(0.0))


@query(f"SELECT config, seed, count(*) AS n, count(*) FILTER (support_rate IS NULL) AS fallbacks, round(avg({_METRIC}), 6) AS metric FROM {_SCORED} GROUP BY config, seed")
def fallback_metric(spark, d):
    x = _said(spark, d).withColumn("m", _metric())
    return x.groupBy("config", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("support_rate").isNull()).alias("fallbacks"), r6(F.avg("m"), "metric"))


_SEEDS = f"s AS (SELECT config, seed, avg(support_rate) AS m FROM {_RUNS} WHERE {_OK} AND support_rate IS NOT NULL GROUP BY ALL), sd AS (SELECT config, coalesce(stddev_samp(m), 0) AS sd FROM s GROUP BY config)"
_VERDICTS = f"SELECT a.config, abs(avg(a.x - b.x)) > (SELECT max(sd) / 4 FROM sd WHERE config = '{_BASE}') AS finding FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.k = b.k AND b.config = '{_BASE}' WHERE a.config <> '{_BASE}'"


@query(f"""WITH {_SEEDS}, m AS (SELECT config, pair_id, any_value(kind) AS k, avg(support_rate) AS x FROM {_SAID} WHERE support_rate IS NOT NULL GROUP BY config, pair_id),
n AS ({_VERDICTS} AND a.k = 'function' AND a.config <> 'looped' GROUP BY a.config), w AS ({_VERDICTS} GROUP BY a.config)
SELECT coalesce(n.config, w.config) AS config, n.finding AS narrow, w.finding AS wide, CASE WHEN n.finding IS NULL OR w.finding IS NULL THEN 'not run in both' WHEN n.finding = w.finding THEN 'unchanged' WHEN n.finding THEN 'LOST' ELSE 'GAINED' END AS change FROM n FULL JOIN w ON n.config = w.config""")
def scope_comparison(spark, d):
    """Differences beyond a quarter of the noise between seeds, among functions (without one configuration) and among all declarations."""
    x = _said(spark, d).where("support_rate is not null")
    sd = stats.seed_spread(runs.per_config_means(runs_(spark, d, "config", "seed", "pair_id", "error", "support_rate"))).withColumn("sd", F.col("sd") / 4)

    def verdicts(rows):
        pairs = stats.paired(rows.withColumn("score", F.col("support_rate")), _BASE)
        diff = pairs.groupBy("config").agg(F.avg(F.col("x") - F.col("y")).alias("diff"))
        return stats.within_noise(diff, sd, _BASE).select("config", (~F.col("within_noise")).alias("finding"))

    return stats.compare_scopes(verdicts(x.where("kind = 'function' and config <> 'looped'")), verdicts(x))


# 1 - erf by Simpson's rule, as DuckDB has no error function
_ERFC = "(1 - sqrt(2 / pi()) * (z / 3000) * list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 1000) * (z * i / 1000) / 2))))"
_WILCOXON = f"""q AS (SELECT config, round(abs(x - y), 12) AS a, x > y AS up FROM j WHERE x <> y), rk AS (SELECT config, up, rank() OVER (PARTITION BY config ORDER BY a) + (count(*) OVER (PARTITION BY config, a) - 1) / 2 AS rk FROM q),
ws AS (SELECT config, count(*) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS wp, sum(CASE WHEN up THEN 0 ELSE rk END) AS wm FROM rk GROUP BY config),
zs AS (SELECT config, n, greatest(abs(least(wp, wm) - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM ws), ps AS (SELECT config, n, least(1.0, {_ERFC}) AS p FROM zs),
ho AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, config) + 1) * p) AS raw FROM ps), ha AS (SELECT config, n, p, max(raw) OVER (ORDER BY p, config ROWS UNBOUNDED PRECEDING) AS adjusted FROM ho)"""


@query(f"WITH {_SCORES}, {_WILCOXON} SELECT config, n, round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS reject FROM ha")
def wilcoxon_holm(spark, d):
    t = stats.holm(stats.wilcoxon(_paired(spark, d)))
    return t.select("config", "n", r6(F.col("p"), "p"), r6(F.col("adjusted"), "adjusted"), "reject")


@query(f"""WITH {_SCORES}, {_WILCOXON}, {_bootstrap_sql(400)}, {_SEEDS.replace("s AS", "se AS", 1).replace("FROM s ", "FROM se ")},
cl AS (SELECT a.config, avg(CASE WHEN a.x > b.y THEN 1.0 WHEN a.x < b.y THEN -1.0 ELSE 0 END) AS delta FROM j a JOIN j b ON a.config = b.config GROUP BY a.config)
SELECT ci.config, ci.n, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, '[' || printf('%.3f', low) || ', ' || printf('%.3f', high) || ']' AS interval, round(p, 6) AS p, round(adjusted, 6) AS adjusted, (low > 0 OR high < 0) AND p < 0.05 AS significant, adjusted <= 0.05 AS reject,
 round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude,
 NOT abs(diff) > (SELECT sd FROM sd WHERE config = '{_BASE}') AS within_noise FROM ci JOIN ha USING (config) JOIN cl USING (config)""")
def ablation_table(spark, d):
    p = _paired(spark, d)
    t = stats.paired_bootstrap(p, 400).join(stats.holm(stats.wilcoxon(p)).select("config", "p", "adjusted", "reject"), "config").join(stats.cliffs_delta(p).select("config", "delta", "magnitude"), "config")
    sd = stats.seed_spread(runs.per_config_means(runs_(spark, d, "config", "seed", "pair_id", "error", "support_rate")))
    t = stats.within_noise(stats.significant(t), sd, _BASE).drop("noise")
    return t.select("config", "n", tables.interval(F.col("low"), F.col("high")).alias("interval"), *(r6(F.col(c), c) for c in ("diff", "low", "high", "p", "adjusted", "delta")), "significant", "reject", "magnitude", "within_noise")


@query(f"""WITH m AS (SELECT config, coalesce(has_sigma, false) AS facts, avg(support_rate) AS support, count(*) AS n FROM {_SAID} WHERE config IN ('full', 'looped') GROUP BY ALL)
SELECT facts, b.support AS support_before, a.support AS support_after, round(a.support - b.support, 6) AS support_change, b.n AS n_before, a.n AS n_after, a.n - b.n AS n_change FROM (SELECT facts, n, round(support, 6) AS support FROM m WHERE config = 'full') b FULL JOIN (SELECT facts, n, round(support, 6) AS support FROM m WHERE config = 'looped') a USING (facts)""")
def before_after(spark, d):
    m = _said(spark, d).groupBy("config", F.coalesce("has_sigma", F.lit(False)).alias("facts")).agg(r6(F.avg("support_rate"), "support"), F.count(F.lit(1)).alias("n"))
    c = tables.changes(m.where("config = 'full'"), m.where("config = 'looped'"), ["facts"], ["support", "n"])
    return c.withColumn("support_change", F.round("support_change", 6))


# counts that disagree: each run whose number is divisible by 6 is taken to state one call more
@query(f"""WITH c AS (SELECT run_id, count(*) AS n FROM {_CALLS} GROUP BY run_id), r AS (SELECT run_id, CAST(calls['total'] AS INT) + CASE WHEN run_id % 6 = 0 THEN 1 ELSE 0 END AS stated FROM {_RUNS})
SELECT run_id, stated, coalesce(c.n, 0) AS there FROM r LEFT JOIN c USING (run_id) WHERE coalesce(stated, 0) <> coalesce(c.n, 0)""")
def call_count_mismatch(spark, d):
    c = dedup.latest(table(spark, d, "model_calls"), "call_id", "loaded_at", "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    r = dedup.newest(table(spark, d, "run_records"), "run_id", "loaded_at", "calls").select("run_id", (F.col("calls")["total"] + F.when(F.col("run_id") % 6 == 0, 1).otherwise(0)).alias("stated")).join(c, "run_id", "left")
    return r.where("coalesce(stated, 0) <> coalesce(n, 0)").select("run_id", "stated", F.coalesce("n", F.lit(0)).alias("there"))


# labels of defects --------------------------------------------------------------------------------------------------

# Every third name becomes the notice's, a ninth of the notices a place for text: a stated change, so that more labels occur.
_JUDGED = f"""(SELECT id, code, params, coalesce(returns, []) AS returns, CASE WHEN h % 3 = 0 THEN regexp_replace(coalesce(notice, ''), '\\W+', '_', 'g') ELSE name END AS name, CASE WHEN h % 9 = 0 THEN 'TODO' WHEN h % 9 = 1 THEN '' WHEN h % 9 = 2 THEN 'Moves it' ELSE notice END AS notice,
 CASE WHEN h % 9 < 3 THEN NULL ELSE dev END AS dev FROM (SELECT *, CAST('0x' || substr(sha1(id), 1, 4) AS INT) AS h FROM {_PAIRS}))"""


@query(f"""WITH p AS (SELECT *, trim(concat_ws(' ', nullif(coalesce(notice, ''), ''), nullif(coalesce(dev, ''), ''))) AS prose,
 list_filter(list_transform(regexp_split_to_array(regexp_extract(code, '^[^(]*\\(([^()]*)\\)', 1), ','), lambda x: regexp_extract(trim(x), '\\s([A-Za-z_$][\\w$]*)$', 1)), lambda x: x NOT IN ('', 'memory', 'calldata', 'storage', 'payable')) AS actual,
 trim(regexp_extract(code, '^[^{{;]*?\\breturns\\s*\\(([^()]*)\\)', 1)) AS rets FROM {_JUDGED}),
w AS (SELECT *, regexp_extract_all(prose, '[A-Za-z][A-Za-z0-9_]*') AS words, list_transform(regexp_extract_all(replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[A-Za-z][A-Za-z0-9_]*'), lambda x: lower(x)) AS ident, CASE WHEN rets = '' THEN 0 ELSE len(regexp_split_to_array(rets, ',')) END AS nr FROM p),
l AS (SELECT CASE WHEN prose = '' THEN 'no_text' END AS d FROM w UNION ALL SELECT 'placeholder' FROM w WHERE prose <> '' AND regexp_matches(prose, '(?i)\\b(TODO|TBD|FIXME|XXX|WIP)\\b|\\?\\?\\?')
 UNION ALL SELECT 'text_short' FROM w WHERE prose <> '' AND len(words) < 3 UNION ALL SELECT 'name_echo' FROM w WHERE prose <> '' AND len(words) >= 3 AND len(ident) > 0 AND len(list_filter(words, lambda x: NOT list_contains(ident, lower(x)))) = 0
 UNION ALL SELECT CASE WHEN NOT list_contains(coalesce(map_keys(params), []), a) THEN 'param_missing' WHEN trim(coalesce(params[a], '')) = '' THEN 'param_empty' END FROM (SELECT params, unnest(actual) AS a FROM w)
 UNION ALL SELECT 'param_unknown' FROM (SELECT actual, unnest(map_keys(params)) AS k FROM w) WHERE NOT list_contains(actual, k)
 UNION ALL SELECT 'return_missing' FROM w WHERE nr > 0 AND len(returns) < nr UNION ALL SELECT 'return_extra' FROM w WHERE len(returns) > nr
 UNION ALL SELECT 'return_empty' FROM w WHERE nr > 0 AND len(list_filter(returns, lambda r: trim(concat_ws(' ', r.name, r.text)) = '')) > 0)
SELECT d AS defect, count(*) AS n FROM l WHERE d IS NOT NULL GROUP BY d""")
def judge_defects(spark, d):
    h = F.conv(F.substring(F.sha1("id"), 1, 4), 16, 10).cast("int")
    p = pairs_with_maps(spark, d, "notice", "dev", "name", "code", "returns", "params")
    p = p.withColumns({
        "name": F.when(h % 3 == 0, F.regexp_replace(F.coalesce("notice", F.lit("")), r"\W+", "_")).otherwise(F.col("name")),
        "notice": F.when(h % 9 == 0, "TODO").when(h % 9 == 1, "").when(h % 9 == 2, "Moves it").otherwise(F.col("notice")), "dev": F.when(h % 9 >= 3, F.col("dev")),
    })
    j = classify.judge(p).select(F.explode("defects").alias("x"))
    return j.groupBy(F.substring_index("x", ":", 1).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


# fields ------------------------------------------------------------------------------------------------------------

_GOLD = f"""p AS (SELECT id, notice, dev, params, returns FROM {_PAIRS}),
gold AS (SELECT id, 'notice' AS key, notice AS want FROM p UNION ALL SELECT id, 'dev', dev FROM p UNION ALL SELECT id, 'param:' || u.k, params[u.k] FROM p, unnest(map_keys(params)) AS u(k)
 UNION ALL SELECT id, 'return:' || (i - 1), trim(concat_ws(' ', returns[i].name, returns[i].text)) FROM (SELECT id, returns, unnest(range(1, len(returns) + 1)) AS i FROM p))"""


def _fields(spark, d):
    """A row per run and field of its reference: (``run_id``, ``config``, ``has_sigma``, ``kind``, ``cand``, ``want``); a field the comment lacks is empty."""
    p = pairs_with_maps(spark, d, "notice", "dev", "params", "returns").select(F.col("id").alias("pair_id"), corpus.reference_fields().alias("gold"))
    r = runs_(spark, d, "config", "pair_id", "error", "final", "has_sigma").where(~runs.failed()).where("final is not null").join(p, "pair_id").withColumn("got", comments.fields(F.col("final")))
    x = r.select("run_id", "config", "has_sigma", "got", F.explode("gold").alias("key", "want"))
    return x.select("run_id", "config", "has_sigma", F.substring_index("key", ":", 1).alias("kind"), F.coalesce(F.try_element_at("got", F.col("key")), F.lit("")).alias("cand"), "want")


def _macro(x, **metrics_):
    """Means over records of each record's means by kind; ``n`` counts the fields."""
    per = x.groupBy("config", "run_id", "kind").agg(F.count(F.lit(1)).alias("k"), *(F.avg(m).alias(c) for c, m in metrics_.items()))
    return per.groupBy("config", "kind").agg(F.sum("k").alias("n"), *(r6(F.avg(c), c) for c in metrics_))


@query(f"""WITH {FIELDS_SQL}, {_GOLD}, j AS (SELECT c.run_id, c.config, split_part(g.key, ':', 1) AS kind, coalesce(f.body, '') AS cand, g.want FROM c JOIN gold g ON g.id = c.pair_id LEFT JOIN fields f ON f.run_id = c.run_id AND f.key = g.key WHERE trim(coalesce(g.want, '')) <> ''),
t AS (SELECT *, {_TOKENS.format(x='cand')} AS c, {_TOKENS.format(x='want')} AS r FROM j), m AS (SELECT config, run_id, kind, count(*) AS k, avg({sentence_bleu_sql('c', 'r')}) AS bleu, avg(CAST(c = r AS INT)) AS exact, avg(CAST(trim(cand) <> '' AS INT)) AS coverage FROM t GROUP BY ALL)
SELECT config, kind, CAST(sum(k) AS BIGINT) AS n, round(avg(bleu), 6) AS bleu, round(avg(exact), 6) AS exact, round(avg(coverage), 6) AS coverage FROM m GROUP BY ALL""")
def field_means(spark, d):
    c, w = F.col("cand"), F.col("want")
    return _macro(_fields(spark, d), bleu=metrics.sentence_bleu(c, w), exact=text.same_tokens(c, w).cast("int"), coverage=(F.trim("cand") != "").cast("int"))


@query()
def field_rouge(spark, d):
    c, w = F.col("cand"), F.col("want")
    return _macro(_fields(spark, d), rouge_l=metrics.rouge_l(c, w), meteor=metrics.meteor(c, w))


# matching -----------------------------------------------------------------------------------------------------------

# Half of the units are changed by a hash of their id before they are looked up: one statement more, three more, or the
# body of another name; so exact, near and no matches occur.
_EDITS = ["", " a = b; }", " a = b; c = d(e); return f; }", " a[0] = b; c.d(e, f, g); h += i * j; if (k) { delete l; } emit M(n, o); p -= q; r = s; t = u; v = w; x.y(z); aa = bb; cc = dd; ee = ff; gg(hh); }"]


def _edit_sql() -> str:
    return "CASE h % 4 " + " ".join(f"WHEN {i} THEN regexp_replace(code, '\\}}\\s*$', '{v}')" for i, v in enumerate(_EDITS) if v) + " ELSE code END"


_CODE_TOKEN = text.CODE_TOKEN.replace("'", "''")
_HEAD = r"^\s*function\s+([A-Za-z_$][\w$]*)\s*\(((?:[^()]|\([^()]*\))*)\)"
_KEYS = f"""sha1(regexp_replace(code, '\\s+', '', 'g')) AS e, CASE WHEN regexp_extract(code, '{_HEAD}', 1) <> '' THEN regexp_extract(code, '{_HEAD}', 1) || '/' || CASE WHEN trim(regexp_extract(code, '{_HEAD}', 2)) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(regexp_extract(code, '{_HEAD}', 2), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), ',')) END END AS b, regexp_extract_all(code, '{_CODE_TOKEN}', 1) AS t"""
_GRAMS3 = "CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END"


@query(f"""WITH u AS (SELECT pair_id, {_edit_sql()} AS code FROM (SELECT pair_id, code, CAST('0x' || substr(sha1(pair_id), 1, 2) AS INT) AS h FROM {_UNITS})),
q AS (SELECT *, {_GRAMS3} AS g FROM (SELECT pair_id, {_KEYS} FROM u)), x AS (SELECT *, {_GRAMS3} AS g FROM (SELECT id, {_KEYS} FROM {_PAIRS} WHERE code IS NOT NULL)),
f AS (SELECT e, min(id) AS target_id, count(*) AS n FROM x GROUP BY e),
c AS (SELECT q.pair_id, x.id, CASE WHEN len(list_distinct(list_concat(q.g, x.g))) = 0 THEN 1.0 ELSE len(list_intersect(q.g, x.g)) / len(list_distinct(list_concat(q.g, x.g))) END AS s FROM q JOIN x ON q.b = x.b AND len(x.t) BETWEEN 0.6 * len(q.t) AND 1.6 * len(q.t) WHERE q.e NOT IN (SELECT e FROM f)),
k AS (SELECT pair_id, count(*) AS n FROM c GROUP BY pair_id), m AS (SELECT *, lead(s, 1, 0) OVER (PARTITION BY pair_id ORDER BY s DESC, id DESC) AS second, row_number() OVER (PARTITION BY pair_id ORDER BY s DESC, id DESC) AS rn FROM c),
w AS (SELECT pair_id, id, s FROM m WHERE rn = 1 AND s >= 0.85 AND s - second >= 0.05)
SELECT q.pair_id AS query_id, CASE WHEN f.e IS NOT NULL THEN 'exact' WHEN w.id IS NOT NULL THEN 'fuzzy' WHEN coalesce(k.n, 0) > 400 THEN 'crowded' ELSE 'none' END AS how, coalesce(f.target_id, w.id) AS target_id,
 round(CASE WHEN f.e IS NOT NULL THEN 1.0 ELSE w.s END, 6) AS score, coalesce(f.n, k.n, 0) AS candidates FROM q LEFT JOIN f ON f.e = q.e LEFT JOIN w USING (pair_id) LEFT JOIN k USING (pair_id)""")
def match_units(spark, d):
    h = F.conv(F.substring(F.sha1("pair_id"), 1, 2), 16, 10).cast("int") % 4
    code = F.col("code")
    for i, more in enumerate(_EDITS):
        code = F.when(h == i, F.regexp_replace("code", r"\}\s*$", more)).otherwise(code) if more else code
    q = units_(spark, d, "code").select(F.col("pair_id").alias("id"), code.alias("code"))
    m = matching.match(q, pairs_(spark, d, "code").where("code is not null").select("id", "code"))
    return m.select("query_id", "how", "target_id", r6(F.col("score"), "score"), "candidates")


# baselines ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT p.id, CASE WHEN trim(w) = '' THEN '' ELSE '/// @notice ' || upper(left(w, 1)) || substr(w, 2) || '.' END AS comment FROM (SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(replace(regexp_replace(name, '^_+', ''), '_', ' '), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda x: lower(x)), ' ') AS w FROM {_PAIRS}) p""")
def name_baseline(spark, d):
    return pairs_(spark, d, "name").select("id", tables.name_comment(F.col("name")).alias("comment"))


@query()
def split_effect_bleu(spark, d):
    """Corpus BLEU of the nearest training unit's notice under random splits of fixed sizes, and its spread over the seeds.

    The units are embedded, those of the evaluation part look for the nearest of the training part, and one
    without a hit counts as empty. The parts are the first of the units in the order of a hash of id and seed.
    """
    u = pairs_(spark, d, "notice", "code").where("trim(notice) <> '' and code is not null")
    n = u.count()
    v = u.select("id", "notice", metrics.hashing_encoder(F.col("code")).alias("embedding"), F.monotonically_increasing_id().alias("vec_id"))
    from ..session import cut

    v, scores = cut(v), None
    for seed in (1, 2, 3):
        placed = v.withColumn("place", F.sha1(F.concat_ws(":", "id", F.lit(seed))))
        bound = placed.orderBy("place").offset(n // 10).limit(1).select("place").first()
        ev, train = (placed.where(F.col("place") < bound[0]), placed.where(F.col("place") >= bound[0])) if bound else (placed.limit(0), placed)
        hit = retrieval.top_k(train, ev, 1, exclude_self=False).select(F.col("query_id").alias("vec_id"), F.col("unit_id"))
        got = ev.select("vec_id", "notice").join(hit, "vec_id", "left").join(train.select(F.col("vec_id").alias("unit_id"), F.col("notice").alias("said")), "unit_id", "left")
        one = tables.bleu_table(got.withColumn("seed", F.lit(seed)), ["seed"], "said", "notice")
        scores = one if scores is None else scores.unionByName(one)
    return scores.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("ba"), 2).alias("mean"), F.round(F.stddev_pop("ba"), 4).alias("sd"), F.min("ba").alias("least"), F.max("ba").alias("most"))
