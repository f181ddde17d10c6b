"""Queries on tokens, names, joined texts, roles, audits and flat rows. Beside each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import checks, classify, corpus, dedup, runs, tables
from ..session import table
from .catalogue import _OK, _PAIRS, _RUNS, _UNITS, pairs_, query, r6, runs_, units_
from .evaluation import _SCORED, _said, sentence_bleu_sql
from .wording import _pieces_sql

_CODE_TOKEN = text.CODE_TOKEN.replace("'", "''")
_PUNCT = text.PROSE_PUNCTUATION.replace("'", "''")


@query(f"""SELECT id, len(regexp_extract_all(code, '{_CODE_TOKEN}', 1)) AS code_tokens, coalesce(array_to_string(list_filter(regexp_split_to_array(regexp_replace(notice, '{_PUNCT}', ' \\1 ', 'g'), '\\s+'), lambda x: x <> ''), ' '), '') AS prose,
 array_to_string(list_transform(regexp_extract_all(coalesce(notice, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)), ' ') AS paper,
 array_to_string(flatten(list_transform(regexp_extract_all(coalesce(notice, ''), '[A-Za-z0-9_]+'), lambda w: CASE WHEN len({_pieces_sql('w')}) > 0 THEN {_pieces_sql('w')} ELSE [lower(w)] END)), ' ') AS identifiers, len(regexp_extract_all(lower(coalesce(notice, '')), '[a-z0-9_]+')) AS words FROM {_PAIRS}""")
def token_profiles(spark, d):
    p = pairs_(spark, d, "code", "notice")
    return p.select(
        "id", F.size(text.code_tokens(F.col("code"))).alias("code_tokens"), F.coalesce(F.array_join(text.nl_tokens(F.col("notice")), " "), F.lit("")).alias("prose"), text.normalize(F.col("notice"), "paper").alias("paper"),
        text.normalize(F.col("notice"), "identifiers").alias("identifiers"), F.size(text.word_tokens(F.coalesce("notice", F.lit("")))).alias("words"),
    )


@query(f"""SELECT name, {_pieces_sql('name')} AS pieces, list_transform(regexp_extract_all(replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[A-Za-z][A-Za-z0-9_]*'), lambda x: lower(x)) AS echo,
 array_to_string(list_transform(regexp_extract_all(regexp_replace(replace(regexp_replace(name, '^_+', ''), '_', ' '), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda x: lower(x)), ' ') AS words FROM (SELECT DISTINCT name FROM {_PAIRS} WHERE regexp_matches(name, '[A-Za-z]'))""")
def identifier_splits(spark, d):
    n = pairs_(spark, d, "name").where("name rlike '[A-Za-z]'").select("name").distinct()
    return n.select("name", text.split_identifier(F.col("name")).alias("pieces"), text.echo_words(F.col("name")).alias("echo"), tables.name_words(F.col("name")).alias("words"))


@query(f"""SELECT id, trim(regexp_replace(concat_ws(' ', nullif(trim(coalesce(notice, '')), ''), nullif(trim(coalesce(dev, '')), ''), array_to_string(list_filter(list_transform(list_sort(coalesce(map_keys(params), [])), lambda k: trim(coalesce(params[k], ''))), lambda x: x <> ''), ' '),
 array_to_string(list_filter(list_transform(coalesce(returns, []), lambda r: trim(concat_ws(' ', r.name, r.text))), lambda x: x <> ''), ' ')), ' +', ' ', 'g')) AS whole FROM {_PAIRS}""")
def canonical_texts(spark, d):
    p = dedup.newest(table(spark, d, "pairs"), "id", "written_at", "notice", "dev", "params", "returns")
    return p.select("id", F.trim(F.regexp_replace(corpus.canonical_text(corpus.reference_fields()), " +", " ")).alias("whole"))


@query("""WITH r AS (SELECT file, min(role) AS role FROM file_manifest GROUP BY file), k AS (SELECT project, CAST('0x' || substr(sha1(project), 1, 2) AS INT) % 10 AS h FROM (SELECT DISTINCT project FROM file_manifest))
SELECT m.file, CASE WHEN r.role = 'dependency' THEN 'excluded' WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT file, project FROM file_manifest) m JOIN r USING (file) JOIN k USING (project)""")
def role_split(spark, d):
    """Files by the membership of their project, a table of projects; dependencies are scored in no split."""
    m = table(spark, d, "file_manifest")
    h = F.conv(F.substring(F.sha1("project"), 1, 2), 16, 10).cast("int") % 10
    members = m.select("project").distinct().select("project", F.when(h < 6, "train").when(h < 8, "val").otherwise("test").alias("split"))
    f = m.groupBy("file", "project").agg(F.min("role").alias("role"))
    return corpus.assign_split(f, members).select("file", "split")


@query(f"""WITH l AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS line FROM {_PAIRS}) SELECT line, config, count(*) AS runs, max(final) AS hyp FROM {_RUNS} r JOIN l ON l.id = r.pair_id WHERE {_OK} AND coalesce(gate_verdict, '') <> 'FAIL' GROUP BY line, config""")
def runs_by_line(spark, d):
    lines = pairs_(spark, d, "kind").select(F.col("id").alias("pair_id"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("line"))  # the line map of a corpus file
    r = runs_(spark, d, "config", "pair_id", "error", "gate_verdict", "final").where(~runs.failed()).where("coalesce(gate_verdict, '') <> 'FAIL'")
    return r.join(lines, "pair_id").groupBy("line", "config").agg(F.count(F.lit(1)).alias("runs"), F.max("final").alias("hyp"))


@query(f"""WITH s AS (SELECT config, run_id, support_rate, has_sigma, trim(coalesce(said, '')) <> '' AS present, {sentence_bleu_sql('c', 'r')} AS bleu FROM {_SCORED} WHERE trim(notice) <> '')
SELECT config, condition, count(*) AS n, round(avg(support_rate), 6) AS claim_support, round(avg(bleu), 6) AS notice_bleu, round(avg(CAST(present AS INT)), 6) AS notice_coverage FROM (SELECT *, 'all' AS condition FROM s UNION ALL SELECT *, CASE WHEN coalesce(has_sigma, false) THEN 'with facts' ELSE 'without facts' END FROM s) GROUP BY ALL""")
def flat_metrics(spark, d):
    x = _said(spark, d).where("trim(notice) <> ''").withColumn("bleu", metrics.sentence_bleu(F.col("said"), F.col("notice")))
    x = x.withColumn("condition", F.explode(F.array(F.lit("all"), F.when(F.coalesce("has_sigma", F.lit(False)), "with facts").otherwise("without facts"))))
    present = (F.trim(F.coalesce("said", F.lit(""))) != "").cast("int")
    return x.groupBy("config", "condition").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("support_rate"), "claim_support"), r6(F.avg("bleu"), "notice_bleu"), r6(F.avg(present), "notice_coverage"))


@query(f"""WITH p AS (SELECT id, project, lower(trim(split)) AS split, trim(regexp_replace(lower(notice), '\\s+', ' ', 'g')) AS n, trim(regexp_replace(lower(dev), '\\s+', ' ', 'g')) AS v, len(coalesce(returns, [])) AS rets,
 CASE WHEN trim(regexp_extract(code, '^[^{{;]*?\\breturns\\s*\\(([^()]*)\\)', 1)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(regexp_extract(code, '^[^{{;]*?\\breturns\\s*\\(([^()]*)\\)', 1)), ',')) END AS declared, kind FROM {_PAIRS}),
t AS (SELECT n AS k FROM p WHERE split = 'train' UNION SELECT v FROM p WHERE split = 'train'), u AS (SELECT DISTINCT pair_id FROM {_UNITS})
SELECT 'splits_disjoint' AS item, count(*) AS found, count(*) = 0 AS ok FROM (SELECT project FROM p WHERE split IN ('train', 'val', 'test') GROUP BY project HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'no_leakage', count(*), count(*) = 0 FROM p WHERE split IN ('val', 'test') AND n <> '' AND n IN (SELECT k FROM t WHERE k <> '')
UNION ALL SELECT 'returns_complete', count(*), count(*) = 0 FROM p WHERE kind IN ('function', 'receive', 'fallback') AND declared <> rets
UNION ALL SELECT 'coverage', count(u.pair_id), count(u.pair_id) = count(*) FROM p LEFT JOIN u ON u.pair_id = p.id""")
def audit(spark, d):
    return checks.audit(dedup.newest(table(spark, d, "pairs"), "id", "written_at", "project", "split", "notice", "dev", "code", "kind", "returns"), units_(spark, d, "project").select("pair_id"))


@query(f"""SELECT run_id, regexp_extract_all(lower(final), '[a-z0-9_]+') = regexp_extract_all(lower(draft), '[a-z0-9_]+') AS same, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(final, '@(param|return|dev|notice)\\b'), lambda t: t)), lambda t: NOT contains(draft, t))), ' ') AS added FROM {_RUNS} WHERE {_OK} AND final IS NOT NULL AND draft IS NOT NULL""")
def revised_tags(spark, d):
    r = runs_(spark, d, "error", "final", "draft").where(~runs.failed()).where("final is not null and draft is not null")
    tags = F.array_distinct(F.regexp_extract_all("final", F.lit(r"(@(?:param|return|dev|notice)\b)"), F.lit(1)))
    return r.select("run_id", text.same_tokens(F.col("final"), F.col("draft")).alias("same"), F.array_join(F.array_sort(F.filter(tags, lambda t: ~F.contains(F.col("draft"), t))), " ").alias("added"))
