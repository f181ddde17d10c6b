"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ..session import table
from . import doc_pairs, encode, grouped_split, leakage, lookalike, near_dups, reply_defects, split_overlap


def _of(f, *names):
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


def queries() -> dict:
    return {
        "p1_found": _of(doc_pairs.found, "source_files"),
        "p1_pairs": _of(doc_pairs.pairs_once, "source_files"),
        "p2_found": _of(reply_defects.found, "model_calls", "run_records", "pairs"),
        "p2_counts": _of(reply_defects.counts, "model_calls", "run_records", "pairs"),
        "p3_found": _of(grouped_split.found, "retrieval_units", "pairs"),
        "p3_assign": _of(grouped_split.assign, "retrieval_units"),
        "p3_balance": lambda spark, d: grouped_split.balance(grouped_split.assign(table(spark, d, "retrieval_units"))),
        "p4_found": _of(near_dups.found, "retrieval_units"),
        "p4_groups": _of(near_dups.groups, "retrieval_units"),
        "p5_found": _of(split_overlap.found, "pairs"),
        "p5_report": _of(split_overlap.report, "pairs"),
        "p6_ids": _of(encode.encode, "documents"),
        "p7_found": _of(leakage.found, "documents", "eval_items"),
        "p7_report": _of(leakage.report, "documents", "eval_items"),
        "p8_found": _of(lookalike.found, "documents"),
        "p8_forms": _of(lookalike.forms, "documents"),
    }


_VALID = "(SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY written_at DESC) = 1)"

_TIED = """e AS (SELECT DISTINCT a.project AS s, b.project AS t FROM retrieval_units a JOIN retrieval_units b ON a.group_id = b.group_id),
c(s, t) AS (SELECT DISTINCT project, project FROM retrieval_units UNION SELECT c.s, e.t FROM c JOIN e ON c.t = e.s),
m AS (SELECT s AS project, min(t) AS component FROM c GROUP BY s)"""


def _alike(texts: str) -> str:
    """Common table expressions: ``w`` (each of the distinct ``texts`` of an ``id`` and its words), ``likes`` (ids and likeness of pairs of texts)."""
    return f"""t AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT * FROM ({texts}))),
w AS (SELECT k, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS w FROM t),
n AS (SELECT k, count(*) AS n FROM w GROUP BY k),
b AS (SELECT x.k AS i, y.k AS j, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.k < y.k GROUP BY ALL),
likes AS (SELECT i, j, shared / (p.n + q.n - shared) AS likeness FROM b JOIN n p ON p.k = i JOIN n q ON q.k = j WHERE shared >= 0.75 * (p.n + q.n - shared))"""


_UNIT_TEXTS = "SELECT pair_id AS id, code || ' ' || coalesce(natspec, '') AS text FROM retrieval_units WHERE code IS NOT NULL"
_NOTES = f"""SELECT id, lower(trim(split)) AS split, project, coalesce(notice, '') || ' ' || coalesce(dev, '') AS text FROM {_VALID} WHERE lower(trim(split)) IN ('train', 'val', 'test')"""
_OVERLAPS = f"""{_alike(_NOTES)},
o AS (SELECT a.id AS a_id, a.split AS a_split, a.project AS a_project, b.id AS b_id, b.split AS b_split, b.project AS b_project, likeness FROM likes JOIN t a ON a.k = i JOIN t b ON b.k = j WHERE (a.split = 'train') <> (b.split = 'train'))"""


# The consistent form, written for the characters that the test documents can hold.
_ODD = ("аеорсухіјѕАВЕКМНОРСТХІЈЅοΑΒΕΖΗΙΚΜΝΟΡΤΥΧёЁ" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))).replace("＇", "")
_PLAIN = ("aeopcyxijsABEKMHOPCTXIJSoABEZHIKMNOPTYXëË" + "".join(map(chr, range(0x21, 0x7F)))).replace("'", "")
_UNSEEN = r"[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_FORM = f"""regexp_replace(text, '{_UNSEEN}', '', 'g')"""
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("＇", "''")):
    _FORM = f"replace({_FORM}, '{_a}', '{_b}')"
_FORM = f"nfc_normalize(translate({_FORM}, '{_ODD}', '{_PLAIN}'))"
_FORM = rf"regexp_replace(regexp_replace({_FORM}, '\r\n?|[\x{{0B}}\x{{0C}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[\t \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')"
_FORM = rf"regexp_replace(regexp_replace({_FORM}, ' \n', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_WINDOWS = r"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 12), lambda i: array_to_string(w[i:i + 13], ' '))) AS x FROM (SELECT {key}, regexp_extract_all(lower({form}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 13"
_LEAKS = f"""d AS ({_WINDOWS.format(key="doc_id", form=_FORM, table="documents")}), i AS ({_WINDOWS.format(key="item_id", form=_FORM, table="eval_items")})"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH RECURSIVE {_TIED},
p AS (SELECT id, lower(trim(split)) AS split FROM {_VALID} WHERE lower(trim(split)) IN ('train', 'val', 'test'))
SELECT project FROM m WHERE component IN (SELECT component FROM retrieval_units u JOIN p ON p.id = u.pair_id JOIN m ON m.project = u.project GROUP BY component HAVING count(DISTINCT split) > 1)""",
        "p4_found": f"""WITH {_alike(_UNIT_TEXTS)}
SELECT DISTINCT least(a.id, b.id) AS pair_id_a, greatest(a.id, b.id) AS pair_id_b FROM likes JOIN t a ON a.k = i JOIN t b ON b.k = j WHERE a.id <> b.id""",
        "p4_groups": f"""WITH RECURSIVE {_alike(_UNIT_TEXTS)},
s AS (SELECT k, list_sort(list(w)) AS words FROM w GROUP BY k),
cl AS (SELECT words, min(id) AS class FROM s JOIN t USING (k) GROUP BY words), u AS (SELECT DISTINCT id, class FROM s JOIN t USING (k) JOIN cl USING (words)), kc AS (SELECT k, class FROM s JOIN cl USING (words)),
l AS (SELECT DISTINCT x.class AS p, y.class AS q FROM likes JOIN kc x ON x.k = i JOIN kc y ON y.k = j WHERE x.class <> y.class), ll AS (SELECT p, q FROM l UNION SELECT q, p FROM l), tie AS (SELECT p, q FROM ll UNION SELECT a.class, b.class FROM u a JOIN u b USING (id) WHERE a.class <> b.class),
r(p, q) AS (SELECT class, class FROM cl UNION SELECT r.p, tie.q FROM r JOIN tie ON r.q = tie.p), g AS (SELECT p AS class, min(q) AS "group" FROM r GROUP BY p)
SELECT id AS pair_id, min(u.class) AS class, min("group") AS "group", CAST(sum((SELECT count(*) FROM ll WHERE ll.p = u.class)) AS BIGINT) AS links FROM u JOIN g USING (class) GROUP BY id""",
        "p5_found": f"""WITH {_OVERLAPS} SELECT least(a_id, b_id) AS id_a, greatest(a_id, b_id) AS id_b FROM o""",
        "p5_report": f"""WITH {_OVERLAPS},
v AS (SELECT a_id AS id, a_split AS split, a_project AS project, likeness FROM o WHERE a_split <> 'train' UNION ALL SELECT b_id, b_split, b_project, likeness FROM o WHERE b_split <> 'train')
SELECT split, project, count(*) AS overlaps, count(DISTINCT id) AS records, CAST(count(*) FILTER (likeness = 1) AS BIGINT) AS same_words FROM v GROUP BY ALL""",
        "p7_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (x)",
        "p8_forms": f"SELECT doc_id, {_FORM} AS form FROM documents",
        "p8_found": f"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.form <> ''""",
    }
