"""Findings of critics on a comment: what a deterministic and a semantic critic found, merged into one verdict. Built-in expressions only.

A finding is a struct of ``source``, ``text`` (a label, with its subject after a colon), ``severity``,
``why``, ``ids`` of rows of evidence and ``subject``, the tag or parameter it is about.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import gates

FINDING = "struct<source:string,text:string,severity:string,why:string,ids:array<string>,subject:string>"
#: Severities from the gravest, labels whose subject is a tag the comment must have, labels that
#: steer the writing and do not block it, what a citation of evidence looks like.
SEVERITIES = "blocking high medium low".split()
REQUIRING = "param_missing param_empty return_missing return_empty tag_dropped".split()
STEERING = r"^(access_|style_)"
CITATION = r"(\[[FRENPCD]\d+(?:\s*,\s*[FRENPCD]\d+)*\])"


def finding(source: str, text: Column, severity, why: Column | None = None, ids: Column | None = None, subject: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(source).alias("source"), text.alias("text"), severity.alias("severity"), (none if why is None else why).alias("why"),
        F.coalesce(ids if ids is not None else F.array().cast("array<string>"), F.array().cast("array<string>")).alias("ids"), (none if subject is None else subject).alias("subject"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _subject(label: Column) -> Column:
    return F.when(F.contains(label, F.lit(":")), F.nullif(F.regexp_replace(label, "^[^:]*:", ""), F.lit("")))


def explain(label: Column, params: Column, returns: Column) -> Column:
    """What a label asks for, in words; ``params`` are the declared names, ``returns`` how many values there are."""
    kind, subject = F.substring_index(label, ":", 1), F.coalesce(_subject(label), F.lit(""))
    said = {
        "no_text": F.lit("there is neither a notice nor a dev text"), "text_short": F.lit("the text is too short to say anything"), "name_echo": F.lit("the text only repeats the name"),
        "placeholder": F.lit("a place for text was left in the comment"), "param_missing": F.concat(F.lit("parameter "), subject, F.lit(" is declared but not described")),
        "param_empty": F.concat(F.lit("the tag of parameter "), subject, F.lit(" has no text")), "return_empty": F.lit("a return tag has no text"),
        "param_unknown": F.when(F.size(params) == 0, F.concat(F.lit("nothing is passed in, so the tag of "), subject, F.lit(" has to go")))
        .otherwise(F.concat(F.lit("there is no parameter "), subject, F.lit(", only "), F.array_join(params, ", "))),
        "return_extra": F.when(returns == 0, F.lit("nothing is returned, so every return tag has to go")).otherwise(F.concat(returns.cast("string"), F.lit(" values are returned, and there are more return tags"))),
        "return_missing": F.concat(returns.cast("string"), F.lit(" values are returned, and fewer are described")),
    }
    out = label
    for k, v in said.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def of_defects(defects: Column, params: Column | None = None, returns: Column | None = None) -> Column:
    """Findings of the deterministic critic from defect labels; null is none."""
    why = (lambda x: explain(x, params, returns)) if params is not None and returns is not None else (lambda x: None)
    return F.coalesce(F.transform(defects, lambda x: finding("deterministic", x, "blocking", why(x), None, _subject(x))), _none())


def of_access(comment: Column, all_gates: Column, fields: Column) -> Column:
    """Findings on who may call: gates that are not stated, evidence that is cited, restrictions in a tag of something else, and (not blocking) those no gate shows."""
    label = lambda head, x: F.concat(F.lit(head), x)
    open_ = F.transform(gates.undeclared(comment, all_gates), lambda g: finding("deterministic", label("access_undeclared:", g), "blocking", None, None, g))
    cited = F.regexp_extract_all(F.coalesce(comment, F.lit("")), F.lit(CITATION), F.lit(1))
    style = F.when(F.size(cited) > 0, F.array(finding("deterministic", label("style_citation:", F.array_join(F.slice(cited, 1, 3), ",")), "blocking"))).otherwise(_none())
    wrong = F.transform(gates.misplaced(fields, all_gates), lambda k: finding("deterministic", label("access_misplaced:", k), "blocking", None, None, F.substring_index(k, ":", -1)))
    more = F.transform(gates.invented(comment, all_gates), lambda w: finding("deterministic", label("access_invented:", w), "high", None, None, w))
    return F.concat(open_, style, wrong, more)


def of_claims(defects: Column) -> Column:
    """Findings of the semantic critic from its defects (structs of ``verdict``, ``quote``, ``severity``, ``ids``); the subject is the tag that a quote has."""

    def one(x):
        tag = r"@(param|return)\s+(\w+)?"
        subject = F.coalesce(F.nullif(F.regexp_extract(x["quote"], tag, 2), F.lit("")), F.nullif(F.regexp_extract(x["quote"], tag, 1), F.lit("")))
        text = F.concat(F.coalesce(x["verdict"], F.lit("UNSUPPORTED")), F.lit(": "), F.trim(F.coalesce(x["quote"], F.lit(""))))
        return finding("semantic", text, F.coalesce(x["severity"], F.lit("medium")), None, x["ids"], subject)

    return F.coalesce(F.transform(defects, one), _none())


def merge(deterministic: Column, semantic: Column) -> Column:
    """One verdict: ``must_fix``, ``should_fix``, ``suppressed``, ``blocking``, ``total``, ``clean``.

    Deterministic findings must be fixed, but for those that steer the writing, which should be and come
    first. A semantic finding about a tag that the other critic wants is suppressed. The rest follow, those
    that contradict the evidence before the others, by severity, else as they came. Clean is what has
    nothing to fix.
    """
    det, sem = F.coalesce(deterministic, _none()), F.coalesce(semantic, _none())
    needed = F.transform(F.filter(det, lambda f: f["subject"].isNotNull() & F.substring_index(f["text"], ":", 1).isin(*REQUIRING)), lambda f: f["subject"])
    undone = lambda f: f["subject"].isNotNull() & F.array_contains(needed, f["subject"])
    rank = F.array(*map(F.lit, SEVERITIES))

    def keyed(f, i):
        grave = F.array_position(rank, f["severity"])
        return F.struct(F.when(f["text"].startswith("CONTRADICTED"), 0).otherwise(1).alias("a"), F.when(grave > 0, grave).otherwise(9).alias("b"), i.alias("i"), f.alias("f"))

    kept = F.transform(F.array_sort(F.transform(F.filter(sem, lambda f: ~undone(f)), keyed)), lambda k: k["f"])
    must, should = F.filter(det, lambda f: ~f["text"].rlike(STEERING)), F.concat(F.filter(det, lambda f: f["text"].rlike(STEERING)), kept)
    return F.struct(
        must.alias("must_fix"), should.alias("should_fix"), F.filter(sem, undone).alias("suppressed"), F.size(must).alias("blocking"), (F.size(must) + F.size(should)).alias("total"),
        ((F.size(must) + F.size(should)) == 0).alias("clean"),
    )


def critic_ok(ran: Column, findings: Column) -> Column:
    """Whether a critic found nothing; unknown (false) if it did not run."""
    return F.coalesce(ran, F.lit(False)) & (F.coalesce(F.size(findings), F.lit(0)) <= 0)


def feedback(group: Column, omissions: Column | None = None) -> Column:
    """A verdict as numbered text for a writer: what must be fixed, what should be, and what could be added."""

    def numbered(title: str, rows: Column) -> Column:
        lines = F.transform(rows, lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r))
        return F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), lines))

    rows_of = lambda ids: F.when(F.size(ids) > 0, F.concat(F.lit(" (rows: "), F.array_join(ids, ", "), F.lit(")"))).otherwise("")
    must = F.transform(group["must_fix"], lambda f: F.concat(F.lit("["), f["text"], F.lit("] "), F.coalesce(f["why"], F.lit(""))))
    should = F.transform(group["should_fix"], lambda f: F.concat(F.lit("["), f["severity"], F.lit("] "), f["text"], rows_of(f["ids"]), F.when(F.coalesce(f["why"], F.lit("")) != "", F.concat(F.lit(" - "), f["why"])).otherwise("")))
    more = F.coalesce(omissions, F.array().cast("array<string>")) if omissions is not None else F.array().cast("array<string>")
    parts = F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in (numbered("MUST FIX", must), numbered("SHOULD FIX", should), numbered("COULD ADD", more))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("Nothing to fix.")


def best_round(attempts: Column) -> Column:
    """Of attempts (structs with ``blocking``, ``total``, ``round``) the one with fewest blocking findings, then fewest in all, then the latest; null of none."""
    keyed = F.transform(attempts, lambda a: F.struct(a["blocking"].alias("b"), a["total"].alias("t"), (-a["round"]).alias("r"), a.alias("a")))
    return F.array_min(keyed)["a"]


#: Details that stay of a critic that found nothing.
KEPT_DETAILS = "compiles tags_emitted note".split()


def thin(detail: Column, findings: Column) -> Column:
    """A critic's detail (a map), without all but the essential if it found nothing."""
    few = F.map_filter(F.coalesce(detail, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*KEPT_DETAILS))
    return F.when(F.coalesce(F.size(findings), F.lit(0)) > 0, detail).otherwise(few)


def count_calls(calls: Column) -> Column:
    """Calls by prompt from a map of arrays of calls, and their ``total``; a null array is one call."""
    n = F.transform_values(F.coalesce(calls, F.create_map().cast("map<string,array<string>>")), lambda _, v: F.when(v.isNull(), 1).otherwise(F.size(v)))
    return F.map_concat(F.map_filter(n, lambda k, _: k != "total"), F.create_map(F.lit("total"), F.aggregate(F.map_values(n), F.lit(0), lambda a, x: a + x)))
