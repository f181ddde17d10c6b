"""Gates of functions: which modifiers and guards restrict a call, and whether a comment says so. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER_PIECE

# Names of locks, of states, of callers, and of those who may call with the words for them.
REENTRANCY_NAMES = "nonreentrant noreentrancy lock locked nonreentrancy".split()
BARE_CALLERS = "auth authorized authorised requiresauth restricted onlyrole permissioned".split()
STATE_ROOTS = (
    "live active open closed initialized enabled disabled orchestrated paused unpaused started ended expired valid existing ready settled matured enabledroute notpaused".split()
)
PRINCIPALS = {
    "owner": "owner", "admin": "admin", "gov": "governance", "governor": "governance", "governance": "governance", "operator": "operator",
    "controller": "controller", "manager": "manager", "minter": "minter", "burner": "burner", "hub": "hub", "factory": "factory",
    "keeper": "keeper", "guardian": "guardian", "pauser": "pauser", "authority": "authority", "authorized": "authorised caller",
    "authorised": "authorised caller", "holder": "holder", "delegate": "delegate", "creator": "creator", "farmer": "farmer", "bot": "bot",
    "role": "role", "whitelisted": "whitelisted caller", "self": "contract itself", "eoa": "externally owned account",
}
HEADER_WORDS = "external public internal private view pure payable returns override virtual memory calldata storage constant immutable".split()
RESTRICTION = (
    r"(?i)\bonly\b|\brestrict\w*\b|\bpermission\w*\b|\bmust be\b|\bcan(?:not)? be called\b|\bcallable\b|\bcaller\b|\brequires?\b|\bauthori[sz]\w*\b"
    r"|\breverts?\b|\bgated?\b|\ballow\w*\b|\bpermit\w*\b"
)
CLAIM = r"(?i)\bonly\b|\bcan only be called\b|\brestricted to\b"
SENDER = r"\bmsg\.sender\b|\b_msgSender\s*\(\s*\)"
GUARD_WORDS = "msg sender require revert assert _msgSender address bool string".split()


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def pieces(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(IDENTIFIER_PIECE), F.lit(1)), F.lower)


def kind_of(name: Column) -> Column:
    """caller, reentrancy, state or other, from a modifier's name alone; null and empty names are other."""
    low, parts = F.lower(F.coalesce(name, F.lit(""))), pieces(name)
    head, rest = F.try_element_at(parts, F.lit(1)), F.slice(parts, 2, 1 << 20)
    state_word = F.arrays_overlap(rest, _strings(STATE_ROOTS)) & ~F.arrays_overlap(rest, _strings(PRINCIPALS))
    return (
        F.when(low.isin(*REENTRANCY_NAMES), "reentrancy").when(low.isin(*BARE_CALLERS), "caller").when(F.size(parts) == 0, "other")
        .when((head == "when") | (head == "only") & (F.array_join(rest, "").isin(*STATE_ROOTS) | state_word), "state")
        .when(head == "only", "caller").otherwise("other")
    )


def _phrases() -> Column:
    return F.create_map(*(F.lit(x) for kv in PRINCIPALS.items() for x in kv))


def principal_of(name: Column) -> Column:
    """Who may call, in words, by the name: several are alternatives if the name has ``Or``, else one compound; null if none is named."""
    parts = F.array_remove(pieces(name), "only")
    who = F.array_distinct(F.array_compact(F.transform(parts, lambda p: F.try_element_at(_phrases(), p))))
    joined = F.when(F.array_contains(parts, "or"), F.array_join(who, " or ")).otherwise(F.array_join(who, " "))
    return F.when(F.size(who) > 0, joined)


def _gate(name: Column) -> Column:
    return F.struct(name.alias("name"), kind_of(name).alias("kind"), principal_of(name).alias("principal"))


def modifier_gates(names: Column) -> Column:
    """Gates of modifiers listed by name; blank names are none."""
    listed = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(listed, _gate)


def code_gates(code: Column) -> Column:
    """Gates written on a declaration: the names between the parameters and the body, without keywords and arguments. None without a body."""
    head = F.regexp_extract(F.coalesce(code, F.lit("")), r"(?s)^[^)]*\)([^{]*)\{", 1)
    head = F.regexp_replace(F.regexp_replace(head, r"returns\s*\([^)]*\)", " "), r"\([^)]*\)", " ")
    names = F.filter(F.regexp_extract_all(head, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), lambda n: ~F.lower(n).isin(*HEADER_WORDS))
    return F.transform(names, _gate)


def guard_gates(conditions: Column) -> Column:
    """Caller gates of guards that look at who calls; the first principal in the condition, else the words of its first name."""
    some = F.filter(F.coalesce(conditions, F.array().cast("array<string>")), lambda c: c.rlike(SENDER))

    def gate(c):
        names = F.filter(F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), lambda n: ~n.isin(*GUARD_WORDS))
        known = F.array_compact(F.transform(F.flatten(F.transform(names, pieces)), lambda p: F.try_element_at(_phrases(), p)))
        own = F.when(F.size(names) > 0, F.array_join(pieces(F.try_element_at(names, F.lit(1))), " "))
        return F.struct(F.substring(F.trim(c), 1, 60).alias("name"), F.lit("caller").alias("kind"), F.coalesce(F.try_element_at(known, F.lit(1)), own).alias("principal"))

    return F.transform(some, gate)


def gates(code: Column, modifiers: Column | None = None, conditions: Column | None = None) -> Column:
    """All gates of a declaration: modifiers of its fact table, if it has any, else those written on it; then its guards."""
    written = code_gates(code)
    mods = written if modifiers is None else F.when(F.size(modifier_gates(modifiers)) > 0, modifier_gates(modifiers)).otherwise(written)
    return mods if conditions is None else F.concat(mods, guard_gates(conditions))


def caller_gates(all_gates: Column) -> Column:
    return F.filter(all_gates, lambda g: g["kind"] == "caller")


def gate_words(gate: Column) -> Column:
    """Words that name a gate: its name, and those of its principal with more than two letters."""
    who = F.filter(F.split(F.coalesce(gate["principal"], F.lit("")), "[ ,]+"), lambda w: F.length(w) > 2)
    return F.concat(F.array(F.lower(gate["name"])), who)


def sentences(comment: Column) -> Column:
    return F.split(F.coalesce(comment, F.lit("")), "[.;\n]")


def states(comment: Column, gate: Column) -> Column:
    """Whether one sentence both restricts the caller and names the gate; a part of a word counts as naming."""
    return F.exists(sentences(comment), lambda s: s.rlike(RESTRICTION) & F.exists(gate_words(gate), lambda w: F.contains(F.lower(s), w)))


def undeclared(comment: Column, all_gates: Column) -> Column:
    """Names of caller gates that the comment does not state."""
    return F.transform(F.filter(caller_gates(all_gates), lambda g: ~states(comment, g)), lambda g: g["name"])


def invented(comment: Column, all_gates: Column) -> Column:
    """Principals that the comment restricts the call to and no gate shows, each once, as the comment first has them."""
    known = F.flatten(F.transform(all_gates, gate_words))

    def claimed(s):
        words = F.array(*(F.when(F.lower(s).rlike(rf"\b{w}\b") & ~F.array_contains(known, w) & ~F.array_contains(known, p), w) for w, p in PRINCIPALS.items()))
        return F.when(s.rlike(CLAIM), F.array_compact(words)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(sentences(comment), claimed)))


def misplaced(fields: Column, all_gates: Column) -> Column:
    """Keys of the fields, other than notice and dev, that state a caller gate. ``fields`` is a map."""
    other = F.filter(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin("notice", "dev"))
    return F.transform(F.filter(other, lambda e: F.exists(caller_gates(all_gates), lambda g: states(e["value"], g))), lambda e: e["key"])


def rates(df: DataFrame, *by: str, comment: str = "comment", all_gates: str = "gates", fields: str | None = "fields") -> DataFrame:
    """Per group: gated functions and those whose comment states every gate, ungated ones and those with an invented one, and the shares.

    Rows with a null comment do not count; a share without a denominator is null. Stating, inventing and
    misplacing are each judged once per row.
    """
    g, c = F.col(all_gates), F.col(comment)
    gated = F.size(caller_gates(g)) > 0
    row = df.where(c.isNotNull()).select(
        *by, gated.alias("gated"), (F.size(undeclared(c, g)) == 0).alias("all_stated"), (F.size(invented(c, g)) > 0).alias("any_invented"),
        (F.size(misplaced(F.col(fields), g)) > 0 if fields else F.lit(False)).alias("any_misplaced"),
    )
    n = row.groupBy(*by).agg(
        F.count_if("gated").alias("gated"), F.count_if(F.expr("gated and all_stated")).alias("stated"), F.count_if(F.expr("gated and any_misplaced")).alias("wrong_tag"),
        F.count_if(F.expr("not gated")).alias("ungated"), F.count_if(F.expr("not gated and any_invented")).alias("invented"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return n.withColumns({"recall": share("stated", "gated"), "wrong_tag_rate": share("wrong_tag", "gated"), "invention_rate": share("invented", "ungated")})
