"""Whether a comment names what its function's name says, or the opposite. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_identifier

# Verbs that are each other's opposite, other words for a verb, words too general to prove the
# opposite, and openings of a name that carry no intent.
OPPOSITES = {
    "enable": "disable", "add": "remove", "mint": "burn", "set": "get", "deposit": "withdraw", "lock": "unlock", "freeze": "unfreeze", "pause": "unpause",
    "approve": "revoke", "grant": "revoke", "open": "close", "start": "stop", "increase": "decrease", "increment": "decrement", "buy": "sell",
    "create": "destroy", "register": "deregister", "whitelist": "blacklist", "allow": "deny", "activate": "deactivate", "attach": "detach",
    "stake": "unstake", "wrap": "unwrap", "fund": "defund", "credit": "debit",
}
SYNONYMS = {
    "get": ["return", "retrieve", "read", "query", "fetch", "give"], "set": ["update", "assign", "change", "store", "write", "modify"],
    "add": ["insert", "append", "push", "register"], "remove": ["delete", "erase", "drop", "clear"], "mint": ["issue", "create"], "burn": ["destroy"],
    "transfer": ["send", "move"], "withdraw": ["claim", "redeem"], "deposit": ["fund"], "check": ["verify", "validate", "ensure", "test"],
    "is": ["return", "whether", "check"], "calculate": ["compute", "determine"], "approve": ["allow", "permit", "authorise", "authorize"],
    "disable": ["turn off", "switch off"], "enable": ["turn on", "switch on", "allow"], "init": ["initialise", "initialize", "construct"],
    "execute": ["run", "perform", "carry out", "call"],
}
GENERAL = "change modify store write allow permit create run call perform give test".split()
EMPTY_OPENINGS = "_ do safe try internal external public".split()


def _antonyms() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in OPPOSITES.items():
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return {k: sorted(set(v)) for k, v in out.items()}


def _map(words: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def _of(words: dict[str, list[str]], key: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(words), key), F.array().cast("array<string>"))


def function_name(code: Column) -> Column:
    """The name after ``function``; null if there is none."""
    got = F.regexp_extract(code, r"\bfunction\s+([A-Za-z_$][\w$]*)", 1)
    return F.when(got != "", got)


def intent(name: Column) -> Column:
    """The first word of a name that carries its intent, null if there is none: a known verb, or letters only and more than two."""
    # what remains from the first piece that is no empty opening on
    rest = F.aggregate(split_identifier(name), F.lit(None).cast("string"), lambda acc, p: F.when(acc.isNull() & (p != "") & ~p.isin(*EMPTY_OPENINGS), p).otherwise(acc))
    known = sorted({*SYNONYMS, *_antonyms(), *(x for v in SYNONYMS.values() for x in v)})
    return F.when(rest.isin(*known) | rest.rlike(r"^\p{L}{3,}$"), rest)


def _forms(word: Column) -> Column:
    """A word as it may stand in a text: with the endings of a third person, a past and a present participle; several words only as they are."""
    short = F.when((F.length(word) > 3) & word.endswith("e"), F.regexp_replace(word, "e+$", "")).otherwise(word)
    ends = F.array(word, *(F.concat(word, F.lit(x)) for x in ("s", "es", "d", "ed")), *(F.concat(short, F.lit(x)) for x in ("ing", "ed", "es")))
    return F.when(F.contains(word, F.lit(" ")), F.array(word)).otherwise(ends)


def _any(words: Column, padded: Column) -> Column:
    return F.exists(F.flatten(F.transform(words, _forms)), lambda f: F.contains(padded, F.concat(F.lit(" "), f, F.lit(" "))))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]+", " "), F.lit(" "))


def says(text: Column, verb: Column) -> Column:
    """Whether the text uses the verb or another word for it."""
    return _any(F.concat(F.array(verb), _of(SYNONYMS, verb)), _padded(text))


def inverts(text: Column, verb: Column) -> Column:
    """Whether the text does not use the verb but its opposite, or a word for that which is not too general."""
    strict = {k: [x for x in v if x not in GENERAL] for k, v in SYNONYMS.items()}
    opposite = {k: sorted({*v, *(x for a in v for x in strict.get(a, []))}) for k, v in _antonyms().items()}
    return ~says(text, verb) & _any(_of(opposite, verb), _padded(text))


def agreement(df: DataFrame, *by: str, verb: str = "verb", comment: str = "comment") -> DataFrame:
    """Per group: texts scored, those that name the verb, those that invert it, and the shares. Null verbs and texts do not count."""
    row = df.where(F.col(verb).isNotNull() & F.col(comment).isNotNull()).select(*by, says(F.col(comment), F.col(verb)).alias("named"), inverts(F.col(comment), F.col(verb)).alias("inverted"))
    n = row.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("named"), F.count_if("inverted").alias("inverted"))
    share = lambda a: F.round(F.try_divide(F.col(a), F.col("n")), 6)
    return n.withColumns({"agreement": share("named"), "inversion_rate": share("inverted")})
