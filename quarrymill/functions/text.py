"""Column functions on text: tokens, keys, shingles. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the lexical atoms of Solidity, longest first.
CODE_TOKEN = (
    r"""((?:unicode|hex)?"(?:\\.|[^"\\])*"|(?:unicode|hex)?'(?:\\.|[^'\\])*'|0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d+)?|[A-Za-z_$][A-Za-z0-9_$]*"""
    r"""|>>>=|<<=|>>=|\*\*=|\|\||&&|==|!=|<=|>=|<<|>>|\+\+|--|\+=|-=|\*=|/=|%=|\|=|&=|\^=|=>|[{}()\[\].,;:?~!+\-*/%<>=&|^])"""
)
#: Fixed value: the pieces of an identifier.
IDENTIFIER_PIECE = r"([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z]+|[0-9]+)"
#: Fixed value: punctuation that the prose tokenizer separates.
PROSE_PUNCTUATION = r"""([`.,;:!?()\[\]{}"']|--+)"""

#: Suffixes the stemmer strips, tried in this order.
SUFFIXES = "ization iveness fulness ousness ation ments ingly edly ment ness ions ing ies ed es ly s".split()


def visible(c: Column) -> Column:
    """Whether a text has anything but blanks, of whatever kind; null has nothing."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def norm_prose(c: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_TOKEN), F.lit(1))


def nl_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, PROSE_PUNCTUATION, " $1 "), r"\s+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def exact_key(c: Column) -> Column:
    return F.sha1(squeeze(c))


def split_identifier(c: Column) -> Column:
    """The words of a name in camel or snake case, in lower case: ``mintFixedTenor`` gives mint, fixed, tenor. A name without pieces is one word."""
    got = F.regexp_extract_all(c, F.lit(IDENTIFIER_PIECE), F.lit(1))
    return F.transform(F.when(F.size(got) > 0, got).otherwise(F.array(c)), F.lower)


def normalize(c: Column, mode: str = "paper") -> Column:
    """``none``: outer blanks only; ``paper``: lower-case words; ``identifiers``: words split into their pieces, too."""
    if mode == "none":
        return F.trim(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    if mode == "paper":
        return F.array_join(F.transform(words, F.lower), " ")
    if mode == "identifiers":
        return F.array_join(F.flatten(F.transform(words, split_identifier)), " ")
    raise ValueError(f"mode must be none, paper or identifiers, not {mode!r}")


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of n tokens; none if there are fewer."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), sep))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; a shorter text is one shingle, an empty one none."""
    short = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tokens) < n, short).otherwise(F.array_distinct(ngrams(tokens, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike, an empty and a full one are not."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def stem(c: Column) -> Column:
    """Strips the first fitting suffix that leaves three letters."""
    w = F.lower(c)
    out = None
    for s in SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= 3)
        cut_ = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = F.when(fits, cut_) if out is None else out.when(fits, cut_)
    return out.otherwise(w)


def echo_words(name: Column) -> Column:
    """A name's words as the judge of comments takes them: split before a capital that follows a small letter or digit, and at underscores."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    return F.transform(F.regexp_extract_all(spaced, F.lit("([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), lambda w: F.lower(w))


def same_tokens(a: Column, b: Column) -> Column:
    """Whether two texts have the same words in the same order; null counts as empty."""
    words = lambda c: word_tokens(F.coalesce(c, F.lit("")))
    return words(a) == words(b)


def detokenise(c: Column) -> Column:
    """Code whose tokens stand apart, closed up: no blank before or after what needs none."""
    closed = F.regexp_replace(F.trim(c), r"\s*([.(\[])\s*", "$1")
    closed = F.regexp_replace(closed, r"\s+([)\],;])", "$1")
    return F.regexp_replace(closed, r"\s+", " ")
