"""Rule-based labels: defects of documentation, gates, opening verbs, house style. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_identifier

# What a word is, and how a place for text to be written shows.
_WORD = "([A-Za-z][A-Za-z0-9_]*)"
_PLACEHOLDER = r"(?i)\b(TODO|TBD|FIXME|XXX|WIP)\b|\?\?\?"


def prose() -> Column:
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return F.trim(F.concat_ws(" ", part("notice"), part("dev")))


def header_params(code: Column) -> Column:
    """Names of the parameters in a header: the last word of each."""
    inner = F.regexp_extract(code, r"(?s)^[^(]*\(([^()]*)\)", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")
    last = F.transform(parts, lambda p: F.regexp_extract(p, r"\s([A-Za-z_$][\w$]*)$", 1))
    return F.filter(last, lambda p: (p != "") & ~p.isin("memory", "calldata", "storage", "payable"))


def header_returns(code: Column) -> Column:
    """How many values a header returns."""
    inner = F.trim(F.regexp_extract(code, r"(?s)^[^{;]*?\breturns\s*\(([^()]*)\)", 1))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))


def judge(pairs: DataFrame) -> DataFrame:
    """``id`` and ``defects``, in a fixed order: text, parameters, returns."""
    p = pairs.withColumns({"prose_": prose(), "actual_": header_params(F.col("code")), "n_ret_": header_returns(F.col("code"))})
    words = F.regexp_extract_all("prose_", F.lit(_WORD), F.lit(1))
    ident = F.flatten(F.transform(F.regexp_extract_all(F.regexp_replace(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "_", " "), F.lit(_WORD), F.lit(1)), lambda w: F.array(F.lower(w))))
    echo = (F.size(ident) > 0) & (F.size(F.array_except(F.transform(words, F.lower), ident)) == 0)
    text = F.when(F.col("prose_") == "", F.array(F.lit("no_text"))).otherwise(
        F.array_compact(F.array(F.when(F.col("prose_").rlike(_PLACEHOLDER), "placeholder"), F.when(F.size(words) < 3, "text_short").when(echo, "name_echo")))
    )
    params = F.coalesce(F.col("params"), F.create_map().cast("map<string,string>"))
    known = F.map_keys(params)
    missing = F.transform("actual_", lambda n: F.when(~F.array_contains(known, n), F.concat(F.lit("param_missing:"), n)).when(F.trim(F.coalesce(F.element_at(params, n), F.lit(""))) == "", F.concat(F.lit("param_empty:"), n)))
    extra = F.transform(F.array_sort(F.array_except(known, "actual_")), lambda n: F.concat(F.lit("param_unknown:"), n))
    n = F.coalesce(F.size("returns"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    blank = F.exists("returns", lambda r: F.trim(F.concat_ws(" ", r["name"], r["text"])) == "")
    rets = F.when(F.col("n_ret_") > 0, F.array_compact(F.array(F.when(n < F.col("n_ret_"), "return_missing").when(n > F.col("n_ret_"), "return_extra"), F.when(F.coalesce(blank, F.lit(False)), "return_empty")))).otherwise(
        F.array_compact(F.array(F.when(n > 0, "return_extra")))
    )
    return p.select("id", F.concat(text, F.array_compact(missing), extra, rets).alias("defects"))


def leading_verb(text: Column) -> Column:
    """The first word, lower-case, without a third person's ending."""
    w = F.lower(F.regexp_extract(F.trim(text), r"^[^A-Za-z]*([A-Za-z]+)", 1))
    return F.when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.rlike("(ss|sh|ch|x|z)es$"), F.substring(w, F.lit(1), F.length(w) - 2)).when(w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def names_function(text: Column, name: Column) -> Column:
    """Whether the comment opens with the verb its function's name opens with."""
    return leading_verb(text) == F.get(split_identifier(name), 0)


def house_style(df: DataFrame, text: str, by: str) -> DataFrame:
    """Per group of texts that are not blank: how long they are and how they begin, end and mark code, as shares."""
    t = F.trim(text)
    n = F.size(F.split(t, r"\s+"))
    share = lambda c, name: F.avg(c.cast("int")).alias(name)
    sentences = F.size(F.filter(F.split(t, r"[.!?](?=\s|$)"), lambda s: F.trim(s) != ""))
    return df.where(F.col(text).isNotNull() & (t != "")).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), share(t.endswith("."), "stop_rate"), share(t.rlike("^[A-Z]"), "capital_rate"), share(F.contains(t, F.lit("`")), "code_rate"), F.avg(n).alias("mean_words"),
        F.percentile(n, 0.5).alias("median_words"), share(sentences <= 1, "one_sentence"), share(t.rlike("(?i)^the "), "starts_the"), share(t.rlike("(?i)^this (function|method)"), "starts_this"), share(t.rlike(r"^[A-Z][a-z]+s\b"), "third_person"),
    )


def first_words(df: DataFrame, text: str, by: str, n: int = 10) -> DataFrame:
    """Per group the ``n`` first words that occur most (``word``, ``k``, ``place``), ties by the lesser word: a report."""
    w = F.regexp_extract(F.col(text), "([A-Za-z]+)", 1)
    k = df.select(by, w.alias("word")).where("word <> ''").groupBy(by, "word").agg(F.count(F.lit(1)).alias("k"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("k"), "word"))).where(F.col("place") <= n)


def style_rules(shapes: DataFrame, by: str) -> DataFrame:
    """(group, ``rule``): a house style (see ``house_style``) as a sentence per group."""
    pct = lambda c: F.concat(F.format_number(100 * F.col(c), 0), F.lit(" %"))
    rule = F.concat(
        F.lit("about "), F.format_number("median_words", 0), F.lit(" words"), F.when(F.col("one_sentence") > 0.5, F.concat(F.lit(", one sentence ("), pct("one_sentence"), F.lit(")"))).otherwise(""),
        F.when(F.col("third_person") > 0.5, ", opening on a verb in the third person").otherwise(""), F.when(F.col("starts_the") > 0.4, ", opening on The").otherwise(""),
        F.when(F.col("stop_rate") > 0.5, ", with a full stop").otherwise(", without a full stop"), F.when(F.col("code_rate") > 0.25, ", names in backticks").otherwise(", names without backticks"),
    )
    return shapes.select(by, rule.alias("rule"))
