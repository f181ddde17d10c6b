"""Comparison tables: corpus BLEU with any weights over any slices, subsets, baselines, and reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import visible

#: Weights of the orders of BLEU by the names under which they are reported.
WEIGHTS = {
    "ba": (0.25, 0.25, 0.25, 0.25), "b1": (1, 0, 0, 0), "b2": (0, 1, 0, 0), "b3": (0, 0, 1, 0), "b4": (0, 0, 0, 1),
    "bleu_1": (1, 0, 0, 0), "bleu_2": (0.5, 0.5, 0, 0), "bleu_3": (1 / 3, 1 / 3, 1 / 3, 0),
}


def bleu_sums(counts: str = "b", order: int = 4) -> list[Column]:
    """Aggregates of ``metrics.bleu_counts``: ``h1``.. hits, ``t1``.. possible ones, ``cand`` and ``ref`` lengths; they add up over any grouping."""
    at = lambda f, i: F.sum(F.col(f"{counts}.{f}")[i])
    return [*(at("hit", i).alias(f"h{i + 1}") for i in range(order)), *(at("total", i).alias(f"t{i + 1}") for i in range(order)), F.sum(f"{counts}.cand").alias("cand"), F.sum(f"{counts}.ref").alias("ref")]


def weighted_bleu(weights: tuple[float, ...]) -> Column:
    """Corpus BLEU times 100 from ``bleu_sums``, unsmoothed: without a common word, or without a hit of an order that counts, it is 0."""
    used = [(i + 1, w) for i, w in enumerate(weights) if w]
    logs = sum((w * (F.log(F.greatest(f"h{n}", F.lit(1))) - F.log(F.greatest(f"t{n}", F.lit(1)))) for n, w in used), F.lit(0.0))
    none = F.least(F.col("h1"), *(F.col(f"h{n}") for n, _ in used)) == 0 if used else F.lit(True)
    short = F.when(F.col("cand") > F.col("ref"), 1.0).when(F.col("cand") == 0, 0.0).otherwise(F.exp(1 - F.try_divide("ref", "cand")))
    return F.when(F.coalesce(none, F.lit(True)), F.lit(0.0)).otherwise(100 * short * F.exp(logs))


def bleu_table(df: DataFrame, by: list[str], cand: str, ref: str, names: tuple[str, ...] = ("ba",)) -> DataFrame:
    """Per group: ``n``, ``empty`` candidates, which stay and score nothing, and BLEU by the named weights. Rows with a blank reference do not count."""
    some = df.where(visible(F.col(ref))).select(*by, F.coalesce(cand, F.lit("")).alias("c"), F.col(ref).alias("r"))
    g = some.select(*by, "c", metrics.bleu_counts(F.col("c"), F.col("r")).alias("b")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~visible(F.col("c"))).alias("empty"), *bleu_sums())
    return g.select(*by, "n", "empty", *(F.round(weighted_bleu(WEIGHTS[k]), 2).alias(k) for k in names))


def ladder(rows: DataFrame, ref: str, hyp: str, train: DataFrame) -> DataFrame:
    """``rows`` once for every subset they are in (``subset``): all; without those reproduced word for word; without those whose reference is a training text; without either.

    ``train`` has ``text``. Texts are compared without outer blanks.
    """
    known = train.select(F.trim("text").alias("ref_")).where("ref_ is not null").distinct().withColumn("leaked", F.lit(True))
    x = rows.withColumn("ref_", F.trim(ref)).join(known, "ref_", "left").drop("ref_")
    same, leaked = F.trim(ref) == F.trim(hyp), F.coalesce("leaked", F.lit(False))
    names = F.array_compact(F.array(F.lit("all"), F.when(~same, "not reproduced"), F.when(~leaked, "not leaked"), F.when(~same & ~leaked, "neither")))
    return x.withColumn("subset", F.explode(names)).drop("leaked")


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``, that of the column's value in a list; other values come after, null last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("place", F.when(at > 0, at).when(F.col(column).isNotNull(), F.lit(len(order) + 1)).otherwise(F.lit(len(order) + 2)).cast("long"))


def mean_of_groups(df: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """Per group the mean over ``inner`` (folds, seeds) of its means, and how many of them there are."""
    per = df.groupBy(*outer, inner).agg(F.avg(value).alias("m"))
    return per.groupBy(*outer).agg(F.count("m").alias("folds"), F.avg("m").alias("mean"))


def changes(before: DataFrame, after: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Tables side by side: each value as ``<name>_before``, ``<name>_after`` and ``<name>_change``; rows of one side only have nulls."""
    side = lambda d, s: d.select(*by, *(F.col(v).alias(f"{v}_{s}") for v in values))
    both = side(before, "before").join(side(after, "after"), by, "full")
    return both.withColumns({f"{v}_change": F.col(f"{v}_after") - F.col(f"{v}_before") for v in values})


def shape_ratio(generated: DataFrame, gold: DataFrame, by: str, median: str = "median_words") -> DataFrame:
    """Median length of generated texts over that of gold ones, which counts as one word at least."""
    g = gold.select(by, F.col(median).alias("gold"))
    return generated.select(by, F.col(median).alias("run")).join(g, by).withColumn("ratio", F.col("run") / F.greatest("gold", F.lit(1)))


def picked(scores: DataFrame, how: str, n: int, unit: str = "pair_id", score: str = "score") -> DataFrame:
    """``n`` units for a report: best, worst, or spread, every step-th from the best on. ``gap`` takes ``score`` as the distance between systems.

    Ties go to the greater unit. Only the rows that are shown are ranked.
    """
    order = [F.desc(score), F.desc(unit)]
    if how in ("best", "gap"):
        return scores.orderBy(*order).limit(n)
    if how == "worst":
        return scores.orderBy(F.asc(score), F.asc(unit)).limit(n)
    if how != "spread":
        raise ValueError(f"how must be best, worst, gap or spread, not {how!r}")
    step = max(1, scores.count() // max(n, 1))
    upto = scores.orderBy(*order).limit(step * n)
    return upto.withColumn("rn", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("rn") % step == 0).drop("rn")


def gaps(scores: DataFrame, unit: str = "pair_id", score: str = "score") -> DataFrame:
    """Per unit the distance between the best and the worst system, 0 of one system."""
    return scores.groupBy(unit).agg((F.max(score) - F.min(score)).alias(score))


def plain_comment(comment: Column) -> Column:
    """A comment as lines without marks and without empty ones; ``(empty)`` if nothing is left."""
    lines = F.transform(F.split(F.coalesce(comment, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(/\*\*|\*/|///|\*)", "")))
    kept = F.filter(lines, lambda x: ~x.isin("", "/"))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise("(empty)")


def gold_comment() -> Column:
    """A pair's own comment as lines of tags, from ``notice``, ``dev``, ``params`` and ``returns``."""
    tag = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"@{name} "), F.trim(c)))
    ps = F.transform(F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("@param "), e["key"], F.lit(" "), F.coalesce(e["value"], F.lit(""))))
    rs = F.transform(F.coalesce("returns", F.array().cast("array<struct<name:string,text:string>>")), lambda r: F.concat(F.lit("@return "), F.trim(F.concat_ws(" ", r["name"], r["text"]))))
    lines = F.concat(F.array_compact(F.array(tag("notice", F.col("notice")), tag("dev", F.col("dev")))), ps, rs)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(no gold comment)")


# baselines -------------------------------------------------------------------------------------------------------


def name_words(name: Column) -> Column:
    """A name's words in lower case; digits stay with the letters before them, and a run of capitals is a word unless a small letter follows."""
    parts = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(name, "^_+", ""), "_", " "), F.lit("([A-Z]?[a-z0-9]+|[A-Z]+(?![a-z]))"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.lower(p)), " ")


def name_comment(name: Column) -> Column:
    """The comment that only says the name; empty for a name without words."""
    w = name_words(F.coalesce(name, F.lit("")))
    return F.when(w == "", "").otherwise(F.concat(F.lit("/// @notice "), F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)), F.lit(".")))


def neighbour_comment(donor: Column, params: Column, returns: Column) -> Column:
    """Notice and dev of a neighbour (a map of fields) over this function's own parameters (names) and returns (structs of name and text).

    A parameter or return takes the neighbour's text of that name or number; else it says its name in words.
    """
    d = F.coalesce(donor, F.create_map().cast("map<string,string>"))
    of = lambda k: F.nullif(F.try_element_at(d, k), F.lit(""))
    head = F.array_compact(F.array(*(F.concat(F.lit(f"/// @{t} "), of(F.lit(t))) for t in ("notice", "dev"))))
    own = lambda n: F.coalesce(F.nullif(name_words(n), F.lit("")), n)
    ps = F.transform(F.coalesce(params, F.array().cast("array<string>")), lambda n: F.concat(F.lit("/// @param "), n, F.lit(" "), F.coalesce(of(F.concat(F.lit("param:"), n)), own(n))))

    def said(r, i):
        name = F.trim(F.coalesce(r["name"], F.lit("")))
        text = F.coalesce(of(F.concat(F.lit("return:"), i.cast("string"))), F.when(name != "", name_words(name)).otherwise("the result"))
        return F.concat(F.lit("/// @return "), F.trim(F.concat(name, F.lit(" "), text)))

    rs = F.transform(F.coalesce(returns, F.array().cast("array<struct<name:string,text:string>>")), said)
    return F.array_join(F.concat(head, ps, rs), "\n")


# reports ---------------------------------------------------------------------------------------------------------


def cell(v, places: int = 3) -> str:
    """A value in a report: a dash for none, yes and no, decimals to three places."""
    return "—" if v is None else ("yes" if v else "no") if isinstance(v, bool) else f"{v:.{places}f}" if isinstance(v, float) else str(v)


def _rows_of(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report; name a larger bound or aggregate them")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A result as a Markdown table. More than ``most`` rows are an error, none is left out."""
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v).replace("|", r"\|").replace("\n", "<br>") for v in r) + " |" for r in _rows_of(df, most)])


#: Characters that LaTeX takes for its own, and what stands for them.
_LATEX = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "Σ": r"$\Sigma$", "—": "--"})


def latex(df: DataFrame, caption: str = "", label: str = "", most: int = 1000) -> str:
    """A result as a LaTeX table, its first column to the left and the others to the right."""
    line = lambda values: " & ".join(str(v).translate(_LATEX) for v in values) + r" \\"
    rows = [line(map(cell, r)) for r in _rows_of(df, most)]
    end = [*([rf"\caption{{{caption.translate(_LATEX)}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else [])]
    spec = "l" + "r" * (len(df.columns) - 1)
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\begin{{tabular}}{{{spec}}}", r"\toprule", line(df.columns), r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", *end, r"\end{table}"])


def interval(low: Column, high: Column, places: int = 3) -> Column:
    return F.format_string(f"[%.{places}f, %.{places}f]", low, high)
