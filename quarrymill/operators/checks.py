"""Integrity checks as rows that violate: (check, key, detail), unioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import header_params, header_returns
from .corpus import leaked


def _rows(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def duplicate_keys(df: DataFrame, check: str, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(g, check, F.concat_ws("|", *keys), F.col("n"))


def straddling_groups(pairs: DataFrame, group: str = "group_id", check: str = "groups_do_not_straddle") -> DataFrame:
    s = F.lower(F.trim("split"))
    g = pairs.where(s.isin("train", "val", "test")).groupBy(group).agg(F.count_distinct(s).alias("n")).where("n > 1")
    return _rows(g, check, F.col(group), F.col("n"))


def overlapping_docs(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("doc_start", "doc_end", "id")
    d = pairs.where("doc_start is not null").withColumn("before", F.lag("doc_end").over(w)).where("before > doc_start")
    return _rows(d, "no_overlapping_docs", F.col("id"), F.col("before") - F.col("doc_start"))


def verified_without_prose(pairs: DataFrame) -> DataFrame:
    none = (F.trim(F.coalesce("notice", F.lit(""))) == "") & (F.trim(F.coalesce("dev", F.lit(""))) == "")
    return _rows(pairs.where(F.col("verified") & none), "verified_have_prose", F.col("id"), F.lit("no notice, no dev"))


def bad_offsets(pairs: DataFrame) -> DataFrame:
    return _rows(pairs.where("doc_start >= doc_end or code_start >= code_end or doc_end > code_start"), "offsets_are_ordered", F.col("id"), F.concat_ws(",", "doc_start", "doc_end", "code_start", "code_end"))


def unknown_params(pairs: DataFrame) -> DataFrame:
    """Documented parameters that the header does not declare."""
    p = pairs.select("id", header_params(F.col("code")).alias("names"), F.explode("params").alias("name", "text")).where(~F.array_contains("names", F.col("name")))
    return _rows(p, "params_round_trip", F.col("id"), F.col("name"))


def dangling(child: DataFrame, parent: DataFrame, check: str, key: str, parent_key: str) -> DataFrame:
    d = child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _rows(d, check, F.col(key), F.col("n"))


def stale_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose size differs from the file's text in bytes."""
    m = manifest.groupBy("file").agg(F.max(F.struct("seen_at", "bytes")).alias("m")).select("file", "m.bytes")
    f = files.where("src is not null").groupBy("file").agg(F.max(F.struct("fetched_at", F.octet_length("src").alias("n"))).alias("f")).select("file", "f.n")
    return _rows(m.join(f, "file").where("bytes <> n"), "manifest_sizes", F.col("file"), F.col("bytes") - F.col("n"))


def manifest_states(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(``file``, ``state``): same, changed, missing (in the manifest only) or extra; both have ``file`` and ``sha1``, once per file."""
    j = manifest.select("file", F.col("sha1").alias("a"), F.lit(True).alias("m")).join(files.select("file", F.col("sha1").alias("b"), F.lit(True).alias("f")), "file", "full")
    state = F.when(F.col("m").isNull(), "extra").when(F.col("f").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return j.select("file", state.alias("state"))


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return _rows(manifest_states(manifest, files).where("state <> 'same'"), "manifest_hashes", F.col("file"), F.col("state"))


def sliced_back(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs whose offsets do not give their code, or whose spans do not give their comment; ``files`` has ``file`` and ``src``, once per file."""
    j = pairs.join(files.select("file", "src"), "file", "left")
    cut_ = lambda a, b: F.substring(F.col("src"), a + 1, b - a)
    doc = F.array_join(F.transform("doc_spans", lambda s: cut_(F.get(s, 0), F.get(s, 1))), "")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    what = F.array_compact(F.array(F.when(bad(cut_(F.col("code_start"), F.col("code_end")) == F.col("code")), "code"), F.when(F.col("doc_raw").isNotNull() & bad(doc == F.col("doc_raw")), "comment")))
    return _rows(j.select("id", F.explode(what).alias("what")), "offsets_slice_back", F.col("id"), F.col("what"))


def odd_spans(pairs: DataFrame) -> DataFrame:
    """Pairs whose comment does not begin and end with its spans."""
    some = pairs.where("size(doc_spans) > 0 and (get(get(doc_spans, 0), 0) <> doc_start or get(try_element_at(doc_spans, -1), 1) <> doc_end)")
    return _rows(some, "spans_have_ends", F.col("id"), F.col("doc_start"))


def not_single_docs(pairs: DataFrame) -> DataFrame:
    """Pairs whose comment is several: more than one block, a block beside lines, or a block in several spans."""
    blocks = F.regexp_count("doc_raw", F.lit(r"/\*\*"))
    bad = pairs.where((blocks > 1) | (blocks == 1) & (F.contains("doc_raw", F.lit("///")) | (F.size("doc_spans") != 1)))
    return _rows(bad, "docs_are_single_comments", F.col("id"), F.regexp_count("doc_raw", F.lit(r"/\*\*")))


def talking_dependencies(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pairs from files that are only dependencies."""
    dep = manifest.where("role = 'dependency'").select("file").distinct()
    return _rows(pairs.join(dep, "file", "left_semi"), "dependencies_are_silent", F.col("id"), F.col("file"))


def missing_artifacts(found: DataFrame, wanted: list[str], may_be_empty: tuple[str, ...] = ()) -> DataFrame:
    """Of the wanted files those that are not in ``found`` (``file``, ``text``), are blank though they may not be, or hold a ``{{`` that was to be filled in."""
    want = found.sparkSession.createDataFrame([(w, w in may_be_empty) for w in wanted], "file string, blank boolean")
    j = want.join(found.select("file", "text"), "file", "left")
    why = F.when(F.col("text").isNull(), "missing").when((F.trim("text") == "") & ~F.col("blank"), "empty").when(F.contains("text", F.lit("{{")), "placeholder")
    return _rows(j.withColumn("why", why).where("why is not null"), "artifacts_exist", F.col("file"), F.col("why"))


def not_allowed(units: DataFrame, allowed: DataFrame) -> DataFrame:
    """Retrieval units of files that are not on the list: what is not allowed is denied."""
    return _rows(units.join(allowed.select("file").distinct(), "file", "left_anti"), "allow_list", F.col("pair_id"), F.col("file"))


def require(violations_: DataFrame, most: int = 5) -> None:
    """Raises if there is a violation, naming the first few by check and key."""
    first = violations_.orderBy("check", "key").limit(most).collect()
    if first:
        raise ValueError("; ".join(f"[{r['check']}] {r['key']}: {r['detail']}" for r in first))


def audit(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(``item``, ``found``, ``ok``) of a corpus: projects in several splits, evaluation texts that training has, functions whose returns are not all recorded, and pairs that are indexed."""
    s = F.lower(F.trim("split"))
    mixed = pairs.where(s.isin("train", "val", "test")).groupBy("project").agg(F.count_distinct(s).alias("n")).where("n > 1")
    missing = pairs.where(F.col("kind").isin("function", "receive", "fallback") & (header_returns(F.col("code")) != F.coalesce(F.greatest(F.size("returns"), F.lit(0)), F.lit(0))))
    have = units.select(F.col("pair_id").alias("id"), F.lit(1).alias("has")).distinct()
    none = lambda df, item: df.agg(F.lit(item).alias("item"), F.count(F.lit(1)).alias("found"), (F.count(F.lit(1)) == 0).alias("ok"))
    covered = pairs.select("id").join(have, "id", "left").agg(F.lit("coverage").alias("item"), F.count("has").alias("found"), (F.count("has") == F.count(F.lit(1))).alias("ok"))
    return none(mixed, "splits_disjoint").unionByName(none(leaked(pairs), "no_leakage")).unionByName(none(missing, "returns_complete")).unionByName(covered)


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
