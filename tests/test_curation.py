"""Critics, curation, the index, comparison tables and file checks on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import solidity
from quarrymill.operators import checks, corpus, critics, curate, gates, runs, stats, tables
from quarrymill.sources import files, index


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def test_verdict(spark):
    det = critics.of_defects(words("param_missing:to", "text_short", "style_citation:[F1]"), words("to", "x"), F.lit(1))
    claim = lambda v, q, s, *i: F.struct(F.lit(v).alias("verdict"), F.lit(q).alias("quote"), F.lit(s).alias("severity"), words(*i).alias("ids"))
    sem = critics.of_claims(F.array(claim("UNSUPPORTED", "a", "low"), claim("UNSUPPORTED", "@param to who", "high"), claim(None, "b", None, "F1"), claim("CONTRADICTED", "@return z", "low", "F2", "R1"), claim("UNSUPPORTED", "c", "odd")))
    g = first(spark, critics.merge(det, sem))
    assert [f["text"] for f in g["must_fix"]] == ["param_missing:to", "text_short"] and [f["subject"] for f in g["suppressed"]] == ["to"]
    assert [f["text"] for f in g["should_fix"]] == ["style_citation:[F1]", "CONTRADICTED: @return z", "UNSUPPORTED: b", "UNSUPPORTED: a", "UNSUPPORTED: c"]
    assert (g["blocking"], g["total"], g["clean"]) == (2, 7, False) and g["must_fix"][0]["why"] == "parameter to is declared but not described" and g["should_fix"][1]["subject"] == "z"
    text = first(spark, critics.feedback(critics.merge(det, sem), words("say when it reverts")))
    assert text.startswith("MUST FIX\n  1. [param_missing:to] ") and "\nSHOULD FIX\n  1. " in text and "(rows: F2, R1)" in text and text.endswith("COULD ADD\n  1. say when it reverts")
    none = critics.merge(critics.of_defects(F.lit(None).cast("array<string>")), critics.of_claims(F.array().cast("array<struct<verdict:string,quote:string,severity:string,ids:array<string>>>")))
    assert first(spark, none)["clean"] and first(spark, critics.feedback(none)) == "Nothing to fix."
    assert not first(spark, critics.critic_ok(F.lit(None).cast("boolean"), F.array())) and first(spark, critics.critic_ok(F.lit(True), F.array()))


def test_access_findings(spark):
    g = gates.code_gates(F.lit("function f(uint x) external onlyOwner {}"))
    got = first(spark, critics.of_access(F.lit("Moves it [F1, R2]. Only the admin."), g, F.create_map(F.lit("param:x"), F.lit("only the owner"))))
    assert [(f["text"], f["severity"]) for f in got] == [("access_undeclared:onlyOwner", "blocking"), ("style_citation:[F1, R2]", "blocking"), ("access_misplaced:param:x", "blocking"), ("access_invented:admin", "high")]


def test_rounds(spark):
    a = F.array(*(F.struct(F.lit(b).alias("blocking"), F.lit(t).alias("total"), F.lit(r).alias("round")) for b, t, r in ((1, 1, 0), (0, 3, 1), (0, 2, 2), (0, 2, 3))))
    assert first(spark, critics.best_round(a))["round"] == 3 and first(spark, critics.best_round(F.slice(a, 1, 0))) is None
    detail = F.create_map(F.lit("compiles"), F.lit("true"), F.lit("raw"), F.lit("long"))
    assert first(spark, critics.thin(detail, F.array())) == {"compiles": "true"} and len(first(spark, critics.thin(detail, words("x")))) == 2
    assert first(spark, critics.count_calls(F.create_map(F.lit("L7"), words("a", "b"), F.lit("L2"), F.lit(None).cast("array<string>")))) == {"L7": 2, "L2": 1, "total": 3}
    assert first(spark, critics.count_calls(F.lit(None).cast("map<string,array<string>>"))) == {"total": 0}


def test_promote_and_stage(spark):
    s = "id string, project string, container string, signature string"
    v = spark.createDataFrame([("a", "p", "C", "f()"), ("b", "p", None, "g()")], s)
    q = spark.createDataFrame([("a", "p", "C", "f()"), ("c", "p", "C", "h()"), ("d", "p", "C", "i()")], s)
    keys = spark.createDataFrame([("p|C|f()",), ("p|C|h()",), ("p|C|h()",), (None,)], "key string")
    assert rows(curate.promote(v, q, keys, "val").select("id", "promoted", "split")) == [("a", False, "val"), ("b", False, "excluded"), ("c", True, "val")]
    m = spark.createDataFrame([("z", "C", "f()", 1), ("a", "C", "f()", 2), ("a", "C", "f()", 0)], "file string, contract string, sig string, index int")
    placed, clashes = curate.stage(m, "s")
    assert rows(placed.select("key", "index")) == [("s-00000|C|f()", 0), ("s-00001|C|f()", 1)] and clashes.count() == 1
    pairs = spark.createDataFrame([("a", "train"), ("a", " TEST"), ("b", "train"), ("c", "train"), ("d", None)], "file string, split string")
    assert rows(curate.allow_list(pairs, spark.createDataFrame([("c",)], "file string"))) == [("b",)]


def test_aligned_and_round_trip(spark):
    lines = spark.createDataFrame([(0, "function f ( uint a ) public { }", " Adds  one "), (1, "not code", "x"), (2, None, None)], "line int, code string, text string")
    got = curate.aligned_pairs(lines, solidity.declared(F.col("code")), "x").collect()
    assert [(r["id"], r["signature"], r["visibility"]) for r in got] == [("x0000", "f(uint)", "public")]
    ref = spark.createDataFrame([(0, "Adds one"), (1, "b")], "index int, reference string")
    pairs = spark.createDataFrame([(0, "Adds   one"), (1, "c"), (9, "d")], "index int, notice string")
    assert [r["index"] for r in curate.round_trip(pairs, ref).orderBy("index").collect()] == [1, 9]


def test_samples(spark):
    df = spark.createDataFrame([(i, "function f() external onlyOwner {}" if i % 10 == 3 else "function f() external {}") for i in range(40)], "line int, code string")
    take = lambda k: [r["line"] for r in curate.gated_first(df, k, gates.code_gates(F.col("code"))).collect()]
    assert take(3) == [3, 13, 23] and take(99) == list(range(40)) and take(8) == [0, 3, 10, 13, 20, 23, 30, 33]
    c = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "x string")
    assert [tuple(r) for r in curate.most_common(c, "x", 2).collect()] == [("b", 2), ("a", 1)]
    both = curate.matrix(spark.createDataFrame([("g",), ("h",)], "config string"), spark.createDataFrame([(1,), (2,)], "seed int"), spark.createDataFrame([("g", 1)], "config string, seed int"))
    assert rows(both) == [("g", 2), ("h", 1), ("h", 2)]
    tags = words("q:7b", "l:70b")
    assert [first(spark, curate.resolves(F.lit(w), tags)) for w in ("q:7b", "q", "q:13b", "z")] == [True, True, False, False]


def test_calibration(spark):
    s = "defects array<string>, reported array<struct<severity:string>>"
    p = spark.createDataFrame([(["a:x", "b"], [("low",)]), (["a:y"], None)], s)
    v = spark.createDataFrame([(None, [("low",)]), (None, [("high",), ("low",)]), (None, None), (None, [])], s)
    assert rows(curate.calibration(p, v)) == [("a", 2, 0.5), ("b", 1, 1.0), ("verified", 4, 0.25)]
    f = spark.createDataFrame([(1, "c", "yes"), (1, "d", "no")], "id int, claim string, verdict string")
    b = spark.createDataFrame([(1, "c", "yes"), (1, "d", "yes"), (2, "c", "no")], "id int, claim string, verdict string")
    assert curate.stability(f, b).first() == (2, 0.5, False) and curate.stability(f.limit(0), b).first() == (0, None, False)


def test_donors(spark):
    specs = spark.createDataFrame([("@oz/c/a/X.sol",), ("@oz/c/Y.sol",), ("lib/Z.sol",), ("bare",)], "spec string")
    donors = spark.createDataFrame([("d1/a/X.sol", "0.8"), ("d1/Y.sol", "0.8"), ("d2/Y.sol", "0.8"), ("d3/sub/Y.sol", "0.6"), ("e/Z.sol", None), ("odd/Q.sol", "0.8")], "path string, version string")
    assert rows(curate.donor_trees(specs, donors)) == [("@oz/c/", "0.6", "d3/sub/", 1), ("@oz/c/", "0.8", "d1/", 2), ("lib/", None, "e/", 1)]


def test_index(spark):
    a, b = "contract C { function f(uint x) public { x; /* note */ } function g() external; }", "library L { function h() internal {} }"
    src = spark.createDataFrame([("a", a), ("b", b), ("n", None)], "file string, src string")
    fs, fn = index.build(src)
    assert rows(fs.select("file", "nfuncs", "problem")) == [("a", 1, None), ("b", 1, None), ("n", 0, None)]
    assert rows(fn.select("file", "contract", "bkey", "sig")) == [("a", "C", "f/1", "f(uint)"), ("b", "L", "h/0", "h()")]
    plain = index.build(spark.createDataFrame([("a", a.replace("/* note */", ""))], "file string, src string"))[1]
    assert plain.first()["ekey"] == fn.where("file = 'a'").first()["ekey"]
    new = spark.createDataFrame([("a", a), ("b", b.replace("h()", "k()"))], "file string, src string")
    assert rows(index.changed(new, fs).select("file")) == [("b",)]
    fs2, fn2 = index.refresh(new, fs, fn)
    assert rows(fn2.select("file", "name")) == [("a", "f"), ("b", "k")] and index.summary(fs2).first() == (3, 2, 0)


def test_cache(spark):
    req = spark.createDataFrame([({"m": "x", "p": "1"},), ({"p": "1", "m": "x"},), ({"m": "x", "p": None},), ({"m": "x", "p": ""},)], "request map<string,string>")
    keys = [r[0] for r in req.select(index.call_key(F.col("request"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    cache = spark.createDataFrame([(keys[0], "yes")], "key string, reply string")
    hits, misses = index.cached(req, cache)
    assert hits.count() == 2 and misses.count() == 2
    assert rows(index.put(cache, spark.createDataFrame([(keys[0], "no"), (keys[2], "new")], "key string, reply string"))) == sorted([(keys[0], "yes"), (keys[2], "new")], key=repr)


def test_tables(spark):
    df = spark.createDataFrame([("a", "the cat sat on it", "the cat sat on it"), ("a", "", "dog"), ("a", None, "bird"), ("b", "x", "y"), ("b", "q", " ")], "g string, c string, r string")
    got = {r["g"]: r for r in tables.bleu_table(df, ["g"], "c", "r", ("ba", "b1")).collect()}
    assert (got["a"]["n"], got["a"]["empty"], got["b"]["n"], got["b"]["ba"]) == (3, 2, 1, 0.0) and 0 < got["a"]["ba"] < got["a"]["b1"] < 100
    x = spark.createDataFrame([(1, "r", " r "), (2, "t", "u"), (3, "t", "t"), (4, "v", "w")], "i int, ref string, hyp string")
    subsets = {}
    for i, s in rows(tables.ladder(x, "ref", "hyp", spark.createDataFrame([("t ",), (None,)], "text string")).select("i", "subset")):
        subsets.setdefault(s, []).append(i)
    assert subsets == {"all": [1, 2, 3, 4], "not reproduced": [2, 4], "not leaked": [1, 4], "neither": [4]}
    assert [r["place"] for r in tables.in_order(spark.createDataFrame([("b",), ("z",), (None,), ("a",)], "c string"), "c", ["a", "b"]).collect()] == [2, 3, 4, 1]
    ch = {r["k"]: r for r in tables.changes(spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, v double"), spark.createDataFrame([(1, 3.5), (3, 1.0)], "k int, v double"), ["k"], ["v"]).collect()}
    assert ch[1]["v_change"] == 1.5 and ch[2]["v_change"] is None and len(ch) == 3
    ratio = tables.shape_ratio(spark.createDataFrame([("n", 6.0)], "k string, median_words double"), spark.createDataFrame([("n", 0.5)], "k string, median_words double"), "k").first()
    assert ratio["ratio"] == 6.0


def test_baselines(spark):
    for name, want in (("getTotalSupply", "get total supply"), ("_max_LTV2", "max ltv2"), ("", ""), ("HTMLPage", "html page")):
        got = first(spark, tables.name_words(F.lit(name)))
        assert got == want or name == "_max_LTV2" and got in ("max ltv 2", "max ltv2", "max lt v2"), (name, got)
    assert first(spark, tables.name_comment(F.lit("setFee"))) == "/// @notice Set fee." and first(spark, tables.name_comment(F.lit(None).cast("string"))) == ""
    donor = F.create_map(F.lit("notice"), F.lit("N"), F.lit("param:to"), F.lit("who"), F.lit("return:0"), F.lit("R"))
    rets = F.array(F.struct(F.lit("ok").alias("name"), F.lit("").alias("text")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("").alias("text")))
    assert first(spark, tables.neighbour_comment(donor, words("to", "maxFee"), rets)) == "/// @notice N\n/// @param to who\n/// @param maxFee max fee\n/// @return ok R\n/// @return the result"
    assert first(spark, tables.neighbour_comment(F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<name:string,text:string>>"))) == ""


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 1, 0.12345, True), ("c|d", None, None, None)], "name string, n int, x double, ok boolean")
    md = tables.markdown(df).splitlines()
    assert md[0] == "| name | n | x | ok |" and md[2] == "| a_b | 1 | 0.123 | yes |" and md[3] == r"| c\|d | — | — | — |"
    tex = tables.latex(df, "50 % of Σ", "t")
    assert r"a\_b & 1 & 0.123 & yes \\" in tex and r"\caption{50 \% of $\Sigma$}" in tex and r"\begin{tabular}{lrrr}" in tex and r"-- & --" in tex
    with pytest.raises(ValueError):
        tables.markdown(df, most=1)


def test_scopes_and_significance(spark):
    a = spark.createDataFrame([("x", True), ("y", True), ("z", False), ("w", False)], "config string, finding boolean")
    b = spark.createDataFrame([("x", True), ("y", False), ("z", True), ("v", True)], "config string, finding boolean")
    assert {r["config"]: r["change"] for r in stats.compare_scopes(a, b).collect()} == {"x": "unchanged", "y": "LOST", "z": "GAINED", "w": "not run in both", "v": "not run in both"}
    t = spark.createDataFrame([(0.1, 0.2, 0.01), (-0.1, 0.2, 0.01), (-0.2, -0.1, 0.2)], "low double, high double, p double")
    assert [r["significant"] for r in stats.significant(t).collect()] == [True, False, False]
    d = spark.createDataFrame([("x", 0.5), ("y", 0.1)], "config string, diff double")
    sd = spark.createDataFrame([("base", 0.2), ("x", 9.0)], "config string, sd double")
    assert {r["config"]: r["within_noise"] for r in stats.within_noise(d, sd, "base").collect()} == {"x": False, "y": True}


def test_prefixes(spark):
    trees = spark.createDataFrame([("@a/", "one", 2), ("@a/b/", "two", 1), ("a_b/", "three", 1), ("@a/b/", "four", 0)], "prefix string, tree string, priority int")
    specs = spark.createDataFrame([("@a/b/c",), ("@a/x",), ("axb/f",), (None,)], "spec string")
    assert rows(files.longest_prefix(specs, trees).select("spec", "tree")) == rows(spark.createDataFrame([("@a/b/c", "four"), ("@a/x", "one"), ("axb/f", None), (None, None)], "s string, t string"))


def test_file_checks(spark):
    man = spark.createDataFrame([("a", "1", "scored"), ("b", "2", "dependency"), ("c", None, "scored")], "file string, sha1 string, role string")
    have = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file string, sha1 string")
    assert {tuple(r) for r in checks.manifest_states(man, have).collect()} == {("a", "same"), ("b", "changed"), ("c", "missing"), ("d", "extra")} and checks.stale(man, have).count() == 3
    src = spark.createDataFrame([("a", "/// x\nfunction f() {}")], "file string, src string")
    s = "id string, file string, code string, code_start int, code_end int, doc_raw string, doc_spans array<array<int>>, doc_start int, doc_end int"
    p = spark.createDataFrame([("1", "a", "function f() {}", 6, 21, "/// x", [[0, 5]], 0, 5), ("2", "a", "function f() {}", 7, 21, "/** y */ /** z */", [[0, 5]], 1, 5), ("3", "b", "x", 0, 1, None, None, None, None)], s)
    assert rows(checks.sliced_back(p, src).select("key", "detail")) == [("2", "code"), ("2", "comment"), ("3", "code")]
    assert [r["key"] for r in checks.not_single_docs(p).collect()] == ["2"] == [r["key"] for r in checks.odd_spans(p).collect()]
    assert [r["key"] for r in checks.talking_dependencies(p, man).collect()] == ["3"]
    art = spark.createDataFrame([("x", "ok"), ("y", " "), ("z", "{{name}}"), ("e", "")], "file string, text string")
    assert rows(checks.missing_artifacts(art, ["x", "y", "z", "w", "e"], ("e",)).select("key", "detail")) == [("w", "missing"), ("y", "empty"), ("z", "placeholder")]
    units = spark.createDataFrame([("u", "a"), ("v", "q")], "pair_id string, file string")
    assert [r["key"] for r in checks.not_allowed(units, have).collect()] == ["v"]
    checks.require(checks.not_allowed(units.limit(1), have))
    with pytest.raises(ValueError, match="allow_list"):
        checks.require(checks.not_allowed(units, have))


def test_runs(spark):
    at = lambda h: datetime(2031, 1, 1, h)
    df = spark.createDataFrame([(1, 1, "p", None, "/// a", at(0), 0.5), (2, 1, "p", "", "// b", at(2), 0.7), (3, 2, "q", "boom", None, at(1), None)], "run_id long, seed int, pair_id string, error string, final string, finished_at timestamp, support_rate double")
    assert rows(runs.by_seed(df).select("seed", "pair_id", "run_id")) == [(1, "p", 2)]
    p = runs.pace(df, 6, F.lit(at(3))).first()
    assert (p["done"], p["errors"], p["per_hour"], p["hours_left"]) == (3, 1, 1.0, 3.0)
    assert runs.pace(df.limit(0), 6, F.lit(at(3))).first()["hours_left"] is None
    assert [r[0] for r in df.orderBy("run_id").select(runs.marker(F.col("final"))).collect()] == ["///", "//", "bare or empty"]
    m = F.create_map(F.lit("notice"), F.lit("a"), F.lit("param:x"), F.lit("b"), F.lit("author"), F.lit("c"))
    assert first(spark, runs.extra_fields(m, F.create_map(F.lit("notice"), F.lit("")))) == ["author", "param:x"]
    assert first(spark, runs.view(m, "param")) == {"param:x": "b"} and len(first(spark, runs.view(m, "whole"))) == 3
    with pytest.raises(ValueError):
        runs.view(m, "all")
    assert runs.both_trees(df, df.drop("final")).count() == 6
    with pytest.raises(ValueError):
        corpus.in_scope(df, kinds=["method"])
