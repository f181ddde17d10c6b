"""Generators, metrics and encoders as hooks; evidence; files, stores and growing tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import classify, experiment, facts, tables
from quarrymill.sources import files, store
from quarrymill.streaming import append


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_generate(spark):
    ctx = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "pair_id string, n int")
    matrix = spark.createDataFrame([("g", 1), ("h", 2)], "config string, seed int")
    done = spark.createDataFrame([("g", 1, "a", None), ("g", 1, "b", "boom"), ("h", 2, "zz", None)], "config string, seed int, pair_id string, error string")

    def make(seed):
        def run(row):
            if seed == 2 and row["pair_id"] == "c":
                raise RuntimeError("no")
            return str(10 // row["n"] + seed)

        return run

    got = {(r["config"], r["pair_id"]): (r["final"], r["error"]) for r in experiment.generate(experiment.open_tasks(ctx, matrix, done), make, batch=2).collect()}
    assert got == {("g", "b"): (None, "ZeroDivisionError: integer division or modulo by zero"), ("g", "c"): ("6", None), ("h", "a"): ("12", None), ("h", "b"): (None, "ZeroDivisionError: integer division or modulo by zero"), ("h", "c"): (None, "RuntimeError: no")}
    assert experiment.open_tasks(ctx, matrix).count() == 6 and experiment.generate(experiment.open_tasks(ctx.limit(0), matrix), make).count() == 0


def test_metric_and_encoder_hooks(spark):
    df = spark.createDataFrame([("ab", "abc"), (" ", "x"), (None, "x"), ("y", None)], "c string, r string")
    got = experiment.scored(df, "c", "r", {"share": experiment.text_metric(lambda a, b: len(a) / max(1, len(b)))}).collect()
    assert [r["share"] and round(r["share"], 3) for r in got] == [0.667, None, None, 1.0]
    u = spark.createDataFrame([("a", {"code": "xx", "ast": " ", "odd": "q"}), ("b", None), ("c", {"cfg": "yyy", "code": None})], "pair_id string, views map<string,string>")
    assert rows(experiment.embedded(u, lambda ts: [[len(t), 1.0] for t in ts])) == [("a", "code", [2.0, 1.0]), ("c", "cfg", [3.0, 1.0])]


def test_fact_filters(spark):
    row = ("f", "C", "g", 1, 9, "p", [("F1", "kind", "function")], [("N1", "ENTRY", 1, 2, ["s"]), ("N2", "EXPR", 3, 4, [])], [], [("P1", ["N1", "N2"])], [("C1", "external", "x.y", "N2")], [("D1", "a", ["b", "c"])], [("R1", "require", "a > 0", "zero", "N1")], [("E1", "Ev", ["a"], "N2")], [])
    t = spark.createDataFrame([row], facts.SCHEMA)
    whole = t.select(facts.evidence().alias("e")).first()["e"]
    assert whole.startswith("[FACTS]\n  F1   kind               function\n\n[REVERTS]\n  R1   require  a > 0   message: 'zero'   at N1\n\n[EVENTS]\n  E1   Ev(a)   at N2\n\n[CFG]\n  N1   ENTRY           [writes state: s]\n")
    assert "\n  P1   N1 -> N2\n\n[CALLS]\n  C1   external   x.y   at N2\n\n[DEPS]\n  D1   a <- b, c" in whole
    assert "1 more nodes left out" in t.select(facts.evidence(max_nodes=1).alias("e")).first()["e"]
    bare = facts.drop_families(t, *facts.FAMILIES)
    assert bare.select(facts.evidence().alias("e")).first()["e"] == "(no facts on this function)"
    filters = {"none": None, "no_guards": experiment.without("reverts")}
    assert experiment.filtered(t, "none", filters).count() == 0 and "[REVERTS]" not in experiment.filtered(t, "no_guards", filters).select(facts.evidence().alias("e")).first()["e"]
    assert experiment.filtered(t, "full", filters).count() == 1


def test_syntax_trees(spark):
    tree = {"nodeType": "A", "src": "0:9:0", "doc": {"nodeType": "StructuredDocumentation", "x": {"nodeType": "Hidden"}}, "kids": [{"nodeType": "C", "src": "5:1:0"}, {"nodeType": "B", "src": "2:1:0", "k": {"nodeType": "D", "src": "3:1"}}], "name": "n"}
    assert facts.ast_types(json.dumps(tree)) == ["A", "B", "D", "C"] and facts.ast_types(json.dumps(tree), 2) == ["A", "B"] and facts.ast_types(None) == []
    df = spark.createDataFrame([(json.dumps(tree),), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(facts.ast_view(F.col("t"))).collect()] == ["A B D C", "", ""]


def test_texts(spark):
    assert first(spark, text.echo_words(F.lit("setMaxFee_now2"))) == ["set", "max", "fee", "now2"]
    assert first(spark, text.same_tokens(F.lit("The  Cat!"), F.lit("the cat"))) and not first(spark, text.same_tokens(F.lit(None).cast("string"), F.lit("x")))
    assert first(spark, text.detokenise(F.lit(" f ( uint a , b [ 1 ] ) ; x . y "))) == "f(uint a, b[1]); x.y"
    assert first(spark, tables.plain_comment(F.lit("/**\n * @notice A\n *\n */\n/// @dev B"))) == "@notice A\n@dev B" and first(spark, tables.plain_comment(F.lit(None).cast("string"))) == "(empty)"


def test_picks(spark):
    df = spark.createDataFrame([(f"u{i}", float(i)) for i in range(10)], "pair_id string, score double")
    take = lambda how, n: [r["pair_id"] for r in tables.picked(df, how, n).orderBy(F.desc("score")).collect()]
    assert take("best", 2) == ["u9", "u8"] and take("worst", 2) == ["u1", "u0"] and take("spread", 3) == ["u9", "u6", "u3"] and len(take("spread", 99)) == 10
    with pytest.raises(ValueError):
        tables.picked(df, "odd", 1)


def test_style(spark):
    df = spark.createDataFrame([("a", "Returns the owner of it."), ("a", "The fee. It is `low`"), ("a", " "), ("b", None), ("a", "This function moves all")], "g string, t string")
    s = classify.house_style(df, "t", "g").first()
    assert (s["n"], round(s["one_sentence"], 2), round(s["starts_the"], 2), round(s["starts_this"], 2), round(s["third_person"], 2)) == (3, 0.67, 0.33, 0.33, 0.67)
    assert classify.style_rules(classify.house_style(df, "t", "g"), "g").first()["rule"].startswith("about 5 words, one sentence (67 %), opening on a verb")
    assert [tuple(r) for r in classify.first_words(df, "t", "g", 2).select("word", "k").collect()] == [("Returns", 1), ("The", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("one\nzwei\nthree")
    a, b = (str(tmp_path / f"{n}.txt") for n in "ab")
    got = {r["path"]: (r["lines"], r["ok"]) for r in files.verify_lines(spark, {a: (2, None), b: (3, "0" * 40)}).collect()}
    assert got == {a: (2, True), b: (3, False)}
    assert rows(files.differing_lines(spark, a, b)) == [(1, "two", "zwei"), (2, None, "three")]
    slug = lambda f: first(spark, files.project_of(F.lit(f), [("alpha", "a"), ("beta", "b")]))
    assert (slug("2022-Beta-audit/x.sol"), slug("alpha-beta/y.sol"), slug("other/z.sol")) == ("b", "a", "other")


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    store.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert rows(spark.read.schema("a int, b string").json(str(tmp_path / "j"))) == rows(df)
    path = str(tmp_path / "t")
    assert store.append_new(spark, df, path, "a") == 2 and store.append_new(spark, df.unionByName(spark.createDataFrame([(3, "y"), (3, "y")], "a int, b string")), path, "a") == 1
    fs = spark.createDataFrame([(f"f{i}", str(i)) for i in range(50)], "file string, sha1 string")
    digest = lambda d: store.tree_digest(d, 8).first()[0]
    assert digest(fs) == digest(fs.repartition(7)) != digest(fs.where("file <> 'f7'"))
    src = spark.createDataFrame([("p",), ("q",), (None,)], "src string")
    cache = str(tmp_path / "c")
    todo = store.unsharded(spark, src, cache, "v1")
    assert todo.count() == 3
    todo.where("src = 'p'").write.parquet(cache)
    assert store.unsharded(spark, src, cache, "v1").count() == 2 and store.unsharded(spark, src, cache, "v2").count() == 3
    ledger = spark.createDataFrame([(1, "t1", {"x": "x_1", "y": "y_1"}), (2, "t2", {"x": "x_2"})], "run int, at string, files map<string,string>")
    assert rows(store.index_view(ledger)) == [("x", "x_2", 2, "t2"), ("y", "y_1", 1, "t1")]


def test_growing_tables(spark, tmp_path):
    schema = "config string, error string, finished_at timestamp"
    path = str(tmp_path / "runs")
    at = datetime(2031, 1, 1)
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    put([("g", None, at), ("g", "boom", at), ("h", "", at)])
    stream = lambda: append.read_growing(spark, path, schema, 1)
    append.follow(append.progress(stream(), "config"), "so_far", str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.table("so_far").select("config", "done", "errors")) == [("g", 2, 1), ("h", 1, 0)]

    def merge(last, new):
        new = new.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
        return new if last is None else last.unionByName(new).groupBy("config").agg(F.sum("n").alias("n"))

    for _ in range(2):
        append.merge_each(stream(), str(tmp_path / "m"), str(tmp_path / "c2"), merge).awaitTermination()
        put([("g", None, at)])
    assert rows(spark.read.parquet(str(tmp_path / "m" / "v=1"))) == [("g", 3), ("h", 1)]
