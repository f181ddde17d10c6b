"""Documentation as a compiler reads it."""

import json

from pyspark.sql import functions as F

from quarrymill.functions import compiled

DOC = {
    "C": {
        "userdoc": {"methods": {"f(uint256,(address,bytes)[])": {"notice": "Does  it"}, "constructor": {"notice": "made"}}, "errors": {"Bad(uint256)": [{"notice": "first"}, {"notice": "other"}]}},
        "devdoc": {"title": "T", "methods": {"f(uint256,(address,bytes)[])": {"params": {"x": "much"}}}},
    }
}


def test_members():
    c = DOC["C"]
    assert compiled.arity("f(uint256,(address,bytes)[])") == 2 and compiled.arity("f()") == 0 and compiled.arity("constructor") == 0
    assert compiled.documented(c, "f(uint256,Order[])") == ({"notice": "Does  it"}, {"params": {"x": "much"}})
    assert compiled.documented(c, "f(uint256)") == ({}, {}) == compiled.documented(None, "f()") and compiled.documented(c, "Bad(uint256)")[0] == {"notice": "first"}
    assert compiled.documented(c, "constructor")[0] == {"notice": "made"}


def test_differences(spark):
    other = json.loads(json.dumps(DOC).replace("Does  it", "Does it").replace('"T"', '"U"'))
    other["C"]["devdoc"]["methods"]["f(uint256,(address,bytes)[])"]["params"]["x"] = "little"
    want = ["C.devdoc.methods.f(uint256,(address,bytes)[])", "C.devdoc.title"]
    assert compiled.differences(DOC, other) == want and compiled.differences(DOC, DOC) == [] and len(compiled.differences(DOC, None)) == 5
    df = spark.createDataFrame([(json.dumps(DOC), json.dumps(other)), ("{broken", "{}"), (None, "{}"), ("{}", "{}")], "a string, b string")
    assert [r[0] for r in df.select(compiled.differing(F.col("a"), F.col("b"))).collect()] == [want, None, None, []]


def test_kept_tags(spark):
    c = json.dumps(DOC["C"])
    rows = [(c, "f(uint256,O[])", "@notice N\n@param x a"), (c, "f(uint256,O[])", "@param y a\n@param z b"), (c, "g()", "@notice N"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, s string, t string").select(compiled.kept_tags(F.col("c"), F.col("s"), F.col("t")).alias("k"))
    assert [(r["k"]["kept"], r["k"]["dropped"]) for r in df.collect()] == [(True, []), (False, ["y", "z"]), (False, []), (True, [])]


def test_repaired(spark):
    d = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    m = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("y"))
    assert spark.range(1).select(compiled.repaired(m, d).alias("x"), compiled.repaired(F.lit(None).cast("map<string,string>"), d).alias("y")).first() == ({"a": "1", "b": "x", "c": "y"}, {"a": "1", "b": "2"})
