"""Gates, verbs, inherited text, fact tables and units on small cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import facts, gates, inherit, units, verbs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, kind, who",
    [
        ("onlyOwner", "caller", "owner"), ("onlyGov", "caller", "governance"), ("onlyHolderOrDelegate", "caller", "holder or delegate"), ("onlyFactoryOwner", "caller", "factory owner"),
        ("auth", "caller", None), ("nonReentrant", "reentrancy", None), ("locked", "reentrancy", None), ("nonReentrancy", "reentrancy", None), ("onlyLive", "state", None), ("whenNotPaused", "state", None),
        ("onlyOrchestrated", "state", None), ("onlyEnabledRoute", "state", None), ("onlyActiveOwner", "caller", "owner"), ("lockedUp", "other", None), ("", "other", None), ("___", "other", None),
    ],
)
def test_gate(spark, name, kind, who):
    assert one(spark, gates.kind_of(F.lit(name))) == kind and one(spark, gates.principal_of(F.lit(name))) == who


CODE = "function f(function(uint) external cb, uint x) external onlyRole(ADMIN_ROLE) nonReentrant returns (bool ok) { require(msg.sender == x); }"


def test_gates_of_code(spark):
    names = lambda c: [g["name"] for g in one(spark, c)]
    assert names(gates.code_gates(F.lit("function f(uint x) external onlyOwner nonReentrant returns (bool) { x; }"))) == ["onlyOwner", "nonReentrant"]
    assert names(gates.code_gates(F.lit("function f() external onlyRole(ADMIN_ROLE) {}"))) == ["onlyRole"]
    assert names(gates.code_gates(F.lit("function f() external onlyOwner;"))) == [] and names(gates.code_gates(F.lit(None).cast("string"))) == []
    table = F.array(F.lit(" onlyGov "), F.lit(""))
    guards = F.array(F.lit("msg.sender == HUB"), F.lit("x > 0"), F.lit("isKeeper[_msgSender()]"))
    got = one(spark, gates.gates(F.lit(CODE), table, guards))
    assert [(g["name"], g["kind"], g["principal"]) for g in got] == [("onlyGov", "caller", "governance"), ("msg.sender == HUB", "caller", "hub"), ("isKeeper[_msgSender()]", "caller", "keeper")]


def test_statements_on_gates(spark):
    g = gates.code_gates(F.lit("function f(uint x) external onlyOwner {}"))
    none = gates.code_gates(F.lit("function f() external {}"))
    says = lambda text: one(spark, gates.undeclared(F.lit(text), g)) == []
    assert says("Only the owner may call this.") and says("Allows the owner to revoke it.") and says("Reverts unless the caller is the owner")
    assert not says("Sets the owner to the given address.") and not says("Returns the owner. This can only be called once.") and not says(None)
    assert one(spark, gates.invented(F.lit("Can only be called by the admin."), none)) == ["admin"]
    assert one(spark, gates.invented(F.lit("Sets the admin address."), none)) == [] and one(spark, gates.invented(F.lit("Only the owner."), g)) == []
    fields = F.create_map(F.lit("notice"), F.lit("Only the owner"), F.lit("param:x"), F.lit("callable by the owner"))
    assert one(spark, gates.misplaced(fields, g)) == ["param:x"] and one(spark, gates.misplaced(fields, none)) == []


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("disableFee", "Disables the fee", (True, False)), ("disableFee", "Enables the fee", (False, True)), ("setOwner", "Retrieves the owner", (False, True)), ("getDates", "Does not change state", (False, False)),
        ("_safeTransfer", "Sends the tokens", (True, False)), ("enableFee", "Turns the fee off", (False, False)), ("mintToken", "Burned at once", (False, True)), ("executeAll", "Will carry out all of them", (True, False)),
    ],
)
def test_verbs(spark, name, text, want):
    v = verbs.intent(F.lit(name))
    assert one(spark, F.struct(verbs.says(F.lit(text), v), verbs.inverts(F.lit(text), v))) == want


def test_intent(spark):
    for name, want in (("do_it", None), ("x", None), ("isOpen", "is"), ("tryInternalMint", "mint"), ("ab12", None), ("", None), ("weirdName", "weird")):
        assert one(spark, verbs.intent(F.lit(name))) == want, name
    assert one(spark, verbs.function_name(F.lit("function mintToken ( address a )"))) == "mintToken" and one(spark, verbs.function_name(F.lit("constructor()"))) is None


def test_chains(spark):
    data = [
        ("a", "A", "f()", "f/0", "B"), ("b", "B", "f()", "f/0", "C"), ("c", "C", "f(uint)", "f/0", None), ("d", "D", "g()", "g/0", "E"), ("e", "E", "g()", "g/0", "D"),
        ("h", "H", "k()", "k/0", "Nowhere"), ("i", None, "k()", "k/0", "L"), ("l1", "L", "k(a)", "k/0", None), ("l2", "L", "k(b)", "k/0", None), ("m", "", "z()", "z/0", None),
        *((f"n{i}", f"N{i}", "q()", "q/0", f"N{i + 1}") for i in range(10)),
    ]
    df = spark.createDataFrame(data, "id string, container string, signature string, arity_key string, inheritdoc string")
    got = {r["id"]: (r["target"], r["state"], r["hops"]) for r in inherit.chains(df).collect()}
    assert got["a"] == ("c", "resolved", 2) and got["b"] == ("c", "resolved", 1) and got["h"] == got["i"] == (None, "unresolved", 0)
    assert got["d"][1] == got["e"][1] == "cycle" and got["n0"][1] == "deep" and got["n5"][:2] == (None, "unresolved") and "c" not in got
    assert {r["id"] for r in inherit.broken(inherit.chains(df)).collect()} == {"d", "e", "n0", "n1"}
    assert inherit.chains(df.limit(0)).count() == 0


def test_fact_rows(spark):
    nodes = spark.createDataFrame(
        [([("N1", ["L.add"], ["require"], ["L.add", "x.pull"], ["require", "L.add", "_do"], ["call"]), ("N2", None, None, ["b", "a"], None, None)],)],
        "nodes array<struct<id:string,library:array<string>,builtin:array<string>,external:array<string>,internal:array<string>,low_level:array<string>>>",
    )
    got = [tuple(r) for r in nodes.select(facts.call_rows(F.col("nodes")).alias("c")).first()["c"]]
    assert got == [
        ("C1", "library", "L.add", "N1"), ("C2", "builtin", "require", "N1"), ("C3", "external", "x.pull", "N1"), ("C4", "internal", "_do", "N1"), ("C5", "low_level", "call", "N1"),
        ("C6", "external", "a", "N2"), ("C7", "external", "b", "N2"),
    ]


def _table(**other):
    row = {
        "file": "f", "contract": "C", "function": "g", "char_start": 5, "char_end": 50, "pair_id": "p", "facts": [("F1", "interaction_order", "x")],
        "nodes": [("N1", "ENTRY", 5, 6, []), ("N2", "EXPR", 7, 8, []), ("N3", "EXPR", 9, 10, ["s"])], "edges": [("N1", "N2", ""), ("N2", "N3", "true")],
        "paths": [("P1", ["N1", "N2", "N3"])], "calls": [("C1", "external", "x.y", "N2")], "deps": [("D1", "a", ["b"])], "reverts": [("R1", "require", "c", "", "N1")], "events": [("E1", "Ev", [], "N3")], "ast_types": [],
    }
    return tuple((row | other).values())


def test_fact_tables(spark):
    t = spark.createDataFrame([_table(), _table(function="h", paths=[], calls=[], char_start=6)], facts.SCHEMA)
    assert [r[0] for r in t.select(facts.interaction_order()).collect()] == ["writes state at N3 after an external call on path P1 — ".removesuffix(" — "), None]
    assert [r[0] for r in t.select(facts.cfg_view()).collect()] == ["ENTRY EXPR [true] EXPR | call:external revert:require", "ENTRY EXPR EXPR revert:require"]
    assert t.select(facts.row_ids().alias("x")).first()["x"] == ["F1", "N1", "N2", "N3", "P1", "C1", "D1", "R1", "E1"]
    assert facts.drop_families(t, "reverts").select("facts", "reverts").first() == ([], []) and len(facts.drop_families(t, "facts").first()["reverts"]) == 1
    with pytest.raises(ValueError):
        facts.drop_families(t, "nothing")
    assert facts.malformed(t).count() == 0 and facts.duplicate_tables(t).count() == 0
    bad = spark.createDataFrame([
        _table(edges=[("N1", "N9", "")], paths=[("P1", ["N1", "N1"]), ("P2", ["N8"])], calls=[("C1", "external", "dest:x", "N7")], deps=[("D1", "TMP_1", [])], reverts=[("F1", "require", "", "", None)], events=None),
        _table(pair_id="q"), _table(pair_id="zz", function="k", nodes=[("N1", "E", 99, 100, [])]),
    ], facts.SCHEMA)
    assert facts.malformed(bad).count() >= 7 and facts.duplicate_tables(bad).count() == 1
    pairs = spark.createDataFrame([("p", "f", 5), ("q", "f", 9)], "id string, file string, code_start int")
    assert sorted(r["key"] for r in facts.odd_pairs(bad, pairs).collect()) == ["q", "zz"]
    files = spark.createDataFrame([("f", "1234 function g() {} and more text in here to the end of the file")], "file string, src string")
    assert [r["detail"] for r in facts.odd_offsets(bad, files).collect()] == ["N1@99"]
    decls = spark.createDataFrame([("f", 5)], "file string, start int")
    assert facts.stray_tables(t, decls, files).count() == 1 and facts.stray_tables(t.where("char_start = 5"), decls, files).count() == 0
    assert [r["id"] for r in facts.join_pairs(t, pairs).orderBy("char_start").collect()] == ["p", None]


def test_paths(spark):
    for file, spec, want in (("a/b/C.sol", "./D.sol", "a/b/D.sol"), ("a/b/C.sol", "../../D.sol", "D.sol"), ("a/C.sol", "../../D.sol", "../D.sol"), ("C.sol", ".//x/../D.sol", "D.sol"), ("a/C.sol", "@lib/D.sol", None)):
        assert one(spark, units.relative_target(F.lit(file), F.lit(spec))) == want


def test_units(spark):
    files = spark.createDataFrame([("a", 'import "./b";\nimport {X} from "./c";'), ("b", 'import "./a"; import "@p/x";'), ("c", "none"), ("d", None)], "file string, src string")
    wanted = units.imports(files)
    resolver = units.resolve_relative(wanted, files).select("file", "spec", "target")
    got = {r["entry"]: r for r in units.closure(files.select(F.col("file").alias("entry")), files, resolver, wanted).collect()}
    assert got.keys() == set("abc") and got["a"]["files"] == got["b"]["files"] == list("abc") and got["c"]["files"] == ["c"]
    assert got["a"]["unresolved_specs"] == ["@p/x"] and not got["a"]["complete"] and got["c"]["complete"] and got["a"]["digest"] != got["b"]["digest"]
    assert units.closure(files.select(F.col("file").alias("entry")).limit(0), files, resolver, wanted).count() == 0


def test_vendor(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, src string")
    wanted = spark.createDataFrame([("a", "./b", 8), ("a", "@oz/x.sol", 8), ("a", "@oz/y.sol", 6), ("a", "a_b/f.sol", 8), ("a", "@no/z", 8)], "file string, spec string, minor int")
    trees = spark.createDataFrame([("@oz/", "v6", "t6/", 6, 1), ("@oz/", "v8", "t8/", 8, 2), ("@", "all", "t/", 8, 0), ("axb/", "odd", "o/", 8, 0)], "prefix string, tree string, root string, minor int, priority int")
    vendored = spark.createDataFrame([("t6/x.sol",), ("t8/x.sol",), ("t6/y.sol",), ("t/oz/x.sol",), ("o/f.sol",)], "file string")
    got = {r["spec"]: (r["target"], r["tree"]) for r in units.with_vendor(wanted, files, trees, vendored).collect()}
    assert got == {"./b": ("b", None), "@oz/x.sol": ("t8/x.sol", "v8"), "@oz/y.sol": ("t6/y.sol", "v6"), "a_b/f.sol": (None, None), "@no/z": (None, None)}


def test_declared_facts(spark):
    w = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    d = F.struct(F.lit("constructor").alias("kind"), F.lit(None).cast("string").alias("visibility"), F.lit("payable").alias("mutability"), w("uint256 x").alias("params"), w().alias("returns"))
    got = [tuple(r) for r in one(spark, facts.fact_rows(d, w("onlyOwner"), w("b", "a", "b"), F.lit(None).cast("array<string>")))]
    assert got == [("F1", "kind", "constructor"), ("F2", "visibility", "internal"), ("F3", "mutability", "payable"), ("F4", "parameter", "uint256 x"), ("F5", "modifier", "onlyOwner"), ("F6", "state_read", "a, b"), ("F7", "role", "constructor")]
    assert one(spark, facts.fact_rows(d, w(), w(), w()))[-1]["text"] == "touches no state"
