"""Comments written into files and taken out again."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import emission as em
from quarrymill.functions import solidity

SRC = """// SPDX
pragma solidity ^0.8.0;

abstract contract Vault is Base {
    string s = "/// @notice no comment";
    /// *************
    /// ****VIEW*****
    /// *************
    function a(uint256 x, address to) external returns (bool ok, uint) { x; }

    /** @notice Keeps what it has. */
    function b() public; // tail note
    // plain note
    function c(mapping(uint => uint) storage m) internal {}
    event Moved(uint256 amount);
\tfunction d() external {} /// @dev stands behind
}
"""
COMMENT = em.Comment(notice=["Moves x to the receiver."], params={"to": "who gets it", "x": "how much", "y": "nothing"}, returns=["whether", "rest left"], dev=["One.", "Two."])


def starts(src):
    return {p.signature: p.decl.start for p in em.places(src)}


def test_places():
    at = {p.signature: p for p in em.places(SRC)}
    assert list(at) == ["Vault", "a(uint256,address)", "b()", "c(mapping(uint=>uint))", "Moved(uint256)", "d()"]
    assert SRC[at["Vault"].decl.start :].startswith("abstract contract") and at["a(uint256,address)"].returns == ["ok", None]
    assert not em.documents(SRC, at["a(uint256,address)"].doc) and em.documents(SRC, at["b()"].doc)


def test_document():
    at = starts(SRC)
    out, n = em.document(SRC, {at["a(uint256,address)"]: COMMENT, at["b()"]: COMMENT, at["Moved(uint256)"]: em.Comment(), at["Vault"]: em.Comment(title="V")}, style="line")
    assert n == 2 and em.without_comments(out) == em.without_comments(SRC) and "*VIEW*" not in out and "Keeps what it has" in out
    block = out[out.index("    /// @notice Moves") : out.index("    function a(")]
    assert block == "    /// @notice Moves x to the receiver.\n    /// @dev One.\n    /// @dev Two.\n    /// @param x how much\n    /// @param to who gets it\n    /// @return ok whether\n    /// @return rest left\n"
    assert "/// @title V\nabstract contract" in out
    again, _ = em.document(out, {starts(out)["b()"]: em.Comment(notice=["New."])}, "replace", "block")
    assert "Keeps what it has" not in again and "    /**\n     * @notice New.\n     */\n    function b()" in again and "// tail note" in again
    for bad in ({1: COMMENT}, {}):
        with pytest.raises(ValueError):
            em.document(SRC, bad, "fill" if bad else "other")
    assert em.document(SRC, {})[0] == SRC


def test_documentation_out_and_in():
    bare = em.without_documentation(SRC)
    assert "Keeps" not in bare and "VIEW" not in bare and "// plain note" in bare and "// SPDX" in bare and "@dev stands behind" in bare
    assert em.without_comments(bare) == em.without_comments(SRC)
    assert em.style_of(SRC) == "line" and em.style_of("/**\n * x\n */\n/// y") == "block"


@given(st.lists(st.sampled_from(["function f() external {}\n", "/// text of it\n", "/** block */", " // note\n", '"str // no"', "\r\n", "  ", "contract C {\n", "}\n", "uint x; "]), max_size=14))
@settings(max_examples=200, deadline=None)
def test_code_stays(parts):
    src = "".join(parts)
    assert em.without_comments(em.without_documentation(src)) == em.without_comments(src)
    wanted = {p.decl.start: em.Comment(notice=["Says something new about it."]) for p in em.places(src)}
    for mode in ("fill", "replace"):
        assert em.without_comments(em.document(src, wanted, mode)[0]) == em.without_comments(src)


def test_attach_and_annotate():
    b = starts(SRC)["b()"]
    span = SRC.index("/** @notice Keeps")
    out = em.attach(SRC, [[span, SRC.index("*/", span) + 2]], b, "  /// @notice x\n\n /// @dev y")
    assert "    /// @notice x\n    /// @dev y\n    function b()" in out and "Keeps" not in out
    c = starts(SRC)["c(mapping(uint=>uint))"]
    out = em.annotate(SRC, {c: "One  text", b: "Other"})
    assert "plain note" not in out and "    /// @notice One text\n    function c(" in out and "    /// @notice Other\n    function b(" in out and em.without_comments(out) == em.without_comments(SRC)


@pytest.mark.parametrize(
    "text, want",
    [
        ("@notice Moves it\n@returns the rest\n@params x much", "/// @notice Moves it\n/// @param x much\n/// @return the rest"), ("// bare words", "/// @notice bare words"), ("", ""), (None, ""),
        ("/** lead\n * @notice more\n * @dev d\n   goes on */", "/// lead\n/// @notice more\n/// @dev d goes on"), ("@inheritdoc Base\n@notice gone\n@dev own", "/// @inheritdoc Base\n/// @dev own"), ("@custom:sec hot", "/// @custom:sec hot"),
    ],
)
def test_normalise(text, want):
    assert em.normalise(text) == want
    if want:
        assert em.normalise(want) == want and len(em.tag_names(want)) == want.count("@")


def test_strip_lines():
    text = "/// @notice Moves it.\n/// @dev Only the owner may call\n/// @param x much"
    assert em.strip_lines(text, ["only the OWNER may", ""]) == "/// @notice Moves it.\n/// @param x much"
    assert em.strip_lines("/// a", ["a"]) == "/// a" and em.strip_lines(text, []) == text


def test_emitted(spark):
    rec = "array<struct<container:string,signature:string,fields:map<string,string>>>"
    rows = [(1, SRC, [("Vault", "a(uint256,address)", {"notice": "N", "param:to": "t", "return:10": "r", "return:2": "q"}), ("Vault", "gone()", {"notice": "x"})]), (2, None, None), (3, SRC, None)]
    df = spark.createDataFrame(rows, f"k int, src string, r {rec}").select("k", em.emitted(F.col("src"), F.col("r")).alias("e")).orderBy("k")
    a, b, c = (r["e"] for r in df.collect())
    assert a["placed"] == 1 and a["skipped"] == ["gone()"] and a["code_unchanged"] and "@param to t\n" in a["emitted"] and "@return ok q\n" in a["emitted"]
    assert b["emitted"] is None and b["placed"] == 0 and c["placed"] == 0 and "Keeps" not in c["emitted"]


def test_accepted(spark):
    df = spark.createDataFrame([(True, True, ["a"], ["b"]), (True, True, None, ["b"]), (None, True, ["a"], []), (True, False, ["a"], [])], "c boolean, t boolean, b array<string>, a array<string>")
    assert [r[0] for r in df.select(em.accepted(F.col("c"), F.col("t"), F.col("b"), F.col("a"))).collect()] == [True, False, False, False]
    pick = em.inheritdoc_target(F.lit(True), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B")))
    assert spark.range(1).select(pick.alias("x"), em.inheritdoc_target(F.lit(False), F.array().cast("array<string>"), F.array(F.lit("B"))).alias("y")).first() == ("B", None)


@pytest.mark.parametrize(
    "raw, kind, name",
    [("uint256", "uint256", None), ("uint256 x", "uint256", "x"), ("string memory", "string memory", None), ("mapping(a => b) storage self", "mapping(a => b) storage", "self"), ("mapping(a => b)", "mapping(a => b)", None),
     ("function (uint) external returns (uint) cb", "function (uint) external returns (uint)", "cb"), ("Tick.Info", "Tick.Info", None), ("address payable", "address payable", None), ("uint[] calldata xs", "uint[] calldata", "xs")],
)
def test_parameter(raw, kind, name):
    assert solidity.parameter(raw) == (kind, name)


def test_guards_and_offsets():
    code = 'function f() { require(a[1] > g(2, 3), "no, (never)"); /* assert(x); */ revert(); if (x) revert Bad(y, z); assert(ok); string s = "require(q)"; }'
    assert solidity.guards_of(code) == [("require", "a[1] > g(2, 3)", "no, (never)"), ("revert", "revert()", ""), ("revert", "y", "z"), ("assert", "ok", "")]
    assert solidity.guards_of(None) == [] and solidity.split_top("a, (b, c), {d: [e, f]}, ") == ["a", "(b, c)", "{d: [e, f]}"]
    text = "aé中🧪z"
    o = solidity.Offsets(text)
    assert [o.to_byte(i) for i in range(7)] == [0, 1, 3, 6, 10, 11, 11] and [o.to_char(b) for b in (0, 1, 2, 3, 5, 10, 99)] == [0, 1, 1, 2, 2, 4, 5]
    assert solidity.Offsets("ascii").to_char(3) == 3


def test_verify():
    src = "contract C { /// @notice Does it all\n function f() public {} function g() external; event E(uint a); }"
    assert em.verify(src, src) == {"code_unchanged": True, "exposed": 3, "documented": 1, "completeness": 1 / 3}
    assert em.verify(src, src.replace("g()", "h()"))["code_unchanged"] is False and em.verify("", "")["completeness"] is None
