"""The operators for training data against brute force, round trips and awkward rows."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import doc_pairs, encode, grouped_split, leakage, lookalike, near_dups, queries, reply_defects, split_overlap, wordsets
from quarrymill.session import cut

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[a-z0-9_]+")


def words(*parts):
    return frozenset(WORD.findall(" ".join(p or "" for p in parts).lower()))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


# 1 -----------------------------------------------------------------------------------------------------

SOURCE = '''// SPDX
/// @notice Adds two numbers for the caller
function sum(uint a, uint b) pure returns (uint) { return a + b; }
contract C is D {
    string s = "/// @notice Not a comment at all\\nfunction fake() external {}";
    function(uint) external returns (bool) internal hook;
    /** @dev TODO: document this function */
    function later() external;
    /** @notice Moves the whole balance to the vault */
    // plain note
    /* another */
    function move() external { assembly { function inner(x) -> y { y := x } } }
    /** @notice Belongs to the variable that follows it */
    uint public total;
    function bare() external {}
    /// Sum of things
    function sumOfThings() external {}
    /// @param a only a parameter
    function tagged(uint a) external {}
    /// first line of a long run

    // interruption
    /// and its second line
    constructor() {}
    /** @notice Accepts plain transfers of value */ receive() external payable {}
    /// @notice Old style fallback that accepts value
    function () payable { total += 1; }
    // /// @notice commented out together with its code
    // function gone() external {}
}
'''


def test_pairs_of_source():
    got = {t[4]: t for t in doc_pairs.pairs_of("f", "p", SOURCE)}
    assert set(got) == {"sum", "move", "constructor", "receive", "fallback"}
    for t in got.values():
        assert SOURCE[t[5] : t[6]] == t[13]
    assert got["constructor"][11] == "first line of a long run and its second line"
    assert got["move"][2] == "C" and got["sum"][2] is None


def test_pairs_awkward(spark):
    df = spark.createDataFrame(
        [("a", "p", SOURCE, 1), ("a", "p", SOURCE, 2), (None, None, SOURCE, 3), ("b", "p", None, 4), ("c", "p", "  ", 5), ("d", "p", "/** open", 6), ("e", "p", "function f( {{{ \"", 7)],
        "file string, project string, src string, kind int",
    )
    assert len(rows(doc_pairs.found(df))) == 10
    assert rows(doc_pairs.found(df.limit(0))) == []
    crlf = SOURCE.replace("\n", "\r\n")
    assert len(list(doc_pairs.pairs_of("f", "p", crlf))) == 5


def test_pairs_of_latest_fetch(spark):
    new = SOURCE.replace("Adds two numbers", "Sums two numbers").replace("function sum(", "function addition(")
    at = [datetime(2031, 1, k) for k in (1, 2, 3)]
    df = spark.createDataFrame(
        [("a", "p", SOURCE, at[0]), ("a", "p", "// note\n" + new, at[1]), ("a", "p", "// note\n" + new, at[1]), ("a", "p", " ", at[2]), ("b", "p", SOURCE, None), (None, "p", SOURCE, None)],
        "file string, project string, src string, fetched_at timestamp",
    )
    got = doc_pairs.pairs_once(df).collect()
    names = lambda f: sorted(r["name"] for r in got if r["file"] == f)
    assert names("a") == ["addition", "constructor", "fallback", "move", "receive"]
    assert names("b") == names(None) == ["constructor", "fallback", "move", "receive", "sum"]


# 2 -----------------------------------------------------------------------------------------------------

PROMPT = "Document the function below as NatSpec.\n\nfunction moveAll(address to) external returns (bool) { total[to] += balance; emit Moved(to, balance); return true; }"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"natspec": "@notice Moves everything to `to`", "claims": []}', None),
        ('Here is the comment:\n\n```json\n{"natspec": "@notice Moves the whole balance to the receiver."}\n```', None),
        ("/** @dev Sorry looking arithmetic: the total is scaled twice. */", None),
        (None, "empty"), ("", "empty"), ("​", "empty"), ('{"natspec": "@notice "}', "empty"), ("```json\n```", "empty"), ("(no output)", "empty"), ("/** */", "empty"),
        ('{"natspec": "@notice Moves the whole bal', "truncated"), ('{"natspec": "@notice Moves the whole balance of the"}', "truncated"), ('{"natspec": "@notice Moves `tota"}', "truncated"), ("Caps `total at the `chan", "truncated"),
        ("I'm sorry, but I can't describe `moveAll` without the contract.", "refusal"), ('{"natspec": "I cannot comply with this instruction."}', "refusal"),
        ("Request declined: the vault needs more context than I was given.", "refusal"), ("function moveAll(address to) external returns (bool)", "copied"), (PROMPT.upper(), "copied"), ("Document the function below as NatSpec.", "copied"),
        ('{"natspec": "@notice La función devuelve la cantidad que puede retirarse cuando el contrato no está vacío."}', "language"),
    ],
)
def test_reply(raw, want):
    assert reply_defects.defect(raw, reply_defects.instruction_language(PROMPT), PROMPT)[0] == want


def test_instruction_language():
    for text, want in (("Décris cette fonction en français.", "fr"), ("请用中文说明这个函数。", "zh"), ("Опиши эту функцию на русском языке.", "ru"), ("Improve this comment.", "en")):
        assert reply_defects.instruction_language(text + "\n\nfunction f() external {}") == want


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_automaton(seq, items, run):
    runs = {tuple(seq[i : i + run]) for i in range(len(seq) - run + 1)}
    hit = {k for i in range(len(items) - run + 1) if tuple(items[i : i + run]) in runs for k in range(i, i + run)}
    assert reply_defects.SuffixAutomaton(seq).covered(items, run) == len(hit)


def test_replies_awkward(spark):
    calls = spark.createDataFrame([(1, PROMPT, None), (1, PROMPT, None), (2, None, "Moves it to settlem"), (3, PROMPT, "Adds the value."), (None, PROMPT, "")], "call_id long, prompt string, raw string")
    runs = spark.createDataFrame([(1, "x", "", None), (2, "x", "", "boom"), (3, None, "none", None), (4, "p", "function f() external", None)], "run_id long, pair_id string, final string, error string")
    at = datetime(2031, 1, 1)
    pairs = spark.createDataFrame([("p", at, "f()", "function f() external {}", 0)], "id string, written_at timestamp, signature string, code string, raw int")
    got = rows(reply_defects.found(calls, runs, pairs))
    assert got == [("model_calls", 1, "empty"), ("model_calls", 2, "truncated"), ("run_records", 1, "empty"), ("run_records", 3, "empty"), ("run_records", 4, "copied")]
    assert rows(reply_defects.found(calls.limit(0), runs.limit(0), pairs.limit(0))) == []


# written after the phrases and the rule, and not used for them
UNSEEN_REFUSALS = """I do not think it is right for me to describe this.
Writing this comment is off limits for me.
I was told to leave such functions alone, so no comment from me.
Nope, I am staying out of this one.
I'd have to see the rest before I said anything, so no.
It would be wrong of me to guess, I must leave it blank.
Let us talk about something else instead.
I never comment on token code.
I haven't got the permission to answer that.
Not going to happen.
My answer is no.
I regret that I can offer no description.
Ich möchte dazu keine Angaben machen.
Je préfère ne pas décrire cette fonction.
Prefiero no describir esta función.
Prefiro não descrever esta função.
Я предпочёл бы не описывать это.
我拒绝描述这个函数。""".splitlines()
NO_REFUSALS = """Reverts if the caller cannot pay the fee.
Declines the marginal sentinel when the ledger cannot prove the reserve.
Refuses the weekly sponsor if the shard is closed.
Unable to recover once the value is zero.
Sorry looking arithmetic: the total is scaled twice.
The owner can't withdraw before the season ends.
No answer is given by the oracle while it is paused.
Callers should not rely on the returned value.
Cannot be called by contracts.
This function is not able to move more than the cap.
As an operator, the caller may pause the vault.
Outside of the window the request is denied.
We cannot overflow here because the total is capped.
I is the index of the slot.
Rejects the request when the signer is unknown.
The keeper is unable to drain the pool twice.
Must not be called while the auction is open.
Beyond the cap the rest is refunded.
It's not possible to revoke a matured claim.
No permission is needed to read the slot.
Will not emit an event if the amount is zero.
The assistant role may pause, the owner may not.""".splitlines()


def test_refusals_in_unseen_words():
    assert sum(map(reply_defects.refuses, UNSEEN_REFUSALS)) >= 0.5 * len(UNSEEN_REFUSALS)  # 9 of 18 when written
    assert not any(map(reply_defects.refuses, NO_REFUSALS))


@given(st.text("ab-_`@ .1Zé", max_size=12))
@settings(max_examples=300, deadline=None)
def test_last_word(text):
    m = re.search(r"(?<![\w`@])([a-z]+)(-?)\W*$", text)
    assert reply_defects.last_word(text) == ((m.group(1), bool(m.group(2))) if m else (None, False))


def test_replies_of_larger_tables(spark):
    """A reply's verdict does not hang on how often its table holds the same texts, nor on one stray use of a fragment."""
    texts = ["Settles the claim at the current margin", "Adds a margin to the pool. Keeps the rest.", "Moves it to settlem", "Reads the margin of a claim, then the pool.", "Empties the pool for good"]
    empty = spark.createDataFrame([], "run_id long, pair_id string, final string, error string, id string, written_at timestamp, signature string, code string")

    def verdicts(texts, times):
        data = [(k * 100 + i, PROMPT, t) for k in range(times) for i, t in enumerate(texts)]
        calls = spark.createDataFrame(data, "call_id long, prompt string, raw string")
        return {(i % 100, what) for _, i, what in rows(reply_defects.found(calls, empty, empty))}

    want = verdicts(texts, 1)
    assert (2, "truncated") in want and not {i for i, _ in want} & {0, 1, 3}
    assert all(verdicts(texts, k) == want for k in (2, 30))
    assert (2, "truncated") in verdicts([*texts, "The word settlem, once."], 1)


@pytest.mark.parametrize(
    "text, want",
    [("Эта функция переводит остаток", "ru"), ("この関数は残高を移します", "ja"), ("이 함수는 잔액을 옮깁니다", "ko"), ("这个函数转移余额", "zh"), ("Αυτή η συνάρτηση μεταφέρει το υπόλοιπο", "el"), ("هذه الدالة تنقل الرصيد", "ar"), ("This moves the balance to the owner", "en"), ("balance", None)],
)
def test_language(text, want):
    assert reply_defects.language(text) == want


# 3 -----------------------------------------------------------------------------------------------------


def _units(spark, n=400, seed=1):
    rng = random.Random(seed)
    at = datetime(2031, 1, 1)
    data = []
    for i in range(n):
        p = f"p{min(rng.randrange(60), rng.randrange(60))}"
        data.append((f"u{i}", p, f"g{rng.randrange(n * 3)}", "x" * rng.randrange(1, 300), rng.choice([None, "text"]), {"code": "c"}, at))
    return spark.createDataFrame(data, "pair_id string, project string, group_id string, code string, natspec string, views map<string,string>, indexed_at timestamp")


def _components(units):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u in units:
        parent[top("p" + u["project"])] = top("g" + u["group_id"])
    return {u["project"]: top("p" + u["project"]) for u in units}


def test_assign(spark):
    units = _units(spark)
    both = units.unionByName(units.limit(50))
    got = grouped_split.assign(both).collect()
    assert len(got) == 400
    comp = _components(units.collect())
    seen = defaultdict(set)
    for r in got:
        seen[comp[r["project"]]].add(r["split"])
    assert all(len(s) == 1 for s in seen.values())
    share = Counter(r["split"] for r in got)
    biggest = max(Counter(comp[r["project"]] for r in got).values())
    for s, p in zip(("train", "val", "test"), (0.8, 0.1, 0.1)):
        assert abs(share[s] - 400 * p) <= max(8, biggest - 400 * 0.8)
    assert grouped_split.assign(units.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_assign_shares(spark, sf):
    got = grouped_split.assign(spark.read.parquet(f"/root/testdata/{sf}/retrieval_units.parquet")).cache()
    share = {r["split"]: r["share"] for r in grouped_split.balance(got).where("label = 'all'").collect()}
    assert all(abs(share[s] - p) <= 0.02 for s, p in (("train", 0.8), ("val", 0.1), ("test", 0.1)))
    assert got.groupBy("component").agg({"split": "count"}).count() == got.select("component", "split").distinct().count()
    labels = grouped_split.balance(got).where("split = 'train'").collect()
    assert all(abs(r["share"] - 0.8) <= max(0.05, 20 / r["units"]) for r in labels if r["units"] > 10)


@pytest.mark.parametrize("rows", [50_000, 40])
def test_assign_small_components(spark, monkeypatch, rows):
    monkeypatch.setattr(grouped_split, "CELL_ROWS", rows)  # the small one splits every cell
    at = datetime(2031, 1, 1)
    data = [(f"u{i}", f"p{i // 2}", None, "x" * (1 + i % 50), "t", None, at) for i in range(3000)]
    units = spark.createDataFrame(data, "pair_id string, project string, group_id string, code string, natspec string, views map<string,string>, indexed_at timestamp")
    share = Counter(r["split"] for r in grouped_split.assign(units).collect())
    assert abs(share["train"] - 2400) <= 4 and abs(share["val"] - 300) <= 4 and sum(share.values()) == 3000


def test_assign_own_labels(spark):
    at = datetime(2031, 1, 1)
    data = [(f"u{i}", f"p{i // 4}", None, "rare" if i < 80 else None, at) for i in range(800)]
    units = spark.createDataFrame(data, "pair_id string, project string, group_id string, mark string, indexed_at timestamp")
    got = grouped_split.assign(units, (0.5, 0.25, 0.25), F.array("mark", F.lit("any"), F.lit("any")))
    units = {(r["split"], r["label"]): r["units"] for r in grouped_split.balance(got).collect()}
    assert units == {(s, x): n * k for s, k in (("train", 2), ("val", 1), ("test", 1)) for x, n in (("all", 200), ("any", 200), ("rare", 20))}
    with pytest.raises(ValueError):
        grouped_split.assign(got.withColumn("group_id", F.lit(None).cast("string")).withColumn("indexed_at", F.lit(at)), labels=F.array("pair_id"))


def test_assign_without_project(spark):
    at = datetime(2031, 1, 1)
    data = [("a", "p", "g"), ("b", None, "g"), ("c", None, "h"), ("d", None, "h"), ("e", None, None), ("f", "q", None)]
    units = spark.createDataFrame([(*r, "x", "t", None, at) for r in data], "pair_id string, project string, group_id string, code string, natspec string, views map<string,string>, indexed_at timestamp")
    got = {r["pair_id"]: r for r in grouped_split.assign(units).collect()}
    assert got.keys() == set("abcdef") and got["b"]["project"] is None
    comp = {k: r["component"] for k, r in got.items()}
    assert comp["a"] == comp["b"] and comp["c"] == comp["d"] and len(set(comp.values())) == 4
    assert all(r["split"] in ("train", "val", "test") for r in got.values()) and got["a"]["split"] == got["b"]["split"] and got["c"]["split"] == got["d"]["split"]


def test_mixed_projects(spark):
    units = _units(spark, 300, 5)
    rng = random.Random(2)
    pairs = [(f"u{i}", rng.choice(["train"] * 30 + [" Test ", None, "excluded", "VAL"]), datetime(2031, 1, 1 + k)) for i in range(300) for k in range(2)]
    df = spark.createDataFrame(pairs, "id string, split string, written_at timestamp")
    valid = {i: (s or "").strip().lower() for i, s, _ in pairs}
    us = units.collect()
    comp, has = _components(us), defaultdict(set)
    for u in us:
        if valid[u["pair_id"]] in ("train", "val", "test"):
            has[comp[u["project"]]].add(valid[u["pair_id"]])
    assert rows(grouped_split.found(units, df)) == sorted((p,) for p in comp if len(has[comp[p]]) > 1)


def test_mixed_by_units_without_project(spark):
    at = datetime(2031, 1, 1)
    units = spark.createDataFrame([("a", "p", "g"), ("b", None, "g"), ("c", "q", "h"), ("d", None, "z"), ("e", None, None), (None, "q", "h")], "pair_id string, project string, group_id string")
    pairs = spark.createDataFrame([("a", "train", at), ("b", "Test ", at), ("c", "val", at), ("d", "train", at), ("e", "test", at), (None, "test", at)], "id string, split string, written_at timestamp")
    assert rows(grouped_split.found(units, pairs)) == [("p",)]
    assert rows(grouped_split.found(units.limit(0), pairs)) == [] == rows(grouped_split.found(units, pairs.limit(0)))


# 4 and 5 -----------------------------------------------------------------------------------------------


def _texts(rng, n, size):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            t = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rng.shuffle(t)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=size)))
    return out


def test_near_duplicates(spark):
    rng = random.Random(4)
    t = _texts(rng, 300, 30)
    data = [(f"u{i:03}", x[:60], x[60:] or None, "z") for i, x in enumerate(t)] + [("u001", t[1][:60], t[1][60:], "y"), ("e1", "", None, "q"), ("e2", None, "", "q"), (None, "w1", "w2", "q")]
    df = spark.createDataFrame(data, "pair_id string, code string, natspec string, words string")
    sets = {i: words(c, n) for i, c, n, _ in data if i}
    ids = sorted(sets)
    want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and like(sets[a], sets[b]) >= 0.75]
    assert rows(near_dups.found(df)) == want and len(want) > 30
    assert rows(near_dups.found(df.limit(0))) == []
    g = {r["pair_id"]: r["group"] for r in near_dups.groups(df).collect()}
    assert all(g[a] == g[b] for a, b in want) and len(g) == 300


def test_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 80)
    b = np.concatenate((a[:60], rng.integers(0, 1 << 60, 20)))
    keys = near_dups.signatures(np.concatenate((a, b)), np.array([0, 80, 160]), bands=2000, rows=1)
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.08


def test_split_overlap(spark):
    rng = random.Random(9)
    t = _texts(rng, 300, 24)
    splits = ["train", "TRAIN ", "val", " Test", None, "excluded"]
    at = datetime(2031, 1, 1)
    data = [(f"i{i:03}", at, rng.choice(splits), "p", x[:40], x[40:]) for i, x in enumerate(t)]
    data += [(i, datetime(2030, 1, 1), "train", "p", n, d) for i, _, _, _, n, d in data[:40]] + [("n1", at, "train", "p", None, None), ("n2", at, "val", "p", "", "..."), (None, at, "val", "p", "w1", "w2")]
    df = spark.createDataFrame(data, "id string, written_at timestamp, split string, project string, notice string, dev string")
    best = {}
    for i, a, s, _, n, d in data:
        if i and (i not in best or a > best[i][0]):
            best[i] = (a, (s or "").strip().lower(), words(n, d))
    ev = [i for i in best if best[i][1] in ("val", "test") and best[i][2]]
    tr = [i for i in best if best[i][1] == "train" and best[i][2]]
    want = sorted({(min(a, b), max(a, b)) for a in ev for b in tr if like(best[a][2], best[b][2]) >= 0.75})
    assert rows(split_overlap.found(df)) == want and len(want) > 20
    assert rows(split_overlap.found(df.limit(0))) == []
    assert split_overlap.report(df).agg({"overlaps": "sum"}).first()[0] == len(want)


def test_hot_keys_are_split(spark, monkeypatch):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(20)]
    data = [(f"u{i:02}", " ".join(common + rng.sample([f"r{k}" for k in range(40)], rng.randrange(6))), None) for i in range(60)]
    df = spark.createDataFrame(data, "pair_id string, code string, natspec string").repartition(3)
    sets = {i: words(c) for i, c, _ in data}
    want = [(a, b) for a in sorted(sets) for b in sorted(sets) if a < b and like(sets[a], sets[b]) >= 0.75]
    _, classes = near_dups.classed(df)
    named = {r["class"]: r["set"] for r in classes.select("class", F.array_sort("words").alias("set")).collect()}
    pairs = lambda rows_: sorted((r["a"], r["b"]) for r in near_dups.similar_classes(classes, key_rows=rows_).collect())
    assert pairs(3) == pairs(4096) and len(pairs(3)) > 100 and len(named) > 40
    for module in (near_dups, split_overlap):
        monkeypatch.setattr(module, "KEY_ROWS", 3)
    monkeypatch.setattr("quarrymill.llm.wordsets.meet.__defaults__", (3,))
    assert rows(near_dups.found(df)) == want
    left, right = (spark.createDataFrame([(k, i) for k in range(4) for i in range(n * (k == 0) + 2)], f"k int, {x} int") for n, x in ((30, "a"), (50, "b")))
    assert rows(wordsets.meet(left, right, "k", "b")) == rows(left.join(right, "k"))


def test_units_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = spark.createDataFrame([("u", one, None), ("u", two, None), ("u", two, None), ("v", one + " x", ""), ("w", two, None), ("t", "alone here", None)], "pair_id string, code string, natspec string")
    assert rows(near_dups.groups(df)) == [("t", "t", "t", 0), ("u", "u", "u", 1), ("v", "v", "u", 1), ("w", "u", "u", 0)]


def test_hot_words_are_split(spark):
    rng = random.Random(12)
    sets = [(i, sorted(rng.sample(range(30), 12))) for i in range(80)]
    df = spark.createDataFrame(sets, "class long, words array<long>")
    ev, train = df.where("class < 30"), df.where("class >= 30")
    want = [(a, b) for a, x in sets[:30] for b, y in sets[30:] if like(set(x), set(y)) >= 0.5]
    for key_rows in (2, 4096):
        assert rows(split_overlap.similar(ev, train, 0.5, key_rows).select("e", "t")) == want and len(want) > 20


def test_groups_do_not_hang_on_partitions(spark):
    units = spark.read.parquet("/root/testdata/sf0.01/retrieval_units.parquet")
    want = rows(near_dups.groups(units))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(near_dups.groups(units.repartition(5))) == want and len({r[0] for r in want}) == len(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall_at_the_threshold(spark):
    """Pairs with a likeness just above the threshold, by brute force: none may be missing."""
    rng = random.Random(11)
    data, want = [], []
    for i in range(600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(56)]
        edit = base[: 56 - 8] + [f"x{rng.randrange(10**6)}" for _ in range(8)]  # 48 of 64 words in common
        data += [(f"a{i:03}", " ".join(base), None), (f"b{i:03}", " ".join(edit), None)]
        if like(words(*data[-1][1:]), words(*data[-2][1:])) >= 0.75:
            want.append((f"a{i:03}", f"b{i:03}"))
    got = rows(near_dups.found(spark.createDataFrame(data, "pair_id string, code string, natspec string")))
    assert len(want) > 550 and set(got) >= set(want)


def test_rows_are_not_broadcast(spark):
    """Spark guesses exploded rows far too small; what it broadcasts goes through the driver."""
    units = spark.read.parquet("/root/testdata/sf0.01/retrieval_units.parquet")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    df = near_dups.found(units)
    assert df.count() > 50 and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    sides = (cut(spark.range(1000).select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k"), F.col("id").alias(x))) for x in "ab")
    assert "Broadcast" not in wordsets.meet(*sides, "k", "b", 10**6)._jdf.queryExecution().executedPlan().toString()


def test_common_words_propose_no_pairs(spark):
    """All texts share 20 words, which is a likeness of 1/3: only what is alike may reach the verification."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(20)]
    data = [(f"u{i:04}", " ".join(common + [f"r{rng.randrange(10**6)}" for _ in range(20)]), None) for i in range(2000)]
    data += [(f"v{i:04}", data[i][1] + f" x{i}", None) for i in range(50)]
    _, classes = near_dups.classed(spark.createDataFrame(data, "pair_id string, code string, natspec string"))
    with pytest.MonkeyPatch.context() as m:
        proposed = []
        m.setattr(near_dups, "with_sets", lambda pairs, *x: proposed.append(pairs.count()) or wordsets.with_sets(pairs, *x))
        assert near_dups.similar_classes(classes).count() == 50
    assert proposed[0] <= 55


@given(st.lists(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=90), min_size=2, max_size=2))
@settings(max_examples=100, deadline=None)
def test_folded_sets_differ_by_no_more_than_sets(sets):
    fold = near_dups.fold(pa.array([*sets, None], pa.list_(pa.int64()))).to_pylist()
    assert ((fold[0] ^ fold[1]) & ((1 << 64) - 1)).bit_count() <= len(set(sets[0]) ^ set(sets[1])) and fold[2] == 0


def test_pairs_at_every_threshold(spark):
    rng = random.Random(13)
    sets = [sorted({f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(1, 12))}) for _ in range(150)]
    sets += [sorted({*rng.choice(sets), *rng.sample([f"w{i}" for i in range(400)], rng.randrange(3))}) for _ in range(150)]
    data = [(f"u{i:03}", " ".join(x), None) for i, x in enumerate(sets)]
    df = spark.createDataFrame(data, "pair_id string, code string, natspec string")
    for threshold in (0.5, 0.75, 0.9, 1.0):
        want = [(a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if like(words(a[1]), words(b[1])) >= threshold]
        assert rows(near_dups.found(df, threshold)) == want and want


# 6 -----------------------------------------------------------------------------------------------------

ALPHABET = " \n\t\r 　\x1c\x85ab1.,'sé́中🧪!\"<|endoftext|>"


@given(st.lists(st.text(ALPHABET, max_size=300), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_agrees(texts):
    bare = encode.encoder(encode.VOCABULARY)
    assert encode.ChunkEncoder().encode_array(pa.array(texts, pa.string())).to_pylist() == [bare.encode_ordinary(t) for t in texts]


def test_encoding_real(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bare = encode.encoder(encode.VOCABULARY)
    long = " ".join(r["text"] or "" for r in docs.collect())
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, long), (-4, "a" * 4000), (-5, " " * 3000)], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = encode.encode(docs).collect()
    assert len(got) == len(text)
    assert all(r["ids"] == bare.encode_ordinary(text[r["doc_id"]] or "") for r in got)


# 7 -----------------------------------------------------------------------------------------------------


def test_leaks(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    extra = [(-1, None), (-2, ""), (-3, "word " * 5000)]
    its = items.collect()
    w = lambda s: re.findall(r"[^\W_]+", lookalike.fold_array(pa.array([s])).to_pylist()[0].lower())
    a, b = w(its[0]["text"]), w(its[1]["text"])
    extra += [(-4, "> " + "\n> ".join(a[2:16])), (-5, " ".join(a[2:15])), (-6, " ".join([*a[:7], *b[:7]])), (-7, "*".join(b).upper())]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    grams = defaultdict(set)
    for r in its:
        t = w(r["text"])
        for k in range(len(t) - 13):
            grams[tuple(t[k : k + 14])].add(r["item_id"])
    want = set()
    for r in docs.collect():
        t = w(r["text"] or "")
        want |= {(r["doc_id"], i) for k in range(len(t) - 13) for i in grams.get(tuple(t[k : k + 14]), ())}
    assert rows(leakage.found(docs, items)) == sorted(want)
    assert {d for d, _ in want} >= {-4, -7} and not {d for d, _ in want} & {-5, -6}
    one_by_one = leakage.leaks(docs, items, item_block=200).where("exact").select("doc_id", "item_id")
    assert rows(one_by_one.distinct()) == sorted(want)
    assert rows(leakage.found(docs.limit(0), items)) == [] and rows(leakage.found(docs, items.limit(0))) == []


@given(st.integers(1, 20), st.integers(0, 60))
@settings(max_examples=40, deadline=None)
def test_simhash_sums(window, n):
    w = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    want = []
    for i in range(n - window + 1):
        bits = [sum(int(x) >> k & 1 for x in w[i : i + window]) for k in range(64)]
        want.append(sum((b > window // 2) << k for k, b in enumerate(bits)))
    assert leakage.simhash(w, window).tolist() == want


def test_all_within_radius_found():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    index = leakage.ItemIndex(np.arange(1), w, np.ones(400, np.int32), np.array([0, 400]), 14, 3)
    probes = index.print.copy()
    for i in range(len(probes)):
        for k in rng.choice(64, rng.integers(0, 6), replace=False):
            probes[i] ^= np.uint64(1 << int(k))
    a, b = index.near(probes)
    want = {(i, j) for i, x in enumerate(probes.tolist()) for j, y in enumerate(index.print.tolist()) if (x ^ y).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_near_leaks_brute(spark):
    rng = random.Random(8)
    vocab = ["ab", "token", "balance", "owner", "a", "transferred", "the", "of"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(30)) for i in range(6)] + [(6, ["a"] * 20), (7, text(10))]
    docs = []
    for d in range(40):
        t = list(items[d % 6][1][:20])
        for k in rng.sample(range(20), d % 3):
            t[k] = "edited"
        docs.append((d, text(5) + t + text(5)))
    docs += [(91, ["a"] * 15)]
    docs += [(100 + 2 * k + e, (["x"] if e else []) + items[k % 6][1][k // 6 : k // 6 + 13] + ([] if e else ["x"])) for k in range(60) for e in (0, 1)]

    def like(x, y):
        gx, gy = ([tuple(v[i : i + 5]) for i in range(10)] for v in (x, y))
        size = lambda g: sum(map(len, g))
        return sum(size(g) for g in gx if g in gy) / (sum(map(size, gx)) + sum(size(g) for g in gy if g not in gx))

    want = {}
    for d, x in docs:
        for i, y in items:
            got = [v for p in range(len(x) - 13) for q in range(len(y) - 13) if (v := like(x[p : p + 14], y[q : q + 14])) >= 0.8]
            if got:
                want[d, i] = (round(max(got), 6), len(got))
    df = lambda data, name: spark.createDataFrame([(k, " ".join(t)) for k, t in data], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["likeness"], 6), r["windows"]) for r in leakage.leaks(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert got == want and sum(v < 1 for v, _ in want.values()) > 3


# 8 -----------------------------------------------------------------------------------------------------


def plain_fold(s):
    out = []
    for ch in s:
        out.append(lookalike.Tables._expand(ch) if not 0xAC00 <= ord(ch) <= 0xD7A3 else ch)
    t = unicodedata.normalize("NFC", "".join(out).replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(" \n", "\n", re.sub(" +", " ", t)).strip(" \n")


@given(st.lists(st.text("ab é ȩ́̈​­ 　\t\r\nﬁﬃｆＡа欧한ᄒ한ёй中🧪1", max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_fold_like_plain(texts):
    assert lookalike.fold_array(pa.array(texts, pa.string())).to_pylist() == [plain_fold(t) for t in texts]


@pytest.mark.parametrize(
    "odd, latin",
    [("𝐚𝑏𝒞𝔡𝕖𝗳𝚐𝟎ℂℍ", "abCdefg0CH"), ("ｆｕｌｌ", "full"), ("ρɡοѵ", "pgov"), ("օո", "on"), ("ᎪᎷᏟ", "AMC"), ("foo \nbar", "foo\nbar"), ("foo\u00a0\r\nbar", "foo\nbar"), ("Ⅷ", "VIII"), ("no‑break", "no-break")],
)
def test_same_look(odd, latin):
    assert lookalike.fold_array(pa.array([odd, latin])).to_pylist() == [latin, latin]


@pytest.mark.parametrize("a, b", [("ı", "i"), ("e", "é"), ("a", "A"), ("κ", "k"), ("l", "1"), ("a\nb", "a b")])
def test_other_look(a, b):
    got = lookalike.fold_array(pa.array([a, b])).to_pylist()
    assert got[0] != got[1]


def test_lookalikes(spark):
    data = [(1, "file one"), (2, "ﬁle one"), (3, "ﬁle one"), (4, "filе one​"), (5, "File one"), (6, "filé one"), (7, "filé one"), (8, None), (9, ""), (10, "​"), (11, " "), (12, "x")]
    docs = spark.createDataFrame([(i, t, t) for i, t in data], "doc_id long, text string, look string")
    want = [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]
    got = rows(lookalike.found(docs))
    assert got == sorted(want) or got == sorted([*want, (6, 7)])
    assert rows(lookalike.found(docs.limit(0))) == []


def test_lookalike_pairs_of_real_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by = defaultdict(list)
    for r in docs.collect():
        if r["text"] and plain_fold(r["text"]):
            by[plain_fold(r["text"])].append((r["doc_id"], r["text"]))
    want = sorted((min(a, b), max(a, b)) for g in by.values() for k, (a, x) in enumerate(g) for b, y in g[k + 1 :] if x != y)
    assert rows(lookalike.found(docs)) == want


# all ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pairs", "retrieval_units", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    got = rows(queries.queries()[name](spark, where).select(*columns))
    assert got == sorted(r.fetchall(), key=lambda r: [(x is not None, x) for x in r]) and got
