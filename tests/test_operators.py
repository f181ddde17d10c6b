"""Operators against known answers, brute force and awkward rows."""

import hashlib
import itertools
import json
import math
import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import draws, metrics, solidity, text
from quarrymill.operators import checks, classify, corpus, dedup, graph, matching, retrieval, runs, stats, tables
from quarrymill.sources import files, store
from quarrymill.streaming import append


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# text and metrics --------------------------------------------------------------------------------------


def test_metrics_known_answers():
    assert metrics.rouge_n_of("the amount extra", "the amount") == pytest.approx(0.8)
    assert metrics.rouge_n_of("amount the", "the amount", 2) == 0.0
    assert metrics.rouge_n_of("the the the", "the") == pytest.approx(0.5)
    assert metrics.rouge_n_of("word", "word", 2) == 0.0
    stems = {"deposits": "deposit", "returned": "return", "quickly": "quick", "Updating": "updat", "payments": "pay", "is": "is", "les": "les"}
    assert {w: metrics.stem_of(w) for w in stems} == stems
    assert 0.98 < metrics.meteor_of("moves the whole balance to owner", "moves the whole balance to owner") < 1
    assert [metrics.chunk_count(p) for p in ([], [(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 5)])] == [0, 1, 2]
    assert metrics.sentence_bleu_of("one two three", "one two three") == pytest.approx(1.0)
    assert metrics.sentence_bleu_of("a b", "c d") == 0.0 and metrics.sentence_bleu_of("", "c") == 0.0


def test_lcs_brute():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        best = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if not c or all(x in it for it in [iter(b)] for x in c))
        assert metrics.lcs(a, b) == best


def test_vectors_are_units():
    v = metrics.hashed_features("function move(address to) external", 256)
    assert math.isclose(float((v * v).sum()), 1.0) and not metrics.hashed_features("", 256).any()


def test_text_columns(spark):
    df = spark.createDataFrame([("  Two  Words\n", "depositAmount", "x"), (None, "MAX_FEE", "y"), ("", "", "z")], "a string, b string, tokens string")
    got = df.select(text.norm_prose(F.col("a")), text.split_identifier(F.col("b")), text.stem(F.lit("payments")), F.size(text.shingles(text.word_tokens(F.coalesce("a", F.lit("")))))).collect()
    assert [tuple(r) for r in got] == [("two words", ["deposit", "amount"], "pay", 1), (None, ["max", "fee"], "pay", 0), ("", [""], "pay", 0)]
    t = spark.range(1).select(text.code_tokens(F.lit('a>>>=0x1f + b["s,t"]')).alias("t"), text.nl_tokens(F.lit("It's (ok), yes.")).alias("n")).first()
    assert t["t"] == ["a", ">>>=", "0x1f", "+", "b", "[", '"s,t"', "]"] and t["n"] == ["It", "'", "s", "(", "ok", ")", ",", "yes", "."]
    assert spark.range(1).select(text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 1.0


def test_spans_tile():
    src = 'a "//" /* x */ b // y\n/// z\n\'\\\'\' /** open'
    parts = solidity.spans(src)
    assert [src[s:e] for _, s, e in parts] and "".join(src[s:e] for _, s, e in parts) == src
    assert [k for k, _, _ in parts if k != "code"] == ["string", "block", "line", "doc_line", "string", "doc_block"]
    assert len(solidity.code_view(src)) == len(src)
    assert solidity.spans("") == [] and solidity.declarations("") == []


# dedup and corpus --------------------------------------------------------------------------------------


def test_keep_first(spark):
    d = [("s", "A  b", None, "train", "f() {}", "f2", 1, "i1", "p"), ("s", "a B", "", "test", "f();", "f1", 1, "i2", "p"), ("s", "a b", None, " TEST", "f() { }", "f3", 1, "i3", "p"), ("t", None, None, None, None, None, None, "i4", "p")]
    df = spark.createDataFrame(d, "signature string, notice string, dev string, split string, code string, file string, code_start int, id string, project string")
    assert [r[0] for r in rows(dedup.dedup_pairs(df))] == ["i3", "i4"]
    assert rows(dedup.dedup_pairs(df.limit(0))) == []


def test_latest_ties(spark):
    at = datetime(2031, 1, 1)
    df = spark.createDataFrame([("a", at, "x"), ("a", at, "y"), ("a", None, "z"), (None, at, "n")], "id string, at timestamp, v string")
    assert [r["v"] for r in dedup.latest(df, "id", "at", "v").collect()] == ["y"]


def test_length_profile(spark):
    df = spark.createDataFrame([("k", " ".join("x" * n)) for n in range(1, 31)] + [("k", None), ("k", "  ")], "kind string, text string")
    r = corpus.length_profile(df, "text", "kind").first()
    n = list(range(1, 31))
    assert (r["n"], r["p10"], r["p90"]) == (30, n[max(0, 3 - 1)], n[min(29, 27)]) and r["mean"] == 15.5


def test_reference_fields_order(spark):
    df = spark.createDataFrame([("n", " ", {"b": "B", "a": "A"}, [(None, f"r{i}") for i in range(11)])], "notice string, dev string, params map<string,string>, returns array<struct<name:string,text:string>>")
    r = df.select(corpus.canonical_text(corpus.reference_fields())).first()[0]
    assert r == "n A B " + " ".join(f"r{i}" for i in range(11))


# statistics --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paired(spark):
    rng = random.Random(3)
    data = [(c, f"p{i}", round(rng.random(), 1), round(rng.random(), 1)) for c in ("a", "b") for i in range(60)] + [("same", f"p{i}", 0.5, 0.5) for i in range(9)]
    return spark.createDataFrame(data, "config string, pair_id string, x double, y double"), data


def test_cliffs_and_ranks(paired):
    df, data = paired
    got = {r["config"]: r["delta"] for r in stats.cliffs_delta(df).collect()}
    for c in ("a", "b", "same"):
        xs, ys = [d[2] for d in data if d[0] == c], [d[3] for d in data if d[0] == c]
        assert got[c] == pytest.approx(sum((x > y) - (x < y) for x in xs for y in ys) / len(xs) ** 2)
    w = {r["config"]: r for r in stats.sign_ranks(df).collect()}
    for c in ("a", "b"):
        d = [round(x - y, 12) for k, _, x, y in data if k == c and x != y]
        order = sorted(abs(v) for v in d)
        rank = lambda v: (order.index(abs(v)) + 1 + order.index(abs(v)) + order.count(abs(v))) / 2
        assert w[c]["w_plus"] == pytest.approx(sum(rank(v) for v in d if v > 0))
    p = {r["config"]: r["p"] for r in stats.wilcoxon(df).collect()}
    assert p["same"] == 1.0 and 0 < p["a"] <= 1


def test_bootstrap(paired):
    df, data = paired
    got = {r["config"]: r for r in stats.paired_bootstrap(df, 400).collect()}
    assert got["same"]["diff"] == got["same"]["low"] == got["same"]["high"] == 0
    d = [x - y for c, _, x, y in data if c == "a"]
    assert got["a"]["diff"] == pytest.approx(sum(d) / len(d)) and got["a"]["low"] < got["a"]["diff"] < got["a"]["high"]


def test_md5_heads():
    for prefix in ("7:1:", "-40:400:", "x" * 45):
        got = [int(v) for part in draws.md5_heads(prefix, 20_005) for v in part]
        assert got == [int(hashlib.md5(f"{prefix}{j}".encode()).hexdigest()[:8], 16) for j in range(1, 20_006)]
    assert not list(draws.md5_heads("7:1:", 0))
    with pytest.raises(ValueError):
        list(draws.md5_heads("x" * 55, 1))


def test_bootstrap_brute(spark, monkeypatch):
    """Every draw counts, over rows packed and held in small parts; none is a row that a join could broadcast."""
    monkeypatch.setattr(stats, "PACK", 16)
    monkeypatch.setattr(stats, "HELD", 64)
    rng = random.Random(11)
    data = [(c, f"p{i:04}", None if i % 50 == 7 else rng.random(), rng.random()) for c, k in (("a", 1), ("b", 16), ("c", 150), ("d", 1203)) for i in range(k)]
    shuffled = spark.createDataFrame(rng.sample(data, len(data)), "config string, pair_id string, x double, y double")
    df = stats.paired_bootstrap(shuffled, 60, seed=3)
    assert not re.search(r"sequence\(1, n#", df._jdf.queryExecution().optimizedPlan().toString())
    got = {r["config"]: r for r in df.collect()}
    for c in "abcd":
        d = [None if x is None else x - y for k, _, x, y in data if k == c]
        means = []
        for r in range(1, 61):
            drawn = [d[int(hashlib.md5(f"3:{r}:{j}".encode()).hexdigest()[:8], 16) % len(d)] for j in range(1, len(d) + 1)]
            some = [v for v in drawn if v is not None]
            means.append(math.fsum(some) / len(some))
        means.sort()
        assert got[c]["n"] == len(d) and (got[c]["low"], got[c]["high"]) == (pytest.approx(means[1]), pytest.approx(means[58]))


def test_holm_and_mcnemar(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "config string, p double")
    assert {r["config"]: (round(r["adjusted"], 3), r["reject"]) for r in stats.holm(t).collect()} == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}
    o = spark.createDataFrame([("a", True, False)] * 8 + [("a", False, True)] * 2 + [("b", True, True)], "config string, x boolean, y boolean")
    p = {r["config"]: r["p"] for r in stats.mcnemar(o).collect()}
    assert p["a"] == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 1024) and p["b"] == 1.0


# graphs ------------------------------------------------------------------------------------------------


def test_components_brute(spark):
    rng = random.Random(5)
    e = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("solo", "solo"), (None, "x")] + [("hub", f"h{i}") for i in range(50)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a and b:
            parent[top(a)] = top(b)
    groups = {}
    for n in parent:
        groups.setdefault(top(n), []).append(n)
    want = sorted((n, min(g)) for g in groups.values() for n in g)
    assert sorted(map(tuple, graph.components(spark.createDataFrame(e, "a string, b string")).collect())) == want
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_reach_fixpoint_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", None)], "src string, dst string")
    assert rows(graph.reach(spark.createDataFrame([("a",)], "s string"), e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert ("a", "d") in rows(graph.fixpoint(e)) and ("a", "a") not in rows(graph.fixpoint(e)) and len(rows(graph.fixpoint(e))) == 10
    p = graph.acyclic_paths(spark.createDataFrame([("a",)], "s string"), e.where("dst is not null")).collect()
    assert sorted(r["path"] for r in p) == [["a", "b", "c", "d"]] or sorted(r["path"] for r in p)[-1][-1] == "d"
    wide = spark.createDataFrame([("s", f"m{i}") for i in range(20)], "src string, dst string")
    p = graph.acyclic_paths(spark.createDataFrame([("s",)], "s string"), wide).collect()
    assert len(p) == 16 and all(r["truncated"] for r in p)


def test_fixpoint_brute(spark):
    """Rings, ways between them, chains, loops and separate parts, against a walk from every node."""
    rng = random.Random(9)
    ring = lambda name, k: [(f"{name}{i:02}", f"{name}{(i + 1) % k:02}") for i in range(k)]
    e = ring("a", 20) + ring("b", 3) + ring("z", 2) + [("a07", "b01"), ("b02", "c0"), ("a01", "a01"), ("l", "l"), (None, "a01"), ("a02", None)] + [(f"c{i}", f"c{i + 1}") for i in range(6)] + [("x", "a03"), ("x", "c5")]
    e += [(f"r{rng.randrange(30)}", f"r{rng.randrange(30)}") for _ in range(36)]
    sons = {}
    for s, t in e:
        if s and t:
            sons.setdefault(s, set()).add(t)
    want = set()
    for s in sons:
        todo, seen = [s], set()
        while todo:
            for t in sons.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        want |= {(s, t) for t in seen if t != s}
    assert rows(graph.fixpoint(spark.createDataFrame(e + e[:5], "src string, dst string"))) == sorted(want, key=repr)
    assert graph.fixpoint(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_fixpoint_of_a_ring_is_not_doubled(spark, monkeypatch):
    """What is written on the way follows the edges, not the pairs of nodes that reach each other."""
    rng, most, cut = random.Random(4), [], graph.cut
    e = [(i, rng.randrange(300)) for i in range(300) for _ in range(5)] + [(i, (i + 1) % 300) for i in range(300)]
    monkeypatch.setattr(graph, "cut", lambda df: most.append((x := cut(df)).count()) or x)
    assert graph.fixpoint(spark.createDataFrame(e, "src long, dst long")).count() == 300 * 299
    assert max(most) <= len(e)


def test_acyclic_paths_brute(spark):
    import __spark_entry__ as entry

    def walk(edges, start, max_nodes, max_paths):
        out, cut = [], []

        def go(path):
            if len(out) >= max_paths or len(path) > max_nodes + 1:
                cut.append(path)
                return
            sons = sorted({t for s, t in edges if s == path[-1]} - set(path))
            for t in sons:
                go([*path, t])
            if not sons:
                out.append(path)

        go([start])
        return [(start, k, p, bool(cut)) for k, p in enumerate(out)]

    keys = range(25)
    edges = [(k, t) for k in keys for t in (k + 1, k + 5, k - 5) if t in keys]
    got = entry.queries()["acyclic_paths"](spark, "/root/testdata/sf0.001").select("start", "k", "path", "truncated").collect()
    assert sorted(map(tuple, got)) == [r for k in keys for r in walk(edges, k, 64, 16)]
    # the first branches of 0 all go on too long, its later ones end
    deep = [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (1, 6), *((k, 7) for k in (3, 4, 5, 6)), (7, 8), (2, 9), (2, 10), (20, 21), (30, 31), (31, 32), (32, 33), (33, 34)]
    e = spark.createDataFrame(deep, "src int, dst int")
    got = graph.acyclic_paths(spark.createDataFrame([(0,), (20,), (30,)], "s int"), e, max_nodes=2, max_paths=2).select("start", "k", "path", "truncated").collect()
    assert sorted(map(tuple, got)) == [r for k in (0, 20, 30) for r in walk(deep, k, 2, 2)]


# matching and retrieval --------------------------------------------------------------------------------


def test_match(spark):
    body = "function move(address to, uint v) external { total[to] += v; emit Moved(to, v); count += 1; seen[to] = block.number; sums -= v * 2; last = to; }"
    near = body.replace("last = to;", "last = to2;")
    index = [("t1", body), ("t2", "function move(uint a) external { a += 1; }"), *((f"c{i}", f"function crowd(uint a) {{ x = {i}; }}") for i in range(6))]
    q = [("q1", body.replace(" ", "  ")), ("q2", near), ("q3", "constructor() {}"), ("q4", "function crowd(uint a) { y = 99; }"), ("q5", None)]
    s = "id string, code string"
    got = {r["query_id"]: (r["how"], r["target_id"]) for r in matching.match(spark.createDataFrame(q, s), spark.createDataFrame(index, s), crowd=5).collect()}
    assert got == {"q1": ("exact", "t1"), "q2": ("fuzzy", "t1"), "q3": ("none", None), "q4": ("crowded", None), "q5": ("none", None)}


def test_match_crowded(spark):
    rng = random.Random(5)
    s = "id string, code string"
    body = lambda ws: "function crowd(uint a) { " + " ".join(f"{w} += a;" for w in ws) + " }"
    base = [[f"v{rng.randrange(60)}" for _ in range(30)] for _ in range(8)]
    edit = lambda ws, k: [f"w{rng.randrange(9)}" if i in at else w for at in [rng.sample(range(30), k)] for i, w in enumerate(ws)]
    index = [(f"t{i:02}", body(edit(base[i % 8], rng.randrange(4)) if i > 8 else base[i % 8])) for i in range(40)]
    index += [("u1", body(base[7]) + " "), *((f"long{i}", body([f"x{i}"] * 90)) for i in range(9))]
    q = [(f"q{i}", body(edit(base[i % 8], 1 + i % 3))) for i in range(48)] + [("same1", body(["z", *base[2][1:]])), ("same2", body(["z", *base[2][1:]]))]
    sets = lambda code: {tuple(w[i : i + 3]) for w in [re.findall(r"\w+|\+=|[^\s\w]", code)] for i in range(len(w) - 2)}
    want = {}
    for k, code in q:
        near = sorted(((len(sets(code) & sets(c)) / len(sets(code) | sets(c)), t) for t, c in index if not t.startswith("long")), reverse=True)
        ok = near[0][0] >= 0.85 and near[0][0] - near[1][0] >= 0.05
        want[k] = (near[0][1] if ok else None, 41)
    exact = {re.sub(r"\s", "", c) for _, c in index}
    want = {k: want[k] for k, c in q if re.sub(r"\s", "", c) not in exact}
    assert 5 < sum(t is not None for t, _ in want.values()) < len(want)
    for crowd in (5, 400):
        got = [r for r in matching.match(spark.createDataFrame(q, s), spark.createDataFrame(index, s), crowd=crowd).collect() if r["how"] != "exact"]
        assert {r["query_id"]: (r["target_id"], r["candidates"]) for r in got} == want and len(got) == len(want)
        assert {r["how"] for r in got} == {"fuzzy", "none" if crowd == 400 else "crowded"}


def test_match_counts_within_band(spark):
    body = "function move(address to, uint v) external { total[to] += v; emit Moved(to, v); count += 1; seen[to] = block.number; sums -= v * 2; last = to; }"
    index = [("t1", body), *((f"s{i}", f"function move(address to, uint v) {{ x = {i}; }}") for i in range(6))]
    s = "id string, code string"
    q = spark.createDataFrame([("q", body.replace("last = to;", "last = to2;"))], s)
    got = matching.match(q, spark.createDataFrame(index, s), crowd=5).first()
    assert (got["how"], got["target_id"], got["candidates"]) == ("fuzzy", "t1", 1)
    twice = spark.createDataFrame([*index, ("t2", body)], s)
    assert [matching.match(q, twice, crowd=c).first()["target_id"] for c in (0, 5)] == [None, None]


def test_top_k_brute(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = rows(retrieval.top_k(df, df.where("vec_id % 10 = 0"), 5).select("query_id", "rank", "unit_id"))
    want = []
    for i, v in data[:80:10]:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in data[:80] if j != i))[:5]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(best)]
    assert got == sorted(want, key=repr)


# checks, labels, runs ----------------------------------------------------------------------------------


def test_each_violation(spark):
    d = [("i1", True, None, " ", 0, 5, 5, 9, "f", "code", {"ghost": "x"}), ("i2", False, "n", None, 3, 2, 9, 12, "f", "function g(uint y) {}", {"y": "t"}), ("i3", True, "n", None, 4, 8, 9, 12, "f", "c", None)]
    p = spark.createDataFrame(d, "id string, verified boolean, notice string, dev string, doc_start int, doc_end int, code_start int, code_end int, file string, code string, params map<string,string>")
    u = spark.createDataFrame([("i1",), ("zz",)], "pair_id string")
    v = checks.violations(checks.verified_without_prose(p), checks.bad_offsets(p), checks.overlapping_docs(p), checks.duplicate_keys(p, "unique_places", "file", "code_start"), checks.unknown_params(p), checks.dangling(u, p, "units_have_pairs", "pair_id", "id"))
    assert {(r["check"], r["key"]) for r in v.collect()} == {("verified_have_prose", "i1"), ("offsets_are_ordered", "i2"), ("no_overlapping_docs", "i2"), ("unique_places", "f|9"), ("params_round_trip", "i1"), ("units_have_pairs", "zz")}


def test_judge(spark):
    s = "id string, name string, notice string, dev string, code string, params map<string,string>, returns array<struct<name:string,text:string>>"
    code = "function moveAll(address to, uint[] memory v) external returns (bool) { }"
    d = [("ok", "moveAll", "Moves the whole balance", None, code, {"to": "t", "v": "v"}, [(None, "done")]), ("none", "moveAll", None, "", code, {"to": "t", "v": " "}, None), ("echo", "moveAllNow", "Move all now", None, "function moveAllNow() {}", {"zed": "z"}, [(None, "")]), ("todo", "f", "TODO write", None, "function f() {}", None, None)]
    got = {r["id"]: r["defects"] for r in classify.judge(spark.createDataFrame(d, s)).collect()}
    assert got == {"ok": [], "none": ["no_text", "param_empty:v", "return_missing"], "echo": ["name_echo", "param_unknown:zed", "return_extra"], "todo": ["placeholder", "text_short"]}


def test_matched_ids(spark):
    df = spark.createDataFrame([("p", "a", None), ("p", "b", ""), ("q", "a", None), ("q", "b", "boom"), ("q", "b", "boom")], "pair_id string, config string, error string")
    assert rows(runs.matched_ids(df)) == [("p",)]


# sources, stores, streams ------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.sol").write_bytes(b"line\r\nbad \xff byte")
    got = files.read_sources(spark, str(tmp_path / "a")).collect()
    assert [(r["file"], r["src"], r["bytes"]) for r in got] == [("b/x.sol", "line\r\nbad � byte", 16)]
    (tmp_path / "j.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n{"id": ')
    assert rows(files.read_jsonl(spark, str(tmp_path / "j.jsonl"), "id int", tolerant=True).where("id is not null")) == [(1,), (2,)]
    for n, t in (("l", "a\nb\n\nc\n"), ("r", "1\n2\n3\n4")):
        (tmp_path / n).write_text(t)
    both = files.aligned_lines(spark, {"x": str(tmp_path / "l"), "y": str(tmp_path / "r")})
    assert rows(both) == [(0, "a", "1"), (1, "b", "2"), (2, "", "3"), (3, "c", "4")]
    (tmp_path / "r").write_text("1")
    with pytest.raises(ValueError):
        files.aligned_lines(spark, {"x": str(tmp_path / "l"), "y": str(tmp_path / "r")})


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", "s1"), (2, "y", "s2")], "id int, v string, sha string")
    path = str(tmp_path / "t")
    assert store.append_new(spark, a, path, "id") == 2 and store.append_new(spark, a, path, "id") == 0
    new = spark.createDataFrame([(1, "x", "s1"), (2, "z", "s9"), (3, "w", "s3")], "id int, v string, sha string")
    assert rows(store.upsert(a, new, "id", "sha")) == [(1, "x", "s1"), (2, "z", "s9"), (3, "w", "s3")]
    root = str(tmp_path / "versions")
    assert store.write_version(a, root).endswith("v1") and store.write_version(a, root).endswith("v2")
    with pytest.raises(ValueError):
        store.write_version(a.limit(0), root)
    assert "| 1 | x | s1 |" in tables.markdown(a)
    d = [store.tree_digest(a.select(F.col("v").alias("file"), F.col("sha").alias("sha1")).repartition(n)).first()[0] for n in (1, 3)]
    assert d[0] == d[1]


def test_streams(spark, tmp_path):
    at = datetime(2031, 1, 1, 10)
    s = "id int, ts timestamp, event_type string, value double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, at, "a", 1.0), (1, at, "a", 1.0), (2, at, "b", 2.0)], s).write.parquet(src)
    stream = append.once_per_key(append.read_growing(spark, src, s), "ts", "1 day", "id")
    append.append_each(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(2, at, "b", 2.0), (3, at, "b", 3.0)], s).write.mode("append").parquet(src)
    append.append_each(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_plans_push_down(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["pricing_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert os.path.exists("/root/testdata/sf0.001") and json.dumps(sorted(entry.oracle_sql()))


def test_comments_as_data():
    from quarrymill.functions import comments

    f = {"notice": "Moves the whole balance to the vault of the owner", "dev": "Careful", "param:to": "the receiver", "return:0": "ok done"}
    for style in ("block", "lines"):
        assert comments.comment_fields(comments.render(f, style, "    ", 60)) == f
    assert comments.comment_fields(None) == {} and comments.comment_fields("plain text") == {"notice": "plain text"}
    assert comments.recover_json('Sure {not json} here: ```{"a": {"b": 1}}``` bye') == {"a": {"b": 1}}
    assert comments.recover_json("none") is None and comments.recover_json('{"a": ') is None
    src = "contract C { /// @notice Doc of f here\n function f() public {} function g() external; function h() internal {} constructor() {} }"
    assert comments.exposed_members(src) == [("function", "f()", True), ("function", "g()", False), ("constructor", "constructor", False)]


@pytest.mark.parametrize(
    "doc, name, want",
    [
        ("Moves the whole balance out", "move", False), ("<describe what it does here>", "f", True), ("[your text goes in here]", "f", True), ("{{ summary of f }} ...", "f", True), ("Fee: ____ ____ ____", "f", True),
        ("Adds to `balances[msg.sender]` only", "f", False), ("The fee [in wei] of a move", "f", False), ("set max fee", "setMaxFee", True), ("TODO write this down", "f", True), ("two words", "f", True),
    ],
)
def test_trivial(doc, name, want):
    assert solidity.is_trivial(doc, name) is want


def test_top_k_keeps_ties(spark):
    rng = random.Random(5)
    data = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(60)] + [(99, None)]
    u = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in retrieval.top_k(u, u.where("vec_id % 7 = 0"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["unit_id"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    v = {i: x for i, x in data if x}
    assert got == {q: sorted((i for i in v if i != q), key=lambda i: (-dot(v[q], v[i]), i))[:6] for q in v if q % 7 == 0}


# written after the rules, and not used for them
UNSEEN_PLACEHOLDERS = """Somebody has to write this up later
Left blank on purpose for the docs team
Docs pending review by the maintainers
More text needed here before we ship
Your comment goes here, thank you
Please do not forget to describe the return value
Still to be explained in detail
Insert explanation when known
Lorem ipsum dolor sit amet
Nothing to see in this comment yet
Description unavailable at the moment
Under construction until the next release""".splitlines()
DESCRIPTIONS = """Adds a description to the item
Writes the summary of the day to the log
Provides text for the renderer
Missing entries are skipped
Returns the notice period in days
Inserts a comment below the post
To be called by the keeper only
Needs the approval of the owner
Will be announced by the oracle each hour
Not documented slots are free to use
Fills in the missing price of the asset
Completes the withdrawal of the caller""".splitlines()


def test_placeholders_in_unseen_words():
    assert sum(solidity.is_trivial(x, "f") for x in UNSEEN_PLACEHOLDERS) >= 7  # of 12
    assert not any(solidity.is_trivial(x, "f") for x in DESCRIPTIONS)
