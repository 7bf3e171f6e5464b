"""Contexts, stores, circles, ordinals, pacing and other parts on small and odd input."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import graph, hierarchy, skew, views
from loomgraph.sources import scan, stores
from loomgraph.streaming import pacing


def brute_circles(links):
    edges = {(a, b) for a, b in links if a is not None and b is not None}
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {(max(m for m in nodes if m in reach[n] and n in reach[m]), n) for n in nodes if n in reach[n]}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "e", None]), st.sampled_from(["a", "b", "c", "f", None])), max_size=10))
def test_circles_by_chance(spark, links):
    got = graph.circles(spark.createDataFrame(links, "src string, dst string"))
    assert {tuple(r) for r in got.collect()} == brute_circles(links)


def test_circles_with_a_way_between(spark):
    links = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "c"), ("c", "d"), ("d", "c"), ("s", "s"), ("t", "a")]
    got = graph.circles(spark.createDataFrame(links * 2, "src string, dst string"))
    assert {tuple(r) for r in got.collect()} == {("b", "a"), ("b", "b"), ("d", "c"), ("d", "d"), ("s", "s")}


def test_other_parents(spark):
    links = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "p"), (None, "p"), ("c", None), ("a", "")], "child string, parent string")
    assert [tuple(r) for r in hierarchy.other_parents(links).collect()] == [("a", "q", "p")]
    assert hierarchy.other_parents(links.limit(0)).count() == 0


def test_hot_pointers_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT", 10)
    links = [(f"x{i}", "m") for i in range(60)] + [("m", "top")] + [(f"y{i}", "top") for i in range(30)] + [(f"z{i}", "p") for i in range(20)] + [("p", "q"), ("q", "p")]
    got = {r.name: (r.root, r.depth) for r in hierarchy.hierarchy(spark.createDataFrame(links, "child string, parent string")).collect()}
    want = {f"x{i}": ("top", 2) for i in range(60)} | {f"y{i}": ("top", 1) for i in range(30)} | {f"z{i}": ("(cycle)", -1) for i in range(20)}
    assert got == want | {"m": ("top", 1), "top": ("top", 0), "p": ("(cycle)", -1), "q": ("(cycle)", -1)}


def test_profile_of_a_hot_key_in_one_file(spark):
    rows = [("hot", f"i{k}", "f", "r", None) for k in range(400)] + [("hot", "j", None, None, "x"), ("cold", "k", "f", "r", "x"), (None, "n", "f", "r", "x")]
    df = spark.createDataFrame(rows * 2, "key string, id string, file string, repo string, target string").withColumn("key_text", F.lit("clash"))
    got = {r.key_text: (r.n_ids, r.n_files, r.n_repos, r.n_resolved) for r in skew.key_profile(df, "key", "id", "file", "repo", F.col("target").isNotNull()).collect()}
    assert got == {"hot": (401, 1, 1, 1), "cold": (1, 1, 1, 1)}


def test_shared_folder_is_needed_off_local_masters(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_file_and_symbol_context(spark):
    facts = {
        "symbols": spark.createDataFrame([("s1", "f", "g"), ("s1", "f", "g"), ("s2", "h", "g"), (None, "f", "g")], "id string, file string, name string"),
        "imports": spark.createDataFrame([("i1", "f", "h"), ("i2", "h", "f"), ("i3", None, None)], "id string, file string, resolved_file string"),
        "calls": spark.createDataFrame([("c1", "f", "f::g", "h::g", "g"), ("c2", "h", None, "f::g", "g"), ("c3", "f", "f::g", None, "q")], "id string, file string, caller_symbol string, resolved_symbol string, callee_text string"),
        "type_impls": spark.createDataFrame([("t1", "f", "g", "P"), ("t2", "x", "Q", "g")], "id string, file string, implementing_type string, trait_or_interface string"),
        "bridge_edges": spark.createDataFrame([("doc:a", "f"), ("doc:b", "f::g"), ("doc:c", "ff")], "from_id string, to_id string"),
    }
    of_file = {tuple(r) for r in views.file_context("f", facts).collect()}
    assert of_file == {("symbol", "s1"), ("import", "i1"), ("call", "c1"), ("call", "c3"), ("type_impl", "t1"), ("importer", "h"), ("doc", "doc:a"), ("doc", "doc:b")}
    of_symbol = {tuple(r) for r in views.symbol_context("f::g", facts).collect()}
    assert of_symbol == {("definition", "s1"), ("caller", "h"), ("callee", "h::g"), ("callee", "q"), ("type_impl", "t1"), ("type_impl", "t2"), ("doc", "doc:b")}
    assert views.symbol_context("none::x", facts).count() == 0


def test_ordinals_over_stretches(spark):
    rows = [("f", n, f"n{n}") for n in (5, 1, 2500, 999, 1000, 1000)] + [(None, None, "x"), ("g", None, "y"), ("g", 3, "z")]
    got = views.with_ordinals(spark.createDataFrame(rows, "file string, line int, name string"), "file", "line", ["name"], "s")
    assert sorted((r.fact_id, r.line) for r in got.collect() if r.file == "f") == [("f#s0", 1), ("f#s1", 5), ("f#s2", 999), ("f#s3", 1000), ("f#s4", 1000), ("f#s5", 2500)]
    assert sorted((r.fact_id, r.name) for r in got.collect() if r.file != "f") == [("#s0", "x"), ("g#s0", "y"), ("g#s1", "z")]


def test_may_edit(spark):
    want = {("a/b.py", 5): True, ("a/.git/x", 1): False, ("a/.github/x", None): True, ("x.lock", 1): False, ("a/.env.local", 1): False, ("../a", 1): False, ("/a", 1): False, ("a", views.MAX_EDIT + 1): False, ("a", views.MAX_EDIT): True, (None, 1): False}
    df = spark.createDataFrame(list(want), "p string, n long")
    assert {(r.p, r.n): r.ok for r in df.select("p", "n", views.may_edit(F.col("p"), F.col("n")).alias("ok")).collect()} == want


def test_ignore_rules(spark):
    rules = "# c\n*.log\n!keep.log\nbuild/\n/top\ndocs/*.txt\n"
    want = {"a.log": True, "x/a.log": True, "x/keep.log": False, "build/a": True, "x/build/a": True, "build": False, "top/a": True, "x/top": False, "docs/a.txt": True, "x/docs/a.txt": False, "a.py": False}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.i for r in df.select("p", scan.ignored(F.col("p"), rules).alias("i")).collect()} == want


def test_graph_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", None]), (2, None, None)], "id int, name string, tags array<string>")
    root = f"file://{tmp_path}"
    stores.save_graph({"nodes": df}, root)
    stores.save_graph({"nodes": df}, root)
    got = stores.load_graph(spark, root, {"nodes": df.schema, "never": df.schema})
    assert sorted(map(tuple, got["nodes"].collect())) == sorted(map(tuple, df.collect())) and got["never"].count() == 0
    assert stores.cleared({"nodes": df, "docs": df}, {"docs"})["nodes"].count() == 0


def test_metadata(spark):
    stored = stores.set_metadata(views.empty_like(spark, "key string, value string"), {"a": "1", "b": "2"})
    assert {tuple(r) for r in stores.set_metadata(stored, {"a": "3"}).collect()} == {("a", "3"), ("b", "2")}


def test_config_precedence():
    got = stores.Config.load("search_limit: 5\nleast_score: 0.5\ninclude: [a, b]\nother: 1\nimpact_depth: null", {"LOOMGRAPH_SEARCH_LIMIT": "7", "LOOMGRAPH_EXCLUDE": "x, y,", "HOME": "/"}, context_tokens=9)
    assert (got.search_limit, got.least_score, got.include, got.exclude, got.context_tokens, got.impact_depth) == (7, 0.5, ("a", "b"), ("x", "y"), 9, 3)
    assert stores.Config.load(None, {}) == stores.Config()
    with pytest.raises(ValueError):
        stores.Config.load("- a", {})


def test_pacing():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    gate = pacing.FixedInterval(30, lambda: now[0], sleep)
    assert [gate.wait(), gate.wait(), gate.wait()] == [0.0, 2.0, 2.0]
    now[0] += 10
    assert gate.wait() == 0.0
    assert pacing.pauses(7) == [1, 2, 4, 8, 16, 30, 30]
    left = [OSError(), OSError()]

    def call():
        if left:
            raise left.pop()
        return "done"

    assert pacing.retried(call, sleep=slept.append) == "done" and slept[-2:] == [1.0, 2.0]
    with pytest.raises(ValueError):
        pacing.retried(lambda: int("x"), sleep=slept.append)
