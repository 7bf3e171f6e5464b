"""Heavy keys, references, snapshots and hierarchies against brute force and odd input."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import hierarchy, references, skew, snapshots
from loomgraph.plans import problems

FACT = "k string, id string, file string, repo string, target string, extra int"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_shortest_path(spark):
    pairs = {
        "a/b": "a/b", "./a/b": "a/b", "a//b": "a/b", "a\\b\\c": "a/b/c", "a/x/../b": "a/b", "a/./b": "a/b", "/a/b/": "a/b", "../a": "a", "a/b/../../c": "c", "a/..b/c.": "a/..b/c.", "A/b": "A/b", "": "",
    }
    df = spark.createDataFrame([(k,) for k in pairs] + [(None,)], "p string")
    got = {r.p: r.s for r in df.select("p", paths.shortest(F.col("p")).alias("s")).collect()}
    assert got == pairs | {None: None}


def test_symbol_key(spark):
    df = spark.createDataFrame([("./a/b.rs::f",), ("a\\b.rs",), ("a//b::C::d",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.symbol_key(F.col("p"))).collect()] == ["a/b.rs::f", "a/b.rs", "a/b::C::d", None]


def test_packing_is_even():
    heavy = {"a": 5000, "b": 1500}
    plan = skew.pack(heavy, {b: 3 for b in range(skew.BUCKETS)}, 8)
    fair = sum(plan.loads) / 8
    assert max(plan.loads) < 1.2 * fair
    assert len(plan.heavy["a"]) > len(plan.heavy["b"]) > 1
    assert set(plan.light) <= set(range(8))


def test_slot_numbers(spark):
    numbers = skew.slot_numbers(7)
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select(F.pmod(F.hash("n"), F.lit(7)).alias("t"))
    assert [r.t for r in df.collect()] == list(range(7))


def skewed(n=600):
    out = []
    for i in range(n):
        k = "hot" if i % 3 else f"k{i % 40}"
        out.append((k, f"id{i}", f"r{i % 5}/f{i % 50}", f"r{i % 5}", "x" if i % 2 else " ", i))
    out += out[:50] + [(None, "n1", "r0/f", "r0", None, 0), (None, "n2", "r0/f", "r0", None, 0)]
    return out


def test_profile_and_heavy_keys(spark):
    data = skewed()
    df = spark.createDataFrame(data, FACT)
    want = defaultdict(lambda: [set(), set(), set(), set()])
    for k, i, f, r, t, _ in data:
        if k is not None:
            want[k][0].add(i)
            want[k][1].add(f)
            want[k][2].add(r)
            if t and t.strip():
                want[k][3].add(i)
    got = {r.key_text: (r.n_ids, r.n_files, r.n_repos, r.n_resolved) for r in skew.key_profile(df, "k", "id", "file", "repo", F.trim("target") != "").collect()}
    assert got == {k: tuple(map(len, v)) for k, v in want.items()}
    total = len({i for _, i, *_ in data})
    heavy = {r.key_text for r in skew.heavy_keys(df, "k", "id", 0.015).collect()}
    assert heavy == {k for k, v in want.items() if len(v[0]) >= 0.015 * total}


def test_heavy_keys_of_nothing(spark):
    assert skew.heavy_keys(spark.createDataFrame([], FACT), "k", "id", 0.1).collect() == []
    assert skew.key_profile(spark.createDataFrame([], FACT), "k", "id", "file", "repo", F.lit(True)).collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_balanced_join(spark, how):
    left = spark.createDataFrame(skewed(200), FACT)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), (None, 4)], "k string, extra int")
    got = skew.balanced_join(left, right, "k", "k", ["id"], how)
    plain = left.join(right.withColumnRenamed("k", "dim_k").withColumnRenamed("extra", "dim_extra"), F.col("k") == F.col("dim_k"), how)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(got) == key(plain)


REFS = "kind string, key string, run int, name string"
PARENTS = "kind string, key string, first_run int, end_run int, name string"


@pytest.mark.parametrize("limit", [references.MAX_FILTER_BITS, 1])
def test_orphans(spark, monkeypatch, limit):
    monkeypatch.setattr(references, "MAX_FILTER_BITS", limit)
    parents = [("f", "a", 1, 3, "x"), ("f", "a", 1, 3, "x"), ("f", "b", 2, None, None), ("d", "a", 5, None, "z"), ("f", None, 1, None, ""), ("f", "c", None, None, "")]
    refs = [("f", "a", 1, "in"), ("f", "a", 3, "gone"), ("f", "b", 1, "early"), ("f", "b", 9, "in"), ("d", "b", 9, "kind"), ("f", "zz", 1, "never"), ("f", "c", 1, "norun"), ("f", None, 1, "null"), ("f", "  ", 1, "blank"), ("f", "zz", None, "nullrun")]
    got = references.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted(r.name for r in got.collect()) == ["early", "gone", "kind", "never", "norun"]


def test_orphans_filter_fits_the_driver(spark, monkeypatch):
    """A filter is no larger than the driver's heap allows, and the result, a union of scans, carries none."""
    made, plain = [], references.bloom_filter
    monkeypatch.setattr(references, "bloom_filter", lambda hashes, n_keys: made.append(n_keys) or plain(hashes, n_keys))
    monkeypatch.setattr(references, "driver_heap", lambda _: 80_000, raising=False)
    parents = spark.range(5000).selectExpr("'f' as kind", "'k' || id as key", "1 as first_run", "cast(null as int) as end_run")
    refs = [spark.range(2000).selectExpr("'f' as kind", f"if(id % 100 = 0, 'gone', 'k') || (id + {1000 * k}) as key", "1 as run", f"'{k}-' || id as name") for k in range(4)]
    got = references.orphans(refs[0].union(refs[1]).union(refs[2]).union(refs[3]), parents)
    assert "might_contain" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert max(made) * references.BITS_PER_KEY <= 80_000 * 8 // 64
    assert sorted(r.name for r in got.collect()) == sorted(f"{k}-{i}" for k in range(4) for i in range(0, 2000, 100))


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], PARENTS)
    refs = spark.createDataFrame([("f", "a", 1, "x")], REFS)
    assert references.orphans(refs, none).count() == 1
    assert references.orphans(spark.createDataFrame([], REFS), none).count() == 0


def test_snapshot_changes(spark):
    rows = [
        (1, "a", "AA"), (1, "b", "x"), (1, "c", None), (1, "c", None), (4, "a", "aa"), (4, "b", "y"), (4, "c", None), (4, "d", "q"), (4, None, "q"), (None, "z", "q"), (5, "a", "aa"), (5, "d", "q"),
    ]
    df = spark.createDataFrame(rows, "snapshot_no int, path string, hash string").withColumn("key", F.lit("clash"))
    got = snapshots.snapshot_changes(df, "snapshot_no", F.col("path"), F.lower("hash"))
    assert rows_of(got) == [(4, "b", "changed"), (4, "d", "added"), (5, "b", "removed"), (5, "c", "removed")]
    assert snapshots.snapshot_changes(df.where("snapshot_no = 1"), "snapshot_no", F.col("path"), F.col("hash")).count() == 0
    assert snapshots.snapshot_changes(df.limit(0), "snapshot_no", F.col("path"), F.col("hash")).count() == 0


def brute_tree(links):
    up = {}
    for c, p in links:
        if c and p:
            up[c] = min(up.get(c, p), p)
    names = {x for c, p in links if c and p for x in (c, p)}
    out = {}
    for n in names:
        seen, at = [n], n
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        out[n] = ("(cycle)", -1, None) if at in up else (at, len(seen) - 1, seen[::-1])
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "e", "f", None, ""]), st.sampled_from(["a", "b", "c", "d", "g", "h", None])), max_size=12))
def test_hierarchy_by_chance(spark, links):
    df = spark.createDataFrame(links, "child string, parent string")
    got = {r.name: (r.root, r.depth, r.path) for r in hierarchy.hierarchy(df, with_path=True).collect()}
    assert got == brute_tree(links)


def test_long_chain_and_hot_root(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [(f"x{i}", "n0") for i in range(200)] + [("p", "q"), ("q", "p"), ("r", "p"), ("s", "s")]
    tree = hierarchy.hierarchy(spark.createDataFrame(links * 2, "child string, parent string"), with_path=True)
    got = {r.name: (r.root, r.depth) for r in tree.collect()}
    assert got == {k: v[:2] for k, v in brute_tree(links).items()}
    assert tree.where("name = 'n39'").first().path == [f"n{i}" for i in range(40)]
    assert hierarchy.descendants(tree).where("ancestor = 'n0'").count() == 239


def test_bare_names(spark):
    cases = {"a::B<c::D<E>>": "B", "x.y.Z<'a>": "Z", "Plain": "Plain", "P <T, U>": "P"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.b for r in df.select("t", problems.bare(F.col("t")).alias("b")).collect()} == cases
