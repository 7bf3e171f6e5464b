"""Resolution, graphs, budgets, documents, updates and streams on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import budget, context, docs, graph, incremental, resolve
from loomgraph.sources import manifests, scan, vectors
from loomgraph.streaming import watch

SYM = "id string, file string, name string, line_start int, line_end int, exported boolean, is_test boolean"


def test_call_cascade(spark):
    symbols = spark.createDataFrame([("s1", "a.py", "run", 1, 9, True, False), ("s2", "b.py", "run", 1, 9, True, False), ("s3", "b.py", "go", 3, 4, True, False), ("s4", "a.py", "Box", 5, 6, True, False)], SYM)
    imports = spark.createDataFrame([("i1", "c.py", "r", "run", "b.py", 1), ("i2", "c.py", "b", None, "b.py", 2), ("i3", "c.py", None, None, "b.py", 3)], "id string, file string, local_name string, imported_name string, resolved_file string, line int")
    calls = spark.createDataFrame([("1", "a.py", "run", None), ("2", "c.py", "r", None), ("3", "c.py", "go", "b"), ("4", "a.py", "nope", "Box"), ("5", "c.py", "nope", None), ("6", "c.py", None, None)], "id string, file string, callee_text string, object_text string")
    got = {r.id: (r.target, r.score) for r in resolve.call_targets(calls, imports, symbols).collect()}
    assert got == {"1": ("a.py::run", 98.0), "2": ("b.py::run", 95.0), "3": ("b.py::go", 40.0), "4": ("a.py::Box", 98.0), "5": (None, 0.0), "6": (None, 0.0)}
    inner = spark.createDataFrame([("s", "f", "outer", 1, 9, True, False), ("t", "f", "inner", 3, 4, True, False)], SYM)
    at = spark.createDataFrame([("p", "f", 3), ("q", "f", 20)], "id string, file string, line int")
    assert {r.id: r.enclosing for r in resolve.enclosing(at, inner).collect()} == {"p": "f::outer", "q": None}
    assert {r.id: r.enclosing for r in resolve.enclosing(at, inner, innermost=True).collect()} == {"p": "f::inner", "q": None}


def test_unique_handlers(spark):
    symbols = spark.createDataFrame([("1", "a", "h", 1, 1, True, False), ("2", "b", "h", 1, 1, True, False), ("3", "b", "k", 1, 1, True, False)], SYM)
    routes = spark.createDataFrame([("r1", "a", "h"), ("r2", "c", "h"), ("r3", "c", "k"), ("r4", "c", "gone")], "id string, file string, handler string")
    assert {r.id: r.handler_file for r in resolve.unique_handlers(routes, symbols).collect()} == {"r1": "a", "r2": None, "r3": "b", "r4": None}


@pytest.mark.parametrize(
    ("lang", "source", "file", "target"),
    [
        ("python", ".util", "r/pkg/a.py", "r/pkg/util.py"), ("python", "..lib.x", "r/pkg/a.py", "r/lib/x.py"), ("python", "pkg", "r/z.py", "r/pkg/__init__.py"), ("typescript", "./w", "r/src/a.ts", "r/src/w.tsx"),
        ("typescript", "@/k", "r/src/deep/a.ts", "r/src/k/index.ts"), ("rust", "crate::m::f", "r/src/x.rs", "r/src/m.rs"), ("rust", "super::n", "r/src/d/x.rs", "r/src/n/mod.rs"), ("c", "h.h", "r/src/x.c", "r/inc/h.h"),
        ("go", "example.com/q/store", "r/main.go", "r/store/a.go"), ("python", "numpy", "r/z.py", None), ("java", "a.B", "r/B.java", None),
    ],
)
def test_import_targets(spark, lang, source, file, target):
    have = ["r/pkg/util.py", "r/lib/x.py", "r/pkg/__init__.py", "r/src/w.tsx", "r/src/k/index.ts", "r/src/m.rs", "r/src/n/mod.rs", "r/inc/h.h", "r/store/a.go", "r/store/b.go"]
    imports = spark.createDataFrame([("i", file, lang, source)], "id string, file string, language string, source string")
    assert resolve.import_targets(imports, spark.createDataFrame([(x,) for x in have], "path string")).first().target == target


def test_reach_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d"), ("d", None), ("x", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reach(edges, start, 5).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.reach(edges, start, 1).collect()} == {"b"}
    assert {r.node for r in graph.on_cycles(edges).collect()} == {"a", "b", "c"}
    assert graph.on_cycles(edges.limit(0)).count() == 0


def test_dead_symbols(spark):
    symbols = spark.createDataFrame([("1", "a", "used", 1, 2, False, False), ("2", "a", "idle", 3, 4, False, False), ("3", "a", "shown", 5, 6, True, False), ("4", "a", "test_x", 7, 8, False, True), ("5", "a", "said", 9, 9, False, False), ("6", "a", "main", 10, 11, False, False)], SYM)
    used = spark.createDataFrame([("used",)], "name string")
    mentions = spark.createDataFrame([("said", "b", 1), ("idle", "a", 3)], "name string, file string, line int")
    assert {r.name: r.confidence for r in graph.dead_symbols(symbols, used, mentions).collect()} == {"idle": 90, "shown": 75}


def test_budget_against_a_plain_fold(spark):
    sizes = [5, 5, 900, 7, 0, 3, 3, 3, 80, 12, 1, None, 2, 2, 2, 2]
    items = spark.createDataFrame([("g", i, n, "clash") for i, n in enumerate(sizes)], "g string, id int, n int, used string")
    used, want = 0, set()
    for i, n in enumerate(sizes):
        if n is not None and used + n <= 30:
            used += n
            want.add(i)
    got = budget.greedy_fill(items, "g", [F.col("id")], "n", "id", F.lit(30))
    assert {r.id for r in got.collect()} == want


def test_diff_paths():
    assert context.diff_paths("--- a/x\n+++ b/main.rs\n@@\n+++ b/lib.rs\n+++ b/main.rs\n") == ["main.rs", "lib.rs"]


def test_documents(spark):
    rows = [("r/a.md", "---\ntitle: T\ntags: [x, y]\nrelated_code: [s.rs, gone.rs]\n---\n# Head\nsee [[b]] `run`"), ("r/b.md", "# run it\n#t"), ("r/c.md", "---\n: bad: [\n---\n"), ("r/d.md", None)]
    frame = spark.createDataFrame(rows, "path string, text string")
    front = docs.frontmatter(frame, "path", "text")
    nodes = docs.nodes(frame, front)
    got = {r.path: (r.title, r.tags) for r in nodes.collect()}
    assert got == {"r/a.md": ("T", ["x", "y"]), "r/b.md": ("run it", ["t"]), "r/c.md": ("c", []), "r/d.md": ("d", [])}
    assert ("doc:r/a.md", "doc:b", "LINKS_TO") in {tuple(r) for r in docs.edges(nodes).collect()}
    symbols = spark.createDataFrame([("1", "s.rs", "run", 1, 2, True, False)], SYM)
    bridge = docs.bridge(nodes, front, spark.createDataFrame([("s.rs",)], "path string"), symbols)
    assert {(r.to_id, r.edge_type) for r in bridge.where("from_id = 'doc:r/a.md'").collect()} == {("s.rs", "DOC_DESCRIBES_CODE"), ("gone.rs", "DOC_MAY_BE_STALE")}
    assert {(r.to_id, r.edge_type) for r in bridge.where("from_id = 'doc:r/b.md'").collect()} == {("s.rs::run", "DOC_REFERENCES_SYMBOL")}


def test_updates(spark, tmp_path):
    facts = "id string, file string, n int"
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1), ("3", "c", 1)], facts)
    fresh = spark.createDataFrame([("4", "a", 2), ("5", "d", 2), ("6", "c", 9)], facts)
    changes = incremental.file_changes(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string"), spark.createDataFrame([("a", "2"), ("c", "1"), ("d", "1")], "path string, hash string"))
    assert {(r.path, r.status) for r in changes.collect()} == {("a", "modified"), ("b", "deleted"), ("d", "added")}
    assert {r.id for r in incremental.merge_facts(old, fresh, changes).collect()} == {"3", "4", "5"}
    assert {(r.id, r.n) for r in incremental.upsert(old, spark.createDataFrame([("1", "a", 7)], facts), ["id"]).collect()} == {("1", 7), ("2", 1), ("3", 1)}
    incremental.write_snapshot(old, str(tmp_path), "v1")
    assert incremental.read_snapshot(spark, str(tmp_path), "v1").count() == 3
    pairs = spark.createDataFrame([("p", "a\nb\nc", "a\nx\nc"), ("q", "s", "s"), ("r", None, "n")], "path string, old_text string, new_text string")
    assert {(r.path, r.old_start, tuple(r.removed), tuple(r.added)) for r in incremental.text_diff(pairs, "path").collect()} == {("p", 2, ("b",), ("x",)), ("r", 1, (), ("n",))}


def test_sessions_and_limits(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, "u", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 61, 62, 200])]
    events = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp")
    assert sorted(r.n_events for r in watch.sessions(events, "ts", "user_id", "10 seconds").collect()) == [1, 2, 4]
    got = {r.event_id: r.admitted for r in watch.admit(events, "ts", "user_id", "event_id", 3, 60.0).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    events.withColumn("path", F.lit("a.rs")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = watch.debounced(stream, "ts", "path", "10 seconds", "1 second").writeStream.outputMode("append").format("memory").queryName("debounced").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("debounced").count() == 2


def test_scan_and_globs(spark, tmp_path):
    import re

    rx = re.compile(scan.glob_regex(["**/*.{rs,py}", "docs/*"]))
    assert [bool(rx.match(x)) for x in ("a.rs", "x/y/a.py", "docs/a", "docs/x/a", "a.rsx")] == [True, True, True, False, False]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}")
    (tmp_path / "b.png").write_bytes(b"\x00")
    (tmp_path / "README.md").write_text("# x")
    got = {r.path: (r.kind, r.language, r.size) for r in scan.scan(spark, str(tmp_path), exclude=["**/*.txt"]).collect()}
    assert got == {"src/a.rs": ("code", "rust", 12), "README.md": ("docs", "markdown", 3)}


def test_manifests(spark):
    rows = [("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\nx = {version = "2"}'), ("web/package.json", '{"dependencies": {"a": "^1"}}'), ("web/sub/go.mod", "require example.com/m v1.2.3"), ("bad/package.json", "{"), ("r/requirements.txt", "numpy>=1.2\n# no\nplain")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.source, r.name, r.version, r.kind) for r in manifests.dependencies(files).collect()}
    assert got == {("Cargo.toml", "serde", "1", "runtime"), ("Cargo.toml", "x", "2", "dev"), ("web/package.json", "a", "^1", "runtime"), ("web/sub/go.mod", "example.com/m", "v1.2.3", "runtime"), ("r/requirements.txt", "numpy", "1.2", "runtime"), ("r/requirements.txt", "plain", None, "runtime")}
    projects = manifests.subprojects(files)
    assert {(r.root, r.kind) for r in projects.collect()} == {("", "cargo"), ("web", "npm"), ("bad", "npm")}
    owned = {r.path: r.root for r in manifests.owners(spark.createDataFrame([("web/x/y.ts",), ("z.rs",)], "path string"), projects).collect()}
    assert owned == {"web/x/y.ts": "web", "z.rs": ""}


def test_vector_store(spark, tmp_path):
    records = [("a", "doc", "täxt", [0.5, -1.0], "h"), ("b", "symbol", "", [], "")]
    data = vectors.encode(records)
    assert vectors.decode(data) == records
    with pytest.raises(Exception):
        vectors.decode(data[:-3])
    (tmp_path / "v.bin").write_bytes(data)
    assert [r.id for r in vectors.read_store(spark, str(tmp_path / "v.bin")).orderBy("id").collect()] == ["a", "b"]
