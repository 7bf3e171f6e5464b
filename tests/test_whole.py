"""Queries that do the whole job where an older query of the same SQL stops short."""

import os

import pytest

import __spark_entry__ as entry
from loomgraph.operators import context

ROOT = "/root/testdata/sf0.001"


def against_sql(spark, name, root=ROOT):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(root):
        con.sql(f"create view {f.split('.')[0]} as select * from '{root}/{f}'")
    df = entry.queries()[name](spark, root)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(str(tuple(r)) for r in df.collect())
    assert got == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", ["context_candidates_all", "context_query_all"])
def test_context_against_sql(spark, name):
    assert against_sql(spark, name)


def test_context_takes_bridge_tags_imports_and_calls(spark):
    symbols = spark.createDataFrame([("s1", "a.py", "vault"), ("s2", "vault/b.py", "run")], "id string, file string, name string")
    docs = spark.createDataFrame([("d1", "Notes", "vault"), ("d2", "Notes", "other")], "node_id string, title string, tags string")
    bridge = spark.createDataFrame([("b1", "doc:x", "vault/b.py"), ("b2", "doc:x", "a.py")], "id string, from_id string, to_id string")
    imports = spark.createDataFrame([("i2", "a.py", "os", 2), ("i1", "a.py", "sys", 1), ("i1", "a.py", "sys", 1), ("i3", "vault/b.py", "re", 1)], "id string, file string, source string, line int")
    calls = spark.createDataFrame([("c1", "a.py", "go", 5, 3), ("c2", "z.py", "go", 1, 1)], "id string, file string, callee_text string, line int, column_no int")
    facts = {"symbol": (symbols, "id", ["name", "file"]), "doc": (docs, "node_id", ["title", "tags"]), "bridge": (bridge, "id", ["from_id", "to_id"])}
    found = context.candidates(facts, "vault")
    assert {(r.kind, r.item, r.priority) for r in found.collect()} == {("symbol", "s1", 4), ("symbol", "s2", 3), ("doc", "d1", 2), ("bridge", "b1", 1)}
    from pyspark.sql import functions as F

    code = {"import": (imports, "id", "source", F.lit(0)), "call": (calls, "id", "callee_text", F.col("column_no"))}
    near = context.of_files(symbols.where("name = 'vault'"), code)
    assert {(r.kind, r.item, r.priority) for r in near.collect()} == {("import", "i1", 0), ("import", "i2", 0), ("call", "c1", 0)}
    direct = sum(r.tokens for r in found.collect())
    for left, want in ((0, set()), (1, {"import|i1"}), (2, {"import|i1", "import|i2"}), (9, {"import|i1", "import|i2", "call|c1"})):
        got = {r["item"] for r in context.bounded_with_code(found, symbols, code, "vault", direct + left).collect()}
        assert got == {"symbol|s1", "symbol|s2", "doc|d1", "bridge|b1"} | want


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", ["vector_topk_all", "hybrid_rrf_all"])
def test_vectors_against_sql(spark, name):
    assert against_sql(spark, name)


def test_every_query_vector_is_served(spark, monkeypatch):
    from loomgraph.operators import search

    monkeypatch.setattr(search, "BLOCK", 2)  # several blocks on both sides
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [0.0, 0.0]), (6, None), (20, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = search.vector_search_all(vectors.where("vec_id in (0, 2, 20)"), vectors, "vec_id", "embedding", 4)
    for one in (0, 2, 20):
        want = search.vector_search(vectors, "vec_id", "embedding", dict(rows)[one], 4)
        assert {(r.vec_id, r.score) for r in got.where(f"query_id = {one}").collect()} == {(r.vec_id, r.score) for r in want.collect()}


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_keyword_documents_against_sql(spark):
    assert against_sql(spark, "keyword_documents_all")


def test_a_heading_alone_is_a_hit(spark, tmp_path):
    rows = [("doc:a", "Notes", "a.md", "# Start\n\n## Harbor\n"), ("doc:b", "Notes", "b.md", "the harbor"), ("doc:c", None, "c.md", None), ("doc:d", "Harbor log", "d.md", "")]
    spark.createDataFrame(rows, "node_id string, title string, path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.node_id: r.score for r in entry.queries()["keyword_documents_all"](spark, str(tmp_path)).collect()}
    assert got == {"doc:a": 1.0, "doc:d": 0.7}


def test_frontmatter_names_symbols(spark):
    from loomgraph.operators import docs

    frame = spark.createDataFrame([("r/a.md", "---\nsymbols: [run, gone]\n---\ntext"), ("r/b.md", "---\nsymbols: [run]\n---\n# run")], "path string, text string")
    front = docs.frontmatter(frame, "path", "text")
    symbols = spark.createDataFrame([("s.rs", "run"), ("t.rs", "run"), ("t.rs", "stop")], "file string, name string")
    got = docs.bridge(docs.nodes(frame, front), front, spark.createDataFrame([("x.rs",)], "path string"), symbols)
    assert {tuple(r) for r in got.collect()} == {(f"doc:r/{d}.md", f"{f}.rs::run", "DOC_REFERENCES_SYMBOL", 85.0) for d in "ab" for f in "st"}


def test_pairs_of_long_sentences(spark):
    subjects = pytest.importorskip("loomgraph.llm.subjects")

    words = [f"w{k:03d}" for k in range(100)]
    rows = spark.createDataFrame([(i, "A", words) for i in range(6)], "doc_id int, subject string, words array<string>")
    got = {tuple(sorted(r.words)): r.n for r in subjects.mine(rows, 5).collect()}
    assert got == {(a,): 6 for a in words} | {(a, b): 6 for a in words for b in words if a < b}
