"""Scalar expressions and search."""

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import search


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def test_lines_and_words(spark):
    assert one(spark, "a\r\nb\n", T.lines) == ["a", "b"]
    assert one(spark, "", T.lines) == [""]
    assert one(spark, None, T.lines) is None
    assert one(spark, "let x_1 = f(y);", T.words) == ["let", "x_1", "f", "y"]


def test_token_estimates(spark):
    assert one(spark, "12345", T.estimated_tokens) == 2
    assert one(spark, "", T.estimated_tokens) == 0
    assert one(spark, "éé", T.estimated_tokens_of_bytes) == 1


def test_keyword_score(spark):
    score = lambda v: one(spark, v, lambda c: T.keyword_score(c, "vector store"))
    assert [score(x) for x in ("Vector Store", "my vector store", "vector", "none", None)] == [1.0, 0.7, 0.5, 0.0, 0.0]


def test_confidence(spark):
    label = lambda v: one(spark, v, T.confidence_label, "double")
    assert [label(x) for x in (95.0, 94.9, 60.0, 35.0, 0.9, -3.0, 250.0, float("nan"))] == ["exact", "high", "medium", "low", "unresolved", "unresolved", "exact", "unresolved"]


def test_cosine(spark):
    sim = lambda a, b: one(spark, a, lambda c: T.cosine(c, F.lit(b)), "array<float>")
    assert sim([1.0, 0.0], [1.0, 0.0]) == 1.0
    assert sim([1.0, 0.0], [0.0, 1.0]) == 0.0
    assert sim([1.0], [1.0, 2.0]) == 0.0
    assert sim([0.0, 0.0], [1.0, 2.0]) == 0.0


def test_markdown(spark):
    assert one(spark, "see [[a|b c]] and [[ d ]] and [[open", lambda c: T.wiki_links(c).cast("array<struct<t:string,a:string>>")) == [("a", "b c"), ("d", None)]
    assert one(spark, "x #tag/one, #b! # no", T.hash_tags) == ["tag/one", "b"]
    assert [tuple(h) for h in one(spark, "# A\ntext\n###B\n####### no", T.headings)] == [(1, "A", 1), (3, "B", 3)]
    assert [tuple(x) for x in one(spark, "[a](u) [[w]] ![i](p)", T.markdown_links)] == [("a", "u"), ("i", "p")]


def test_search(spark):
    files = spark.createDataFrame([("f", "aaa foo\nbar Foo\nfoobar\nx\ny\nz"), ("g", None)], "path string, text string")
    table = search.line_table(files, "path", "text")
    assert [r.line for r in search.find_literal(table, "FOO").orderBy("line").collect()] == [1, 2, 3]
    assert [r.line for r in search.find_literal(table, "foo", whole_word=True).collect()] == [1]
    assert [r.byte_column for r in search.overlapping(table.where("line = 1"), "aa").collect()] == [1, 2]
    assert [r.match_text for r in search.find_regex(table, "o+b").collect()] == ["oob"]
    assert search.replace_preview(table, "(f)oo", "$1", literal=False).count() == 2
    assert search.replace_apply(table, "path", "foo", "x").first().text == "aaa x\nbar Foo\nxbar\nx\ny\nz"
    assert sorted((r.line, r.is_hit) for r in search.with_context(table, F.contains("content", F.lit("x")), "path", 1).collect()) == [(3, False), (4, True), (5, False)]


def test_many_lines(spark):
    files = spark.createDataFrame([("f", "word\n" * 10_000)], "path string, text string")
    assert search.find_literal(search.line_table(files, "path", "text"), "word").count() == 10_000


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "id string, score double")
    b = spark.createDataFrame([("x", 3.0), ("z", 2.0)], "id string, score double")
    got = {r.id: r.score for r in search.fuse([a, b], "id", 5).collect()}
    assert abs(got["x"] - 2 / 61) < 1e-7 and abs(got["y"] - 1 / 62) < 1e-7
