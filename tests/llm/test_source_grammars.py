"""Texts against all grammars."""

import pytest

from loomgraph.llm import source_grammars as G


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("python", "def f():\n    return 1\n", ("valid", None)), ("python", "def f(:\n    return (1", ("truncated", None)), ("python", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", ("conflict", None)),
        ("python", '{"a": [1, 2, null]', ("truncated", None)), ("rust", "fn main() { let x = 1; }", ("valid", None)), ("rust", "fn main() { let x = vec![1, ", ("truncated", None)), ("rust", "fn f<'a>(x: &'a str) { }", ("valid", None)),
        ("rust", "import os\ndef f(self):\n    return None\n", ("foreign", "python")), ("go", "<?xml version='1.0'?><a><b/></a>", ("foreign", "xml")), ("java", '{"a": 1}', ("foreign", "json")), ("go", "", ("valid", None)), ("c", None, ("valid", None)), ("c", "int f() } x;", ("corrupt", None)),
    ],
)
def test_judgement(lang, text, want):
    assert G.judge_text(text, lang) == want


def test_frame(spark):
    rows = [("a", "go", 'func f() { return "}" }'), ("b", "go", "func f() {"), ("c", "go", None)]
    got = {r.path: r.status for r in G.judge_sources(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {"a": "valid", "b": "truncated", "c": "valid"}
