"""Texts of source files against the grammars of all supported languages.

Languages are ranked by the share of a text's tokens that are words of theirs;
then the text is parsed by each grammar in that order.  The stated language
accepting it makes it valid; another one accepting it tells a wrong extension;
none accepting it is damage: an unfinished merge, a text that is cut off, or
plain corruption.  Python, JSON and XML are parsed in full; the grammars of the other
languages are lexers with strings, comments and balanced brackets, and need a
word of the language in the text.
"""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: words that tell languages apart
WORDS = {
    "python": "def import from class return self None elif lambda yield except pass with",
    "rust": "fn let mut impl pub struct enum match use crate trait mod where",
    "go": "func package import var type struct interface chan defer go range map",
    "javascript": "function const let var return require export import new typeof undefined",
    "typescript": "interface type const let export import readonly implements enum string number function",
    "java": "public class private static void import package extends implements final new",
    "csharp": "using namespace public class private static void string var async get set",
    "cpp": "include namespace template class public std const void return using nullptr",
    "c": "include define int char void struct static return const typedef unsigned",
    "kotlin": "fun val var class object package import override when data",
    "swift": "func let var import struct class guard extension protocol init",
}
MARKS = re.compile(r"(?m)^(<<<<<<<( |$)|=======$|>>>>>>>( |$)|\|\|\|\|\|\|\|( |$))")
_TOKEN = re.compile(r"[A-Za-z_]+")
_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_PAIRS = {")": "(", "]": "[", "}": "{"}


def ranked(text: str) -> list[str]:
    """Languages by the share of the text's tokens that are theirs, data formats by the first character."""
    found = _TOKEN.findall(text)
    share = {k: sum(t in s for t in found) / max(1, len(found)) for k, s in _SETS.items()}
    start = text.lstrip()[:1]
    first = ["json"] if start in ("{", "[") else ["xml"] if start == "<" else []
    return first + sorted(share, key=lambda k: (-share[k], k)) + [x for x in ("json", "xml") if x not in first]


def _accepted(parse: Callable[[str], object], text: str) -> bool:
    try:
        parse(text)
    except (SyntaxError, ValueError, RecursionError, ET.ParseError):
        return False
    return True


def _lexed(text: str, language: str) -> bool:
    rest = _SKIP.sub(" ", text if language != "rust" else re.sub(r"'(?=[a-z_]+\b[^'])", " ", text))
    stack: list[str] = []
    for c in rest:
        if c in "([{":
            stack.append(c)
        elif c in _PAIRS and (not stack or stack.pop() != _PAIRS[c]):
            return False
    return not stack and "/*" not in rest and '"' not in rest and not MARKS.search(text) and any(t in _SETS[language] for t in _TOKEN.findall(rest))


def parses(text: str, language: str) -> bool:
    """Whether the grammar of a language accepts a text; blank texts are accepted by all."""
    if not text.strip():
        return True
    whole = {"python": ast.parse, "json": json.loads, "xml": ET.fromstring}.get(language)
    return _accepted(whole, text) if whole else _lexed(text, language) if language in _SETS else False


def judge_text(text: str | None, language: str) -> tuple[str, str | None]:
    """``status`` and the foreign language, if any: valid, foreign, conflict, truncated or corrupt; null counts as blank."""
    text = text or ""
    if parses(text, language):
        return "valid", None
    if MARKS.search(text):
        return "conflict", None
    known = _SETS.get(language, frozenset())
    own = sum(t in known for t in _TOKEN.findall(text))
    for other in ranked(text):
        # of lexed grammars, one is only foreign if its words outnumber those of the stated language
        if other != language and parses(text, other) and (other in ("python", "json", "xml") or sum(t in _SETS[other] for t in _TOKEN.findall(text)) > own):
            return "foreign", other
    opened = sum(text.count(c) for c in "([{") > sum(text.count(c) for c in ")]}")
    return ("truncated" if opened or re.search(r"[=,(\[{:+]\s*$", text) else "corrupt"), None


def judge_sources(files: DataFrame) -> DataFrame:
    """``path, status, foreign_language`` of ``files(path, language, text)``, languages by their usual names."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *judge_text(t, g)) for p, g, t in zip(pdf.path, pdf.language, pdf.text, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "status", "foreign_language"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, status string, foreign_language string")
