"""Facts from source texts: symbols, imports, calls, routes, type relations, bindings, decorators, macros.

Python is read with its own parser.  Other languages are read by patterns over
text whose comments (and, but for routes and imports, strings) are blanked; that finds
declarations as they are usually written, not every form a full parser knows.
A file that fails yields one ``diagnostic`` row and never stops the others.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, language string, fact string, kind string, name string, target string, line int, line_end int, detail map<string,string>"
Row = tuple[str, str, str, str | None, int, int, dict[str, str]]
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
_extractors: dict[str, list[Callable[[str, str, str], Iterator[Row]]]] = {}


def extractor(*languages: str) -> Callable:
    """Register a function of path, language and text that yields fact rows; several may serve one language."""

    def add(f: Callable) -> Callable:
        for x in languages:
            _extractors.setdefault(x, []).append(f)
        return f

    return add


def extract(files: DataFrame) -> DataFrame:
    """All facts of ``files(path, language, text)``; null texts and other languages have none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, text in zip(pdf.path, pdf.language, pdf.text, strict=True):
                rows += facts_of(path, lang, text)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.where("path is not null and text is not null").select("path", "language", "text").mapInPandas(run, SCHEMA)


def facts_of(path: str, language: str, text: str) -> list[tuple]:
    out = []
    for f in _extractors.get(language, []):
        try:
            out += [(path, language, *row) for row in f(path, language, text)]
        except (SyntaxError, ValueError, RecursionError) as e:
            out.append((path, language, "diagnostic", type(e).__name__, str(e)[:200], None, getattr(e, "lineno", None) or 0, 0, {}))
    return out


def blank(text: str, language: str, strings: bool) -> str:
    """``text`` with comments, and if asked strings, as blanks of the same length; lines stay lines."""
    comment = r"#[^\n]*" if language == "python" else r"//[^\n]*|/\*.*?\*/"
    string = r'"(?:[^"\\\n]|\\.)*"' + ("" if language in ("rust",) else r"|'(?:[^'\\\n]|\\.)*'") + (r"|`(?:[^`\\]|\\.)*`" if language in ("javascript", "typescript", "go") else "")
    return re.sub(f"({comment})|({string})", lambda m: re.sub(r"[^\n]", " ", m[0]) if m[1] or strings else m[0], text, flags=re.S)


@lru_cache(maxsize=8)
def _line_ends(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def line_of(text: str, at: int) -> int:
    return bisect_left(_line_ends(text), at) + 1


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket at or behind ``at`` closes, or the end of its line."""
    start = text.find(pair[0], at)
    end = text.find("\n", at)
    if start < 0 or (pair == "{}" and ";" in text[at:start]):
        return end if end >= 0 else len(text)
    depth = 0
    for k in range(start, len(text)):
        depth += (text[k] == pair[0]) - (text[k] == pair[1])
        if depth == 0:
            return k
    return len(text)


def split_top(text: str) -> list[str]:
    """Parts at commas outside any bracket."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def type_name(text: str) -> str | None:
    """A type's name without arguments and markers, or None."""
    cut = re.split(r"[<(\[{;]", text.strip(), maxsplit=1)[0]
    cut = re.sub(r"\s+", "", re.sub(r"^(dyn|impl)\s+|^&\s*|[?!]+$", "", cut.strip()))
    return cut if re.fullmatch(r"[\w:.$#]+", cut) else None


# Python


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


@extractor("python")
def python_facts(path: str, language: str, text: str) -> Iterator[Row]:
    tree = ast.parse(text)
    imported = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                imported.add(a.name.split(".")[0])
                yield "import", "import", a.name, a.asname or a.name, n.lineno, n.lineno, {}
        elif isinstance(n, ast.ImportFrom):
            source = "." * n.level + (n.module or "")
            imported.add((n.module or "").split(".")[0])
            for a in n.names:
                yield "import", "from_import", source, a.asname or a.name, n.lineno, n.lineno, {"imported": a.name}
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            yield "symbol", kind, n.name, None, n.lineno, n.end_lineno or n.lineno, {"exported": str(not n.name.startswith("_")).lower(), "test": str(n.name.startswith("test")).lower()}
            for dec in n.decorator_list:
                yield "decorator", "decorator", ast.unparse(dec.func if isinstance(dec, ast.Call) else dec), n.name, dec.lineno, dec.lineno, {"text": ast.unparse(dec)}
        elif isinstance(n, ast.Call):
            obj = ast.unparse(n.func.value) if isinstance(n.func, ast.Attribute) else None
            name = n.func.attr if isinstance(n.func, ast.Attribute) else ast.unparse(n.func)
            yield "call", "method_call" if obj else "function_call", name, obj, n.lineno, n.lineno, {"column": str(n.col_offset)}
    yield from _python_routes(tree, imported)


def _python_routes(tree: ast.AST, imported: set[str]) -> Iterator[Row]:
    web = "fastapi" if "fastapi" in imported else "flask" if "flask" in imported else None
    for n in ast.walk(tree):
        if web and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for dec in n.decorator_list:
                if not (isinstance(dec, ast.Call) and isinstance(dec.func, ast.Attribute)):
                    continue
                words = {k.arg: k.value for k in dec.keywords}
                where = _literal(dec.args[0]) if dec.args else _literal(words.get("path") or words.get("rule"))
                verb = dec.func.attr
                listed = [_literal(x) for x in getattr(words.get("methods"), "elts", [])]
                verbs = [verb] if verb in (*VERBS, "trace") else listed if verb == "api_route" and web == "fastapi" else listed or ["get"] if verb == "route" and web == "flask" else []
                for v in dict.fromkeys(x.upper() for x in verbs if x):
                    if where is not None:
                        yield "route", web, n.name, where, dec.lineno, dec.lineno, {"method": v}
        if "django" in imported and isinstance(n, ast.Call) and ast.unparse(n.func).split(".")[-1] in ("path", "re_path"):
            words = {k.arg: k.value for k in n.keywords}
            where = _literal(n.args[0]) if n.args else _literal(words.get("route"))
            view = n.args[1] if len(n.args) > 1 else words.get("view")
            if where is not None and view is not None and not ast.unparse(view).startswith("include("):
                yield "route", "django", ast.unparse(view), where, n.lineno, n.lineno, {"method": "*"}


# Other languages: patterns of declarations

ID = r"[A-Za-z_$][\w$]*"
SYMBOLS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"\bfn\s+({ID})"), ("struct", rf"\bstruct\s+({ID})"), ("enum", rf"\benum\s+({ID})"), ("trait", rf"\btrait\s+({ID})"), ("type", rf"(?m)^\s*(?:pub\s+)?type\s+({ID})"), ("constant", rf"\bconst\s+({ID})\s*:"), ("module", rf"(?m)^\s*impl(?:<[^>]*>)?\s+({ID})\s*(?:<[^{{]*>)?\s*\{{")],
    "typescript": [("function", rf"\bfunction\s*\*?\s*({ID})"), ("class", rf"\bclass\s+({ID})"), ("interface", rf"\binterface\s+({ID})"), ("type", rf"\btype\s+({ID})[^=\n]*="), ("enum", rf"\benum\s+({ID})"), ("constant", rf"(?m)^\s*(?:export\s+)?const\s+({ID})")],
    "go": [("function", rf"(?m)^func\s+(?:\([^)]*\)\s*)?({ID})"), ("struct", rf"(?m)^type\s+({ID})\s")],
    "c": [("function", rf"(?m)^[A-Za-z_][\w\s*]*?\b({ID})\s*\([^;{{}}]*\)\s*\{{"), ("struct", rf"\bstruct\s+({ID})\s*\{{"), ("enum", rf"\benum\s+({ID})\s*\{{"), ("typedef", rf"\btypedef\b[^;]*?\b({ID})\s*;")],
    "cpp": [("function", rf"(?m)^[A-Za-z_][\w\s*&:<>,]*?\b({ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"), ("class", rf"\bclass\s+({ID})[^;{{]*\{{"), ("struct", rf"\bstruct\s+({ID})[^;{{]*\{{"), ("enum", rf"\benum\s+(?:class\s+)?({ID})"), ("module", rf"\bnamespace\s+({ID})")],
    "csharp": [("class", rf"\b(?:class|record)\s+({ID})"), ("interface", rf"\binterface\s+({ID})"), ("struct", rf"\bstruct\s+({ID})"), ("enum", rf"\benum\s+({ID})"), ("module", rf"\bnamespace\s+([\w.]+)"), ("method", rf"\b(?:public|private|protected|internal)\s[\w\s<>\[\],?]*?\b({ID})\s*\([^;{{}}]*\)\s*(?:\{{|=>)")],
    "java": [("class", rf"\b(?:class|record)\s+({ID})"), ("interface", rf"\binterface\s+({ID})"), ("function", rf"\b(?:public|private|protected|static)\s[\w\s<>\[\],]*?\b({ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{")],
    "kotlin": [("function", rf"\bfun\s+(?:<[^>]*>\s*)?({ID})"), ("class", rf"\b(?:class|object|interface)\s+({ID})")],
    "swift": [("function", rf"\bfunc\s+({ID})"), ("class", rf"\b(?:class|struct|protocol)\s+({ID})")],
}
SYMBOLS["javascript"] = SYMBOLS["typescript"][:2] + SYMBOLS["typescript"][5:]
IMPORTS = {
    "rust": [("rust_use", r"\buse\s+([\w:]+)\s*(?:as\s+(\w+)\s*)?;")],
    "typescript": [("named_import", r"\bimport\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)"), ("default_import", r"\bimport\s+([\w$]+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]([^'\"]+)"), ("namespace_import", r"\bimport\s+\*\s*as\s+([\w$]+)\s*from\s*['\"]([^'\"]+)")],
    "go": [("go_import", r"(?m)^\s*(?:import\s+)?(\w+\s+|\.\s+|_\s+)?\"([\w./-]+)\"\s*$")],
    "c": [("go_import", r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)")],
    "cpp": [("go_import", r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)"), ("go_import", r"\busing\s+(?:namespace\s+)?([\w:]+)\s*;")],
    "csharp": [("go_import", r"(?m)^\s*using\s+([\w.]+)\s*;")],
    "java": [("java_import", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;")],
    "kotlin": [("kotlin_import", r"(?m)^\s*import\s+([\w.]+)")],
    "swift": [("swift_import", r"(?m)^\s*import\s+([\w.]+)")],
}
IMPORTS["javascript"] = IMPORTS["typescript"]
NO_CALL = set("if for while switch return catch function fn func fun match sizeof using lock foreach when guard throw new await typeof else do def class".split())
OTHERS = tuple(SYMBOLS)


@extractor(*OTHERS)
def pattern_facts(path: str, language: str, text: str) -> Iterator[Row]:
    code, plain = blank(text, language, True), blank(text, language, False)
    lines, written = code.split("\n"), text.split("\n")
    declared = set()
    for kind, pattern in SYMBOLS[language]:
        for m in re.finditer(pattern, code):
            at = m.start(1)
            declared.add(at)
            line = line_of(code, at)
            head = lines[line - 1]
            above = written[max(0, line - 3) : line - 1]
            test = language == "rust" and any("#[test" in x or "::test" in x for x in above) or language == "go" and m[1].startswith("Test") and "testing.T" in code[at : at + 200]
            yield "symbol", kind, m[1], None, line, line_of(code, closing(code, at)), {"exported": str(exported(language, m[1], head)).lower(), "visibility": visibility(language, m[1], head), "test": str(bool(test)).lower()}
    for kind, pattern in IMPORTS[language]:
        for m in re.finditer(pattern, plain):
            line = line_of(plain, m.start())
            if kind == "named_import":
                for part in filter(None, (x.strip() for x in m[1].split(","))):
                    a, _, b = part.removeprefix("type ").partition(" as ")
                    yield "import", kind, m[2], (b or a).strip(), line, line, {"imported": a.strip()}
            elif kind in ("default_import", "namespace_import"):
                yield "import", kind, m[2], m[1], line, line, {}
            elif language == "go":
                yield "import", kind, m[2], (m[1] or m[2].rsplit("/", 1)[-1]).strip(), line, line, {}
            else:
                local = m[2] if language == "rust" and m[2] else re.split(r"::|\.|/", m[1])[-1]
                yield "import", kind, m[1], local, line, line, {}
    for m in re.finditer(rf"(?:({ID}(?:(?:\.|::|->){ID})*)(\.|::|->))?({ID})!?\s*\(", code):
        if m[3] in NO_CALL or m.start(3) in declared:
            continue
        new = re.search(r"\bnew\s+$", code[max(0, m.start() - 8) : m.start()])
        kind = "constructor_call" if new else "path_call" if m[2] == "::" else "method_call" if m[1] else "function_call"
        yield "call", kind, m[3], m[1], line_of(code, m.start(3)), line_of(code, m.start(3)), {"column": str(m.start(3) - code.rfind("\n", 0, m.start(3)) - 1)}


def visibility(language: str, name: str, head: str) -> str:
    """``public``, ``protected``, ``internal`` or ``private`` by the words of the declaration or the name."""
    for word in ("private", "protected", "internal", "public"):
        if re.search(rf"\b{word}\b", head):
            return word
    if language == "rust":
        return "internal" if "pub(" in head else "public" if re.search(r"\bpub\b", head) else "private"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language in ("typescript", "javascript"):
        return "public" if re.search(r"\bexport\b", head) else "private"
    if language == "c":
        return "private" if re.search(r"\bstatic\b", head) else "public"
    return {"csharp": "private", "java": "internal", "swift": "internal"}.get(language, "public")


def exported(language: str, name: str, head: str) -> bool:
    return visibility(language, name, head) == "public"


# Type relations and bindings


@extractor("rust", "typescript", "csharp", "java", "kotlin")
def type_relations(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, True)

    def row(kind: str, child: str | None, parent: str, at: int) -> Iterator[Row]:
        p = type_name(parent)
        if child and p:
            yield "type_impl", kind, child, p, line_of(code, at), line_of(code, at), {}

    if language == "rust":
        for m in re.finditer(r"\bimpl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(!?)([^{;]*?)\s+for\s+([^{;]*?)\s*(?:\bwhere\b[^{;]*)?\{", code):
            if not m[1]:
                yield from row("trait_impl", type_name(m[3]), m[2], m.start())
        return
    for m in re.finditer(rf"\b(class|interface|struct|record|object)\s+({ID})", code):
        head = code[m.end() : code.find("{", m.end()) if "{" in code[m.end() :] else len(code)]
        if language in ("csharp", "kotlin"):
            flat, depth, at = "", 0, -1
            for k, c in enumerate(head):
                depth += (c in "<([") - (c in ">)]")
                if c == ":" and depth == 0:
                    at = k
                    break
            if at < 0:
                continue
            flat = re.split(r"\bwhere\b", head[at + 1 :])[0]
            for k, p in enumerate(split_top(flat)):
                yield from row("c_sharp_inheritance" if language == "csharp" else "extends" if k == 0 else "implements", m[2], p, m.start())
            continue
        for word in ("extends", "implements"):
            got = re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S)
            for p in split_top(got[1]) if got else []:
                yield from row(word, m[2], p, m.start())


@extractor("csharp", "typescript")
def bindings(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    if language == "csharp":
        for m in re.finditer(r"\.(?:Try)?Add(Singleton|Scoped|Transient)\s*<", code):
            parts = [type_name(x) for x in split_top(code[m.end() : closing(code, m.end() - 1, "<>")])]
            if len(parts) in (1, 2) and all(parts):
                yield "di", "aspnet", parts[0], parts[-1], line_of(code, m.start()), line_of(code, m.start()), {"lifetime": m[1].lower()}
        return
    scopes = {"DEFAULT": "singleton", "REQUEST": "scoped", "TRANSIENT": "transient"}
    for m in re.finditer(rf"@Injectable\s*\(([^)]*)\)\s*(?:export\s+)?(?:abstract\s+)?class\s+({ID})", code):
        scope = re.search(r"Scope\.(\w+)", m[1])
        life = scopes.get(scope[1]) if scope else "singleton"
        yield "di", "nestjs", m[2], m[2], line_of(code, m.start()), line_of(code, m.start()), {"lifetime": life} if life else {}
    for m in re.finditer(rf"provide\s*:\s*['\"]?({ID})['\"]?\s*,\s*useClass\s*:\s*({ID})", code):
        yield "di", "nestjs", m[1], m[2], line_of(code, m.start()), line_of(code, m.start()), {"lifetime": "singleton"}


@extractor("csharp", "typescript", "javascript", "rust")
def decorators(path: str, language: str, text: str) -> Iterator[Row]:
    pattern = {"csharp": r"^\s*\[(\w[\w.]*)", "rust": r"^\s*#\[(\w[\w:]*)"}.get(language, r"^\s*@(\w[\w.]*)")
    lines = blank(text, language, False).split("\n")
    define = re.compile(rf"\b(?:class|fn|struct|enum|trait|interface|record|function)\s+({ID})|\b({ID})\s*\([^)]*\)\s*[^;]*\{{")
    for k, line in enumerate(lines):
        m = re.match(pattern, line)
        if m:
            target = next((x for x in (define.search(y) for y in lines[k + 1 : k + 6] if not re.match(pattern, y)) if x), None)
            yield "decorator", "decorator", m[1], (target[1] or target[2]) if target else None, k + 1, k + 1, {"text": line.strip()}


@extractor("rust", "c", "cpp")
def macros(path: str, language: str, text: str) -> Iterator[Row]:
    lines = blank(text, language, False).split("\n")
    for k, line in enumerate(lines):
        if language != "rust":
            m = re.match(r"\s*#\s*define\s+(\w+)(\()?", line)
            if m:
                yield "macro", "define", m[1], None, k + 1, k + 1, {"exported": "true"}
            continue
        m = re.match(r"\s*macro_rules!\s*(\w+)", line)
        if m:
            yield "macro", "macro_rules", m[1], None, k + 1, k + 1, {"exported": str(any("#[macro_export" in x for x in lines[max(0, k - 3) : k])).lower()}
        m = re.match(r"\s*#\[proc_macro(_derive|_attribute)?", line)
        f = re.search(r"\bfn\s+(\w+)", " ".join(lines[k + 1 : k + 6])) if m else None
        if f:
            yield "macro", "proc_macro", f[1], None, k + 1, k + 1, {"exported": "true"}


# Routes


def _route(web: str, method: str, where: str, handler: str, code: str, at: int, **detail: str) -> Row:
    return "route", web, handler, where, line_of(code, at), line_of(code, at), {"method": method.upper(), **detail}


def slashed(path: str) -> str:
    return path if path.startswith("/") else "/" + path


STR = r"[\"'`]([^\"'`]*)[\"'`]"
VERB = "|".join(VERBS)


@extractor("rust")
def rust_routes(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    if re.search(r"\buse\s+axum\b|\bextern\s+crate\s+axum\b|\baxum::", code):
        for m in re.finditer(r"\.route\s*\(\s*\"([^\"]*)\"\s*,", code):
            chain = code[m.end() : closing(code, m.start(), "()")]
            for v in re.finditer(rf"\b({VERB})\s*\(\s*([\w:.]+)", chain):
                yield _route("axum", v[1], m[1], v[2], code, m.start())
    for web, crate in (("actix", "actix_web"), ("rocket", "rocket")):
        if re.search(rf"\b{crate}\b", code):
            for m in re.finditer(rf"#\[(?:\w+::)*({VERB})\s*\(\s*\"([^\"]*)\"[^\]]*\]", code):
                f = re.search(r"\bfn\s+(\w+)", code[m.end() : m.end() + 600])
                if f:
                    yield _route(web, m[1], m[2], f[1], code, m.start())


@extractor("go")
def go_routes(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    known = (("gin", r"github\.com/gin-gonic/gin", "New|Default", "Engine|RouterGroup"), ("fiber", r"github\.com/gofiber/fiber(?:/v\d+)?", "New", "App|Router"), ("echo", r"github\.com/labstack/echo(?:/v\d+)?", "New", "Echo|Group"))
    for web, package, makers, types in known:
        got = re.search(rf"(?:(\w+)\s+)?\"{package}\"", code)
        if not got:
            continue
        alias = got[1] if got[1] and got[1] != "import" else web
        receivers = set(re.findall(rf"(\w+)\s*:?=\s*{alias}\.(?:{makers})\(", code)) | set(re.findall(rf"(\w+)\s+\*?{alias}\.(?:{types})\b", code))
        receivers |= set(re.findall(rf"(\w+)\s*:?=\s*(?:{'|'.join(map(re.escape, receivers)) or '$^'})\.Group\(", code))
        for m in re.finditer(rf"(\w+)\.({VERB})\s*\(\s*\"([^\"]*)\"\s*,", code, re.I):
            args = split_top(code[m.end() : closing(code, m.start(), "()")])
            if m[1] in receivers and args and re.fullmatch(r"[\w.]+", args[-1]):
                yield _route(web, m[2], m[3], args[-1], code, m.start())


@extractor("javascript", "typescript")
def script_routes(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    if re.search(r"from\s*['\"]express['\"]|require\(\s*['\"]express['\"]", code):
        for m in re.finditer(rf"\b(\w*(?:app|router))\.({VERB}|all)\s*\(\s*{STR}\s*,", code, re.I):
            args = split_top(code[m.end() : closing(code, m.start(), "()")])
            if "${" not in m[3] and args and re.fullmatch(r"[\w$.]+", args[-1]):
                yield _route("express", m[2], slashed(m[3]), args[-1], code, m.start(), middleware=",".join(a for a in args[:-1] if re.fullmatch(r"[\w$.]+", a)))
    if re.search(r"['\"]@nestjs(?:/[\w-]+)?['\"]", code):
        for m in re.finditer(rf"@Controller\(\s*(?:{STR})?\s*\)", code):
            body = code[m.end() : closing(code, m.end())]
            for v in re.finditer(rf"@({VERB}|all)\(\s*(?:{STR})?\s*\)\s*(?:@\w+\([^)]*\)\s*)*(?:public\s+|async\s+)*(\w+)\s*\(", body, re.I):
                whole = "/".join(x.strip("/") for x in (m[1] or "", v[2] or "") if x.strip("/"))
                yield _route("nestjs", v[1], slashed(whole), v[3], code, m.end() + v.start())
    got = re.search(r"(?:^|/)app/((?!.*/app/).*?)/?route\.(?:jsx?|mjs|tsx?|mts)$", path)
    if got:
        parts = [x for x in got[1].split("/") if x and not re.fullmatch(r"\(.*\)", x)]
        named = [re.sub(r"^\[([^\]]+)\]$", r":\1", re.sub(r"^\[\[?\.\.\.([^\]]+)\]\]?$", r"*\1", x)) for x in parts]
        for m in re.finditer(r"\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", code):
            yield _route("nextjs", m[1], "/" + "/".join(named), m[1], code, m.start())


@extractor("csharp")
def aspnet_routes(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    for m in re.finditer(r"\.Map(Get|Post|Put|Delete|Patch|Head)\s*\(\s*\"([^\"]*)\"\s*,", code):
        args = split_top(code[m.end() : closing(code, m.start(), "()")])
        yield _route("aspnet", m[1], slashed(m[2]), args[0] if args and re.fullmatch(r"[\w.]+", args[0]) else "", code, m.start())
    for m in re.finditer(r"\[Http(Get|Post|Put|Delete|Patch|Head)(?:\(\s*\"([^\"]*)\"[^)]*\))?\s*\](?:\s*\[[^\]]*\])*\s*[^(\n]*?(\w+)\s*\(", code):
        yield _route("aspnet", m[1], slashed(m[2] or ""), m[3], code, m.start())


@extractor("cpp")
def cpp_routes(path: str, language: str, text: str) -> Iterator[Row]:
    code = blank(text, language, False)
    for m in re.finditer(r"^[^#\n]*\bCROW_ROUTE\s*\(\s*\w+\s*,\s*\"([^\"]*)\"\s*\)", code, re.M):
        rest = code[m.end() : code.find(";", m.end())]
        verbs = re.findall(r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|CONNECT|TRACE)\b", rest[: rest.find(")") + 1], re.I) if ".methods" in rest else ["GET"]
        last = re.search(r"\(\s*([\w:&]+)\s*\)\s*$", rest)
        for v in verbs:
            yield _route("crow", v, m[1], last[1].lstrip("&") if last else rest.strip()[:80], code, m.start())
    for m in re.finditer(r"\bADD_METHOD_TO\s*\(\s*([\w:]+)\s*,\s*\"([^\"]*)\"\s*,([^)]*)\)", code):
        for v in re.findall(rf"\b({VERB})\b", m[3], re.I):
            yield _route("drogon", v, m[2], m[1], code, m.start())
    for m in re.finditer(rf"\bRoutes::({VERB})\s*\(\s*\w+\s*,\s*\"([^\"]*)\"\s*,\s*([^;]*)\)\s*;", code, re.I):
        bound = re.search(r"bind\(\s*&?([\w:]+)", m[3])
        yield _route("pistache", m[1], m[2], bound[1] if bound else m[3].strip(), code, m.start())
