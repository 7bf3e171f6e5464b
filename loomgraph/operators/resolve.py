"""Resolving names to definitions: joins with an order of precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .skew import balanced_join

# fixed values: precedence of relation kinds, most telling last
KIND_ORDER = ("implements", "trait_impl", "derive", "extends", "c_sharp_inheritance", "cpp_inheritance")
# lines in a part of a file that ranges are compared in
STRETCH = 200
# fixed values: confidence of each step of the call cascade
SAME_FILE, IMPORTED, PROJECT, OBJECT_IMPORT, LOCAL_OBJECT = 98.0, 95.0, 40.0, 95.0, 98.0


def first_by(df: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key: of the rows, the first in ``order``; by aggregation, so a hot key is combined before the exchange."""
    row = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *[F.col(c) for c in keep])
    return df.groupBy(*key).agg(F.min(row).alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in keep])


def call_targets(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, target, score`` of every call.

    In order: a symbol of the same file; what an import of that name brings;
    any symbol of the project of that name; the name in the file that the
    call's object is imported from; a type of the object's name in the same
    file.  Nothing found gives a null target and score 0.  Null names match
    nothing.
    """
    here = first_by(symbols, ["file", "name"], [F.col("line_start"), F.col("id")], [])
    anywhere = symbols.groupBy("name").agg(F.min(F.concat("file", F.lit("::"), "name")).alias("any_key"))
    bound = first_by(imports.where("local_name is not null and resolved_file is not null and trim(resolved_file) <> ''"), ["file", "local_name"], [F.col("line"), F.col("id")], ["resolved_file", "imported_name"])
    defined = here.select("file", "name", F.concat("file", F.lit("::"), "name").alias("key"))

    def at(df: DataFrame, file: Column, name: Column, out: str) -> DataFrame:
        side = defined.select(F.col("file").alias("df"), F.col("name").alias("dn"), F.col("key").alias(out))
        return df.join(side, (file == F.col("df")) & (name == F.col("dn")), "left").drop("df", "dn")

    one = calls.select("id", "file", "callee_text", "object_text").dropDuplicates(["id"])
    # a few names hold most calls, so this side is shared out by their load
    steps = balanced_join(one, anywhere, "callee_text", "name", ["id"], "left").drop("name")
    steps = at(steps, F.col("file"), F.col("callee_text"), "same_file")
    imp = bound.select(F.col("file").alias("bf"), F.col("local_name").alias("bn"), F.col("resolved_file").alias("imp_file"), F.coalesce("imported_name", "local_name").alias("imp_name"))
    steps = steps.join(imp, (F.col("file") == F.col("bf")) & (F.col("callee_text") == F.col("bn")), "left").drop("bf", "bn")
    steps = at(steps, F.col("imp_file"), F.col("imp_name"), "imported")
    obj = bound.select(F.col("file").alias("of"), F.col("local_name").alias("on"), F.col("resolved_file").alias("obj_file"))
    steps = steps.join(obj, (F.col("file") == F.col("of")) & (F.col("object_text") == F.col("on")), "left").drop("of", "on")
    steps = at(steps, F.col("obj_file"), F.col("callee_text"), "object_import")
    steps = at(steps, F.col("file"), F.col("object_text"), "local_object")
    order = [("same_file", SAME_FILE), ("imported", IMPORTED), ("any_key", PROJECT), ("object_import", OBJECT_IMPORT), ("local_object", LOCAL_OBJECT)]
    score = reduce(lambda acc, s: acc.when(F.col(s[0]).isNotNull(), s[1]), order[1:], F.when(F.col("same_file").isNotNull(), SAME_FILE)).otherwise(0.0)
    return steps.select("id", F.coalesce(*[s for s, _ in order]).alias("target"), score.alias("score"))


def enclosing(points: DataFrame, symbols: DataFrame, innermost: bool = False) -> DataFrame:
    """``id, enclosing`` of every point ``id, file, line``: the first symbol of its file around it, or the innermost one.

    The join is on the file and a stretch of ``STRETCH`` lines, so a point is held
    only against the symbols of its stretch, and a large file is many keys.
    Points outside every symbol get null, and so do those without a line.
    """
    one = points.select("id", F.col("file").alias("pf"), "line").dropDuplicates(["id"]).withColumn("ps", F.floor(F.col("line") / STRETCH))
    spans = symbols.where("line_start <= line_end").select("file", "name", "line_start", "line_end", F.col("id").alias("sid"), F.explode(F.sequence(F.floor(F.col("line_start") / STRETCH), F.floor(F.col("line_end") / STRETCH))).alias("stretch"))
    order = [F.col("line_end") - F.col("line_start")] if innermost else []
    hit = one.join(spans, (F.col("pf") == F.col("file")) & (F.col("ps") == F.col("stretch")) & (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end")))
    return one.select("id").join(first_by(hit, ["id"], [*order, F.col("line_start"), F.col("sid")], ["file", "name"]), "id", "left").select("id", F.concat("file", F.lit("::"), "name").alias("enclosing"))


def unique_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, handler_file`` of routes ``id, file, handler``: the same file, else the only file that defines the handler, else null."""
    files = symbols.select("name", "file").distinct()
    only = files.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("only_file")).where("n = 1")
    own = files.select(F.col("name").alias("own_name"), F.col("file").alias("own_file"))
    joined = routes.join(own, (F.col("handler") == F.col("own_name")) & (F.col("file") == F.col("own_file")), "left").join(only, F.col("handler") == only["name"], "left")
    return joined.select("id", F.coalesce("own_file", "only_file").alias("handler_file"))


def distinct_relations(relations: DataFrame) -> DataFrame:
    """One row per file, type and parent: of repeated relations the kind that says most, then line and id."""
    rank = F.array_position(F.lit(list(KIND_ORDER)), F.col("kind"))
    return first_by(relations, ["file", "implementing_type", "trait_or_interface"], [-rank, F.col("line"), F.col("id")], ["kind", "line", "id"])


def distinct_bindings(bindings: DataFrame, key: list[str]) -> DataFrame:
    """The first binding of each key, in order of file, line and id."""
    rest = [c for c in bindings.columns if c not in key]
    return first_by(bindings, key, [F.col("file"), F.col("line"), F.col("id")], rest)


def code_edges(imports: DataFrame, symbols: DataFrame, calls: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``from_id, to_id, edge_type``: imports of files that exist, definitions, calls and type relations.

    Calls go from the file to the symbol's key.
    """
    have = files.select(F.col("path").alias("to_id")).distinct()
    blank = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    imported = imports.where(blank("resolved_file")).select(F.col("file").alias("from_id"), F.col("resolved_file").alias("to_id"), F.lit("IMPORTS").alias("edge_type")).join(have, "to_id", "left_semi").select("from_id", "to_id", "edge_type")
    defined = symbols.select(F.concat("file", F.lit("::"), "name").alias("from_id"), F.col("file").alias("to_id"), F.lit("DEFINED_IN").alias("edge_type"))
    called = calls.where(blank("resolved_symbol")).select(F.col("file").alias("from_id"), F.col("resolved_symbol").alias("to_id"), F.lit("CALLS").alias("edge_type"))
    related = relations.select(F.col("implementing_type").alias("from_id"), F.col("trait_or_interface").alias("to_id"), F.when(F.col("kind") == "extends", "EXTENDS").otherwise("IMPLEMENTS").alias("edge_type"))
    return reduce(DataFrame.unionByName, [imported, defined, called, related]).distinct()


# Imports to files: candidates per language in order of preference, then one equi join


def import_candidates(language: Column, source: Column, file: Column) -> Column:
    """Paths that an import may mean, the likeliest first; an empty array for what lies outside.

    Paths start with the repository, which is the root that absolute imports
    are taken from.
    """
    repo = F.element_at(F.split(file, "/"), 1)
    here = paths.parent(file)

    def under(base: Column, tail: Column) -> Column:
        return paths.shortest(F.concat(base, F.lit("/"), tail))

    def each(stems: list[Column], endings: list[str]) -> Column:
        return F.array(*[F.concat(s, F.lit(e)) for s in stems for e in endings])

    slash = F.replace(source, F.lit("::"), F.lit("/"))
    rust_tail = F.regexp_replace(slash, r"^(crate|super|self)/", "")
    rust_up = F.regexp_replace(rust_tail, r"/[^/]+$", "")
    rust_base = F.when(source.startswith("crate::"), F.concat(repo, F.lit("/src"))).when(source.startswith("super::"), paths.parent(here)).otherwise(here)
    rust = each([under(rust_base, rust_tail), under(rust_base, rust_up)], [".rs", "/mod.rs"])
    js_base = F.when(source.startswith("@/"), under(F.concat(repo, F.lit("/src")), F.substring(source, F.lit(3), F.length(source)))).when(source.startswith("."), under(here, source))
    js = F.when(js_base.isNotNull(), each([js_base], ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]))
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    module = F.translate(F.regexp_replace(source, r"^\.+", ""), ".", "/")
    up = F.when(dots == 0, repo).when(dots == 1, here).when(dots == 2, paths.parent(here)).otherwise(paths.parent(paths.parent(here)))
    python = F.concat(each([under(up, module)], [".py", "/__init__.py"]), F.when(dots == 0, each([under(F.concat(repo, F.lit("/src")), module)], [".py", "/__init__.py"])).otherwise(F.array().cast("array<string>")))
    c = F.array(under(here, source), under(repo, source), under(F.concat(repo, F.lit("/include")), source), under(F.concat(repo, F.lit("/src")), source))
    none = F.array().cast("array<string>")
    found = F.when(language == "rust", rust).when(language.isin("typescript", "javascript"), js).when(language == "python", python).when(language.isin("c", "cpp"), c)
    return F.coalesce(found, none)


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``id, target`` of every import: the first candidate that is a file.

    Where the exact candidates of a C or C++ include and of a Go import fail,
    the file's base name, or the directory of that name, decides, the least path
    first.  Nothing found gives null.
    """
    one = imports.select("id", "file", "language", "source").dropDuplicates(["id"])
    have = files.select(paths.shortest(F.col("path")).alias("path")).distinct()
    each = one.select("id", F.posexplode(import_candidates(F.col("language"), F.col("source"), F.col("file"))).alias("at", "path"))
    exact = first_by(each.join(have, "path"), ["id"], [F.col("at")], ["path"])
    repo = F.element_at(F.split("file", "/"), 1)
    tail = F.element_at(F.split("source", "/"), -1)
    named = have.select(F.element_at(F.split("path", "/"), 1).alias("r"), F.element_at(F.split("path", "/"), -1).alias("t"), "path").groupBy("r", "t").agg(F.min("path").alias("by_name"))
    folder = have.where("path like '%.go'").select(F.element_at(F.split("path", "/"), 1).alias("gr"), F.element_at(F.split(paths.parent(F.col("path")), "/"), -1).alias("gt"), "path").groupBy("gr", "gt").agg(F.min("path").alias("by_folder"))
    looked = one.withColumns({"repo_": repo, "tail_": tail}).join(exact, "id", "left")
    looked = looked.join(named, F.col("language").isin("c", "cpp") & (F.col("repo_") == F.col("r")) & (F.col("tail_") == F.col("t")), "left")
    looked = looked.join(folder, (F.col("language") == "go") & (F.col("repo_") == F.col("gr")) & (F.col("tail_") == F.col("gt")), "left")
    return looked.select("id", F.coalesce("path", "by_name", "by_folder").alias("target"))
