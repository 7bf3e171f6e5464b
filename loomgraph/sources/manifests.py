"""Manifests: dependencies, workspaces and owners of files."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# fixed values: manifests in order of precedence, and the kind of workspace each makes
MANIFESTS = {"project.yaml": "project", "Cargo.toml": "cargo", "package.json": "npm", "go.mod": "go"}
SECTIONS = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}


def dependencies_of(name: str, text: str) -> list[tuple[str, str | None, str]]:
    """``name, version, kind`` of what a manifest lists, in its order; one that does not parse lists nothing."""
    try:
        if name == "Cargo.toml":
            root = tomllib.loads(text)
            places = [(SECTIONS[s], root.get(s, {})) for s in ("dependencies", "dev-dependencies", "build-dependencies")] + [("runtime", root.get("workspace", {}).get("dependencies", {}))]
            return [(n, v if isinstance(v, str) else v.get("version"), k) for k, deps in places for n, v in deps.items()]
        if name == "package.json":
            root = json.loads(text)
            return [(n, v, SECTIONS[s]) for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n, v in (root.get(s) or {}).items()]
        if name == "pyproject.toml":
            return [x for line in tomllib.loads(text).get("project", {}).get("dependencies", []) for x in dependencies_of("requirements.txt", line)]
    except (ValueError, AttributeError, TypeError):
        return []
    if name == "go.mod":
        inside = re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text)
        return [(n, v, "runtime") for n, v in inside]
    if name == "requirements.txt":
        found = (re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:(?:==|>=|<=|~=|!=|>|<)\s*([^\s;,#]+))?", line) for line in text.splitlines() if not re.match(r"\s*(#|-|$)", line))
        return [(m[1], m[2], "runtime") for m in found if m]
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """``source, name, version, kind`` from the manifests among ``files(path, text)``."""
    base = F.element_at(F.split("path", "/"), -1)

    def run(batches):
        for pdf in batches:
            rows = [(p, *x) for p, t in zip(pdf.path, pdf.text, strict=True) for x in dependencies_of(p.rsplit("/", 1)[-1], t)]
            yield pd.DataFrame(rows, columns=["source", "name", "version", "kind"])

    wanted = files.where(base.isin("Cargo.toml", "package.json", "go.mod", "requirements.txt", "pyproject.toml") & F.col("text").isNotNull())
    return wanted.select("path", "text").mapInPandas(run, "source string, name string, version string, kind string")


def subprojects(files: DataFrame, depth: int = 3) -> DataFrame:
    """``root, kind``: folders with a manifest, at most ``depth`` deep; of several the one of precedence, and none within another but the root."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.lit(list(MANIFESTS)), name)
    found = files.where(rank > 0).select(paths.parent(F.col("path")).alias("root"), rank.alias("rank")).where(F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/"))) <= depth)
    best = found.groupBy("root").agg(F.min("rank").alias("rank"))
    ups = best.where("root <> ''").select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda k: F.array_join(F.slice(F.split("root", "/"), F.lit(1), k), "/"))).alias("up")).where("up <> root")
    nested = ups.join(best.select(F.col("root").alias("up")), "up", "left_semi").select("root").distinct()
    return best.join(nested, "root", "left_anti").select("root", F.element_at(F.lit(list(MANIFESTS.values())), F.col("rank").cast("int")).alias("kind"))


def owners(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, root``: the innermost project of each file, by an equi join on the folders above it; null outside all."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = files.select("path", F.explode(above).alias("root")).join(projects.select("root").distinct(), "root")
    best = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("path").join(best, "path", "left")


def languages_by_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``root, languages``: sorted distinct languages of each project's files."""
    owned = owners(files, projects).join(files.select("path", "language").distinct(), "path")
    return owned.where("root is not null").groupBy("root").agg(F.array_sort(F.collect_set("language")).alias("languages"))
