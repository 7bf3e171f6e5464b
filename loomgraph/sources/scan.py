"""Files from disk: scanning, kinds, languages and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# fixed values: languages by extension
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql", "sh": "shell",
}
DOCS, CONFIG = ("markdown",), ("json", "yaml", "toml")
# fixed values: extensions of files that are no text
BINARY = (
    "png jpg jpeg gif bmp ico webp svgz pdf zip gz tar bz2 xz 7z rar exe dll so dylib a o obj lib bin class jar war pyc wasm mp3 mp4 avi mov wav flac ogg ttf otf woff woff2 eot db sqlite"
).split()


def glob_regex(globs: list[str]) -> str:
    """One expression for any of the globs: ``**/`` any directories, ``*`` and ``?`` within one, ``{a,b}`` either.  No globs match all."""

    def one(glob: str) -> str:
        out, i, depth = "", 0, 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            else:
                c = glob[i]
                if c == "{":
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
                i += 1
        return out

    return "^(?:" + "|".join(map(one, globs)) + ")$" if globs else ""


def ignored(path: Column, rules: str) -> Column:
    """Whether an ignore file at the root leaves a path out: the last rule that matches decides, ``!`` takes back.

    A rule with a slash before its end holds from the root, any other at every
    depth; what is below an ignored folder is ignored.  Blank lines and comments are no rules.
    """
    out = F.lit(False)
    for line in rules.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        start = "^" if "/" in rule else "(^|/)"
        inner = glob_regex([rule.lstrip("/")]).removeprefix("^").removesuffix("$")
        out = F.when(path.rlike(f"{start}{inner}{'/' if folder else '(/|$)'}"), F.lit(not back)).otherwise(out)
    return out


def detected_language(path: Column) -> Column:
    """Language by extension, ``unknown`` for any other."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[paths.extension(path)], F.lit("unknown"))


def file_kind(path: Column) -> Column:
    """``docs``, ``config``, ``code`` or ``unknown``."""
    lang = detected_language(path)
    return F.when(lang == "unknown", "unknown").when(lang.isin(*DOCS), "docs").when(lang.isin(*CONFIG), "config").otherwise("code")


def is_binary(path: Column) -> Column:
    return paths.extension(path).isin(*BINARY)


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, ignore: str | None = None) -> DataFrame:
    """``path, kind, language, hash, size, modified, content`` of the text files below ``root``.

    Globs, the rules of an ignore file and the binary filter are put to the path; of the columns only those
    used are read, so a scan for names alone reads no content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/", "")
    keep = ~is_binary(F.col("rel")) & ~F.col("rel").rlike(r"(^|/)\.git/")
    if include:
        keep &= F.col("rel").rlike(glob_regex(include))
    if exclude:
        keep &= ~F.col("rel").rlike(glob_regex(exclude))
    if ignore:
        keep &= ~ignored(F.col("rel"), ignore)
    c = F.col("rel")
    out = raw.withColumn("rel", rel).where(keep)
    return out.select(c.alias("path"), file_kind(c).alias("kind"), detected_language(c).alias("language"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def by_kind(files: DataFrame) -> dict[str, DataFrame]:
    """Documents, code and configuration; unknown files are in none."""
    return {k: files.where(F.col("kind") == k) for k in ("docs", "code", "config")}
