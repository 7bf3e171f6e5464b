"""Path expressions, all built-in and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest(path: Column) -> Column:
    """The shortest spelling of a path: forward slashes, no empty, ``.`` or ``..`` part.

    ``..`` above the root is dropped; a null stays null; letter case is kept.
    Only paths that need it pay for the fold over their parts.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.split(slashed, "/")
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(empty))
            .otherwise(F.array_append(kept, part))
        )

    folded = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(slashed.rlike(r"(^|/)\.{0,2}(/|$)"), folded).otherwise(slashed)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def symbol_key(key: Column) -> Column:
    """``file::name`` with the file in its shortest spelling."""
    cut = F.instr(key, "::")
    return F.when(cut > 0, F.concat(shortest(F.substring(key, F.lit(1), cut - 1)), F.substring(key, cut, F.length(key)))).otherwise(shortest(key))
