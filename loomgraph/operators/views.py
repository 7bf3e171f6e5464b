"""Contexts of one file or one symbol, pruned contexts, search views, safety, ordinals and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T

# fixed value: the greatest file that may be edited, in bytes
MAX_EDIT = 10 * 1024 * 1024
LINES_PER_STRETCH = 1000


def _items(kind: str, df: DataFrame, item: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where(F.col("item").isNotNull()).distinct()


def file_context(path: str, facts: dict[str, DataFrame]) -> DataFrame:
    """``kind, item`` of all that concerns one file: what is in it, who imports it and documents on it or its symbols.

    ``facts`` has ``symbols, imports, calls, type_impls, bridge_edges``.  A path
    without facts gives no row; null ids and repeated rows are left out.
    """
    here = F.col("file") == path
    return _all([
        _items("symbol", facts["symbols"].where(here), F.col("id")),
        _items("import", facts["imports"].where(here), F.col("id")),
        _items("call", facts["calls"].where(here), F.col("id")),
        _items("type_impl", facts["type_impls"].where(here), F.col("id")),
        _items("importer", facts["imports"].where(F.col("resolved_file") == path), F.col("file")),
        _items("doc", facts["bridge_edges"].where((F.col("to_id") == path) | F.startswith("to_id", F.lit(path + "::"))), F.col("from_id")),
    ])


def symbol_context(key: str, facts: dict[str, DataFrame]) -> DataFrame:
    """``kind, item`` of all that concerns one symbol ``file::name``: definitions, callers, callees, relations of its name as a type, documents.

    An unknown key gives no row; null ids and repeated rows are left out.
    """
    file, _, name = key.rpartition("::")
    own = (F.col("file") == file) & (F.col("name") == name)
    calls, impls = facts["calls"], facts["type_impls"]
    return _all([
        _items("definition", facts["symbols"].where(own), F.col("id")),
        _items("caller", calls.where(F.col("resolved_symbol") == key), F.coalesce("caller_symbol", "file")),
        _items("callee", calls.where(F.col("caller_symbol") == key), F.coalesce("resolved_symbol", "callee_text")),
        _items("type_impl", impls.where((F.col("implementing_type") == name) | (F.col("trait_or_interface") == name)), F.col("id")),
        _items("doc", facts["bridge_edges"].where(F.col("to_id") == key), F.col("from_id")),
    ])


def pruned_edges(kinds: list[tuple[str, DataFrame, str]], allowed: Column, least: float, budget: int) -> DataFrame:
    """``kind, id, score`` of edges within one budget that the kinds share, in their order, best first.

    Each kind has a table with ``confidence``, and the column of its file that
    ``allowed`` is put to as ``file``.  Edges below ``least`` are left out, scores
    that are no numbers counting as 0; repeated ids count once with their best
    score.  A budget of none gives no row.
    """

    def one(turn: int, kind: str, df: DataFrame, column: str) -> DataFrame:
        score = T.normal_score(F.col("confidence.score"))
        rows = df.withColumn("file", F.col(column)).where(allowed & (score >= least)).groupBy("id").agg(F.max(score).alias("score"))
        return rows.select(F.lit(turn).alias("turn"), F.lit(kind).alias("kind"), "id", "score")

    rows = reduce(DataFrame.unionByName, [one(n, *k) for n, k in enumerate(kinds)])
    # sorted and cut in every task before anything is exchanged
    return rows.orderBy("turn", F.desc("score"), "id").limit(budget).select("kind", "id", "score")


def scored_by_file(scored: DataFrame) -> DataFrame:
    """``file, n_hits, best`` of ``scored(file, score)``."""
    return scored.where(F.col("file").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"))


def best_per_project(scored: DataFrame, project: Column, key: str, k: int) -> DataFrame:
    """``project, key, score``: the ``k`` best of each project, each key once; ties by key.  The first ranking is cut in every task."""
    best = scored.select(project.alias("project"), key, "score").where("project is not null").groupBy("project", key).agg(F.max("score").alias("score"))
    return best.selectExpr("*", f"row_number() over (partition by project order by score desc, {key}) as rank").where(F.col("rank") <= k).select("project", key, "score")


def may_edit(path: Column, size: Column) -> Column:
    """Whether a file may be read and changed: not below ``.git``, no lock or environment file, not too large, not outside the root; null paths may not."""
    name = F.element_at(F.split(path, "/"), -1)
    refused = path.rlike(r"(^|/)\.git(/|$)") | name.endswith(".lock") | name.startswith(".env") | path.rlike(r"^/|(^|/)\.\.(/|$)") | (F.coalesce(size, F.lit(0)) > MAX_EDIT)
    return ~F.coalesce(refused, F.lit(True))


def with_ordinals(df: DataFrame, file: str, line: str, order: list[str], prefix: str) -> DataFrame:
    """``df`` with ``fact_id``: file, prefix and the fact's number within its file, from 0, by line and ``order``.

    A file is numbered in stretches of lines, so that no file is one task.  Null
    files and lines come first, as one file and one line of their own.
    """
    at = F.floor(F.coalesce(F.col(line), F.lit(-1)) / LINES_PER_STRETCH)
    cut = df.withColumns({"__f": F.coalesce(F.col(file), F.lit("")), "__s": at})
    before = cut.groupBy("__f", "__s").agg(F.count(F.lit(1)).alias("n")).selectExpr("__f", "__s", "coalesce(sum(n) over (partition by __f order by __s rows between unbounded preceding and 1 preceding), 0L) as before")
    within = cut.selectExpr("*", f"row_number() over (partition by __f, __s order by {', '.join([line, *order])}) - 1 as __k")
    joined = within.join(before, ["__f", "__s"])
    return joined.withColumn("fact_id", F.concat_ws("", "__f", F.lit("#"), F.lit(prefix), (F.col("before") + F.col("__k")).cast("string"))).drop("__f", "__s", "__k", "before")


def counted(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One row with the number of different ids of each table under its name."""
    each = [df.select(F.lit(n).alias("t"), F.col(key).cast("string").alias("i")) for n, df in tables.items()]
    ids = reduce(DataFrame.unionByName, each).where("i is not null").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(*[F.coalesce(F.max(F.when(F.col("t") == n, F.col("n"))), F.lit(0).cast("long")).alias(n) for n in tables])


def retained(results: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """Results whose key is among those of ``keep``; null keys go."""
    return results.join(keep.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def history(files: DataFrame, run: str = "snapshot_no") -> DataFrame:
    """``run, n_rows, n_paths`` of every delivered run, newest first."""
    per = files.where(F.col(run).isNotNull()).groupBy(run, "path").count()
    return per.groupBy(run).agg(F.sum("count").alias("n_rows"), F.count("path").alias("n_paths")).orderBy(F.desc(run))


def empty_like(spark, schema: K.StructType | str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema)
