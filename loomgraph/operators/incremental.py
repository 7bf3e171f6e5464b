"""Updates: changes of files, upserts, deletions, snapshots and text differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status`` of files added, modified or deleted, by hash.  Repeated rows of a path count once."""
    was = old.groupBy("path").agg(F.max("hash").alias("was"))
    now = new.groupBy("path").agg(F.max("hash").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return was.join(now, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def upsert(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with ``rows`` in the place of those of equal key."""
    return stored.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def without_files(facts: DataFrame, touched: DataFrame, column: str = "file") -> DataFrame:
    """Facts of files other than ``touched(path)``."""
    return facts.join(touched.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def merge_facts(stored: DataFrame, fresh: DataFrame, changes: DataFrame, column: str = "file") -> DataFrame:
    """Facts after an update: those of changed and deleted files go, those of added and modified files come from ``fresh``."""
    again = changes.where("status <> 'deleted'").select(F.col("path").alias(column)).distinct()
    return without_files(stored, changes, column).unionByName(fresh.join(again, column, "left_semi").select(*stored.columns))


def write_snapshot(df: DataFrame, root: str, label: str) -> str:
    """A version of a table with a checksum of each row; returns its folder."""
    where = f"{root}/snapshots/{label}"
    df.withColumn("__sum", F.sha2(F.to_json(F.struct(*df.columns)), 256)).write.mode("errorifexists").parquet(where)
    return where


def read_snapshot(spark: SparkSession, root: str, label: str) -> DataFrame:
    """A version as written; a row that fails its checksum stops the read."""
    raw = spark.read.parquet(f"{root}/snapshots/{label}")
    plain = [c for c in raw.columns if c != "__sum"]
    same = F.col("__sum") == F.sha2(F.to_json(F.struct(*plain)), 256)
    return raw.where(F.when(same, True).otherwise(F.raise_error(F.lit("checksum mismatch")).cast("boolean"))).select(*plain)


def diff_hunks(old: str | None, new: str | None) -> list[tuple[int, int, int, int, list[str], list[str]]]:
    """Greedy line comparison: runs of unequal lines up to the next pair of equal ones.

    Each hunk has the start and number of its old and new lines and the lines
    themselves.  Null is the empty text.
    """
    a, b = (old or "").splitlines(), (new or "").splitlines()
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        later = {x: k for k, x in reversed(list(enumerate(b[j:], j)))}
        stop = next((k for k in range(i, len(a)) if a[k] in later), None)
        ends = (stop, later[a[stop]]) if stop is not None else (len(a), len(b))
        out.append((i + 1, ends[0] - i, j + 1, ends[1] - j, a[i : ends[0]], b[j : ends[1]]))
        i, j = ends
    return out


HUNKS = "old_start int, old_lines int, new_start int, new_lines int, removed array<string>, added array<string>"


def text_diff(pairs: DataFrame, key: str) -> DataFrame:
    """Hunks of ``pairs(key, old_text, new_text)``, one row each."""
    kind = dict(pairs.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = [(k, *h) for k, o, n in zip(pdf[key], pdf.old_text, pdf.new_text, strict=True) for h in diff_hunks(o, n)]
            yield pd.DataFrame(rows, columns=[key, "old_start", "old_lines", "new_start", "new_lines", "removed", "added"])

    return pairs.where(~F.col("old_text").eqNullSafe(F.col("new_text"))).select(key, "old_text", "new_text").mapInPandas(run, f"{key} {kind}, {HUNKS}")
