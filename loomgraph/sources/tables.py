"""Reading fact tables.  Schemas come from the files; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temporary views, so that any SQL can be put to the facts."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def last_runs(spark: SparkSession, root: str) -> tuple[int, int]:
    """The last two runs that delivered files, the same one twice if there is but one.  One number per delivery is read."""
    runs = sorted(r[0] for r in table(spark, root, "files").select("snapshot_no").where("snapshot_no is not null").distinct().collect())
    return (*runs, *runs)[:2] if len(runs) < 2 else (runs[-2], runs[-1])
