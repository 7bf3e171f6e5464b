"""Changes between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_changes(rows: DataFrame, snapshot: str, key: Column, content: Column) -> DataFrame:
    """``snapshot_no, key, change_kind`` for every pair of consecutive snapshots.

    Only snapshots that occur count, so gaps in the numbers do not matter; the
    first yields nothing.  ``content`` is hashed to a canonical row hash; a row
    with a null key or snapshot is no record.  A key delivered more than once in a
    snapshot is one record; of differing contents the greatest hash counts, so
    that every run gives the same result.  Null content equals null content.
    """
    spark = rows.sparkSession
    canonical = F.sha2(F.coalesce(content.cast("string"), F.lit("\0null")), 256)
    state = rows.select(F.col(snapshot).alias("snapshot_no"), key.alias("key"), F.unhex(canonical).alias("h")).where("snapshot_no is not null and key is not null")
    # one number per delivery, not per record
    delivered = sorted(r[0] for r in rows.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().collect())
    kind = dict(rows.dtypes)[snapshot]
    pairs = spark.createDataFrame(list(zip(delivered, delivered[1:], strict=False)), f"was {kind}, later {kind}")
    distinct = state.groupBy("snapshot_no", "key").agg(F.max("h").alias("h"))
    # both sides read the same exchange: one aggregation, under its own run's number and under the next one's
    now = distinct.join(F.broadcast(pairs), F.col("snapshot_no") == F.col("later")).select("snapshot_no", "key", "h")
    before = distinct.join(F.broadcast(pairs), F.col("snapshot_no") == F.col("was")).select(F.col("later").alias("snapshot_no"), "key", F.col("h").alias("h_before"))
    both = now.join(before, ["snapshot_no", "key"], "full_outer")
    change = F.when(F.col("h_before").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("h_before"), "changed")
    return both.select("snapshot_no", "key", change.alias("change_kind")).where("change_kind is not null")
