"""Per-key work when a few keys hold most rows: fragment-replicate by load.

Loads are counted exactly with map-side partial counts.  Keys above a quarter
of a task's fair share are split into shards in proportion to their load; all
other keys go together into hash buckets.  Shards and buckets are packed on
tasks, largest first, each on the least loaded task.  The matching side of a
join is replicated only to the tasks that hold shards of its key.

What reaches the driver is bounded by ``4 * tasks`` heavy keys and ``BUCKETS``
bucket loads, whatever the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
SLOT, KEY = "__slot", "__key"


@dataclass
class LoadPlan:
    """Where rows go: ``heavy`` maps a key to the tasks of its shards, ``light`` a bucket to its task."""

    tasks: int
    heavy: dict[str, list[int]]
    light: list[int]
    loads: list[int]


def pack(heavy: dict[str, int], light: dict[int, int], tasks: int) -> LoadPlan:
    """Longest-processing-time packing of shards and buckets on ``tasks`` tasks."""
    total = sum(heavy.values()) + sum(light.values())
    grain = max(1, total // (4 * tasks))
    items: list[tuple[int, str | None, int]] = [(n, None, b) for b, n in light.items()]
    for key, n in heavy.items():
        shards = min(tasks, -(-n // grain))
        items += [(-(-n // shards), key, s) for s in range(shards)]
    heap = [(0, t) for t in range(tasks)]
    to_heavy: dict[str, list[int]] = {k: [] for k in heavy}
    to_light, loads = [b % tasks for b in range(BUCKETS)], [0] * tasks
    for n, key, at in sorted(items, key=lambda x: (-x[0], x[1] or "", x[2])):
        load, task = heapq.heappop(heap)
        loads[task] = load + n
        heapq.heappush(heap, (load + n, task))
        if key is None:
            to_light[at] = task
        else:
            to_heavy[key].append(task)
    return LoadPlan(tasks, to_heavy, to_light, loads)


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count the rows of every key of ``df`` and place them.  Null keys are not counted."""
    spark = df.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(KEY))
    limit = max(1, df.count() // (4 * tasks))
    hot = F.col("n") > limit
    rows = (
        keyed.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.when(hot, F.col(KEY)).alias("hot"), F.when(~hot, bucket_of(F.col(KEY))).alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return pack({r.hot: r.n for r in rows if r.bucket is None}, {r.bucket: r.n for r in rows if r.bucket is not None}, tasks)


def hash_int(value: int) -> int:
    """Spark's hash of an int: Murmur3 with seed 42, as a signed number."""
    mask = 0xFFFFFFFF

    def turn(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & mask

    k = turn((value * 0xCC9E2D51) & mask, 15) * 0x1B873593 & mask
    h = (turn(42 ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def slot_numbers(tasks: int) -> list[int]:
    """For each task a number whose hash partition, out of ``tasks``, is that task.

    A plain hash exchange on the number then places rows as planned, and later
    grouping by the number and the key needs no further exchange.
    """
    found: dict[int, int] = {}
    value = 0
    while len(found) < tasks:
        found.setdefault(hash_int(value) % tasks, value)
        value += 1
    return [found[t] for t in range(tasks)]


def _slots(df: DataFrame, key: Column, plan: LoadPlan) -> tuple[DataFrame, Column, Column]:
    """``df`` with the slots of a heavy key (null for light ones), and the slot of a light key."""
    spark = df.sparkSession
    number = slot_numbers(plan.tasks)
    rows = [(k, [number[t] for t in ts]) for k, ts in plan.heavy.items()]
    heavy = spark.createDataFrame(rows, f"{KEY}_hot string, {SLOT}s array<int>")
    out = df.withColumn(KEY, key.cast("string")).join(F.broadcast(heavy), F.col(KEY) == F.col(f"{KEY}_hot"), "left").drop(f"{KEY}_hot")
    light = F.element_at(F.lit([number[t] for t in plan.light]), bucket_of(F.col(KEY)) + 1)
    return out, F.col(f"{SLOT}s"), light


def spread(df: DataFrame, key: str, plan: LoadPlan, shard_by: list[str]) -> DataFrame:
    """``df`` with ``__slot`` and ``__key``, exchanged once so that every task gets its share.

    Rows of a heavy key are told apart by the hash of ``shard_by``: equal
    values meet in one task.  Rows with a null key belong to no key and are
    left out.
    """
    keyed, slots, light = _slots(df.where(F.col(key).isNotNull()), F.col(key), plan)
    mine = F.element_at(slots, (F.pmod(F.xxhash64(*shard_by, F.lit(7)), F.size(slots)) + 1).cast("int"))
    return keyed.withColumn(SLOT, F.when(slots.isNotNull(), mine).otherwise(light)).drop(f"{SLOT}s").repartition(plan.tasks, F.col(SLOT))


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: each row to every task that holds a shard of its key."""
    keyed, slots, light = _slots(df.where(F.col(key).isNotNull()), F.col(key), plan)
    targets = F.when(slots.isNotNull(), F.array_distinct(slots)).otherwise(F.array(light))
    return keyed.withColumn(SLOT, F.explode(targets)).drop(f"{SLOT}s").repartition(plan.tasks, F.col(SLOT))


def balanced_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, shard_by: list[str], how: str = "inner") -> DataFrame:
    """Equi join of a skewed ``fact`` with ``dim`` (``inner``, ``left_semi`` or ``left``).

    Columns of ``dim`` whose name ``fact`` has too are given the prefix
    ``dim_``.  Null keys match nothing; with ``left`` their rows are lost only
    if asked for by ``inner`` or ``left_semi``.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unknown join type {how}")
    spark = fact.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    plan = plan_loads(fact, fact_key)
    right = dim.select(*[F.col(c).alias(f"dim_{c}" if c in fact.columns else c) for c in dim.columns])
    right = replicate(right, f"dim_{dim_key}" if dim_key in fact.columns else dim_key, plan)
    out = spread(fact, fact_key, plan, shard_by).join(right, [SLOT, KEY], how).drop(SLOT, KEY)
    if how == "left":
        out = out.unionByName(fact.where(F.col(fact_key).isNull()), allowMissingColumns=True)
    return out


def key_profile(df: DataFrame, key: str, id_col: str, file_col: str, repo_col: str, resolved: Column) -> DataFrame:
    """One row per key: ``key_text, n_ids, n_files, n_repos, n_resolved, resolved_share``.

    Each id counts once, as resolved if any of its rows is.  An id is taken to
    belong to one file.  Null keys are left out; an empty table gives no row.
    """
    narrow = df.select(
        F.col(key).cast("string").alias("key_text"), F.col(id_col).alias("i"), F.col(file_col).alias("f"), F.col(repo_col).alias("r"), F.coalesce(resolved, F.lit(False)).cast("int").alias("ok")
    )
    # by id, so that a key of one file is split like any other; files are then merged over the shards
    rows = spread(narrow, "key_text", plan_loads(narrow, "key_text"), ["i"]).drop(KEY)
    per_slot = rows.groupBy(SLOT, "key_text", "r", "f", "i").agg(F.max("ok").alias("ok")).groupBy(SLOT, "key_text", "r", "f").agg(F.count("i").alias("n_ids"), F.sum("ok").alias("n_ok"))
    per_file = per_slot.groupBy("key_text", "r", "f").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ok").alias("n_ok"))
    merged = per_file.groupBy("key_text", "r").agg(F.sum("n_ids").alias("n_ids"), F.count("f").alias("n_files"), F.sum("n_ok").alias("n_ok"))
    return (
        merged.groupBy("key_text")
        .agg(F.sum("n_ids").alias("n_ids"), F.sum("n_files").alias("n_files"), F.count("r").alias("n_repos"), F.sum("n_ok").alias("n_resolved"))
        .withColumn("resolved_share", F.round(F.col("n_resolved") / F.col("n_ids"), 6))
    )


def key_counts(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """``key_text, n_ids``: distinct ids per key, without a task for each heavy key."""
    narrow = df.select(F.col(key).cast("string").alias("key_text"), F.col(id_col).alias("i"))
    rows = spread(narrow, "key_text", plan_loads(narrow, "key_text"), ["i"]).drop(KEY)
    per_slot = rows.groupBy(SLOT, "key_text", "i").agg(F.lit(1).alias("one")).groupBy(SLOT, "key_text").agg(F.count("i").alias("n_ids"))
    return per_slot.groupBy("key_text").agg(F.sum("n_ids").alias("n_ids"))


def heavy_keys(df: DataFrame, key: str, id_col: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of the distinct ids of ``df``: ``key_text, n_ids``.

    An id with a null key counts in the total and for no key.
    """
    counts = key_counts(df, key, id_col)
    loose = df.where(F.col(key).isNull()).agg(F.count_distinct(F.col(id_col)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n")).scalar() + loose.scalar()
    return counts.where(F.col("n_ids") >= F.lit(share) * total)
