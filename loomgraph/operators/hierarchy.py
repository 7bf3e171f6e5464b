"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

CYCLE = "(cycle)"
# pointers at one name from which they are joined in parts, and parts at most
HOT, MOST_PARTS = 100_000, 256


def _real(links: DataFrame) -> DataFrame:
    return links.select("child", "parent").where("child is not null and parent is not null and child <> '' and parent <> ''")


def _in_parts(pointers: DataFrame, at: DataFrame, key: str, how: str) -> DataFrame:
    """Join of ``pointers(name, end)`` with what they point at; names with many pointers are copied to as many parts as these fill."""
    loads = pointers.groupBy(F.col("end").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    # at most one row for every HOT pointers
    hot = F.broadcast(loads.select("hot", F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / HOT)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    a = pointers.join(hot, F.col("end") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).drop("hot", "parts")
    b = at.join(hot, F.col(key) == F.col("hot"), "left").withColumn("to_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot", "parts")
    return a.join(b, (F.col("end") == F.col(key)) & (F.col("part") == F.col("to_part")), how).drop("part", "to_part")


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """``name, root, depth`` (and ``path``, an array from the root) for every name in ``links(child, parent)``.

    Each round joins every open pointer with the pointer it points at, so that
    a jump of length d becomes 2d; a name is done when its pointer is a root.
    Once a round finishes no name, what is open lies on a circle or ends in
    one: depths under a root have no gaps, so a round that finishes nothing
    means that none of greater depth exists.  Those names get root
    ``(cycle)``, depth -1 and a null path.

    Null or empty names make no link.  Repeated links count once.  Of several
    parents of one child the least is its parent, so that each name has one
    path; ``other_parents`` has the rest.  A link of a name to itself is a circle.

    A few names may have most pointers: those with more than ``HOT`` are joined in
    parts, in proportion to their load.  Only names that are parents can be
    pointed at, and they are few beside the others.
    """
    real = _real(links)
    up = real.groupBy("child").agg(F.min("parent").alias("parent"))
    names = real.select(F.col("child").alias("name"), F.lit(False).alias("above")).unionByName(real.select(F.col("parent").alias("name"), F.lit(True).alias("above"))).groupBy("name").agg(F.max("above").alias("above"))
    # end: the name pointed at; jump: how far up it is; open: whether it has a parent itself
    state = names.join(up, F.col("name") == F.col("child"), "left").select("name", "above", F.coalesce("parent", "name").alias("end"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("jump"))
    if with_path:
        # from just below the end down to the name
        state = state.withColumn("tail", F.when(F.col("jump") == 0, F.array().cast("array<string>")).otherwise(F.array("name")))
    state = materialise(state)
    roots = state.where("jump = 0").select(F.col("name").alias("root"))
    done = _in_parts(state, roots, "root", "left").withColumn("open", F.col("root").isNull()).drop("root")
    now = materialise(done)
    release(state)
    left = now.where("open").count()
    while left:
        ahead = now.where("above").select(F.col("name").alias("b"), F.col("end").alias("b_end"), F.col("jump").alias("b_jump"), F.col("open").alias("b_open"), *([F.col("tail").alias("b_tail")] if with_path else []))
        moved = _in_parts(now.where("open"), ahead, "b", "inner")
        columns = ["name", "above", F.col("b_end").alias("end"), (F.col("jump") + F.col("b_jump")).alias("jump"), F.col("b_open").alias("open")]
        if with_path:
            columns.append(F.concat("b_tail", "tail").alias("tail"))
        finished = now.where("not open")
        after = materialise(finished.unionByName(moved.select(*columns)))
        release(now)
        now, before, left = after, left, after.where("open").count()
        if left == before:
            break
    shown = ["name", F.when(F.col("open"), CYCLE).otherwise(F.col("end")).alias("root"), F.when(F.col("open"), -1).otherwise(F.col("jump")).cast("int").alias("depth")]
    if with_path:
        shown.append(F.when(~F.col("open"), F.concat(F.array("end"), "tail")).alias("path"))
    return now.select(*shown)


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` from the paths of ``hierarchy``.

    One row per pair, never gathered: a root with very many descendants is
    just as many rows.  Names on circles have no path and no pairs.
    """
    each = tree.where("path is not null and size(path) > 1").select("name", "depth", F.posexplode("path").alias("at", "ancestor"))
    return each.where("at < depth").select("ancestor", F.col("name").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def other_parents(links: DataFrame) -> DataFrame:
    """``child, parent, kept_parent``: the links that ``hierarchy`` does not follow, once each."""
    real = _real(links).distinct()
    kept = real.groupBy("child").agg(F.min("parent").alias("kept_parent"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return real.join(kept, "child").where("parent <> kept_parent").select("child", "parent", "kept_parent")
