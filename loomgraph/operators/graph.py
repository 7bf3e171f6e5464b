"""Graph queries: bounded breadth-first search, cycles and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release


def reach(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth`` of all nodes within ``max_depth`` steps along ``edges(src, dst)``, each once at its least depth.

    ``start`` has ``node``; its nodes are left out.  Null ends are no edges.
    Each round joins only the frontier.
    """
    real = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    seen = materialise(start.where("node is not null").select("node").distinct().select("node", F.lit(0).alias("depth")))
    for k in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == k - 1)
        found = front.join(real, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        after = materialise(seen.unionByName(found.select("node", F.lit(k).alias("depth"))))
        release(seen)
        seen = after
        if not seen.where(F.col("depth") == k).take(1):
            break
    return seen.where("depth > 0")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """``node``: what is left after nodes without a way in or out are taken off again and again.

    These are the nodes of circles and of ways from one circle to another.
    """
    now = materialise(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    n = now.count()
    while n:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        after = materialise(kept.select("src", "dst"))
        release(now)
        now, was, n = after, n, after.count()
        if n == was:
            break
    return now.select(F.col("src").alias("node")).distinct()


def circles(edges: DataFrame) -> DataFrame:
    """``circle, node``: the nodes that lie on circles, under the greatest name of those that reach each other.

    Colours run forward: every node takes the greatest name that reaches it, so
    that what can reach each other has one colour.  From the node a colour is
    named after, the way back within the colour gives its circle; what is left
    goes through the same again.  Each step joins edges with a row per node, so a
    node of very many edges is no more than that.  Null ends are no edges; a node
    with an edge to itself is a circle of its own.
    """
    spark = edges.sparkSession
    left = materialise(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    found = [spark.createDataFrame([], "circle string, node string")]
    while left.take(1):
        # without the nodes that have no way in or no way out
        n, was = left.count(), -1
        while n and n != was:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            after = materialise(inner.select("src", "dst"))
            release(left)
            left, was, n = after, n, after.count()
        if not n:
            break
        colour = materialise(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            told = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("above"))
            next_ = materialise(colour.join(told, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", "above").alias("colour"), (F.coalesce("above", "colour") > F.col("colour")).alias("moved")))
            release(colour)
            colour = next_.select("node", "colour")
            if not next_.where("moved").take(1):
                break
        own = colour.select(F.col("node").alias("src"), F.col("colour").alias("c"))
        same = left.join(own, "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select("src", "dst")
        back = materialise(same.select(F.col("dst").alias("from"), F.col("src").alias("to")))
        reached = materialise(colour.where("node = colour").select("node"))
        front = reached
        while front.take(1):
            front = materialise(front.join(back, F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct().join(reached, "node", "left_anti"))
            grown = materialise(reached.unionByName(front))
            reached = grown
        circle = materialise(colour.join(reached, "node", "left_semi").select(F.col("colour").alias("circle"), "node"))
        sizes = circle.groupBy("circle").count().where("count > 1").select("circle")
        loops = left.where("src = dst").select(F.col("src").alias("circle")).distinct()
        # written out, as the edges it is told from are released below
        found.append(materialise(circle.join(sizes.unionByName(loops).distinct(), "circle", "left_semi")))
        rest = left.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        after = materialise(rest.select("src", "dst"))
        release(left)
        left = after
    return reduce(DataFrame.unionByName, found)


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct caller-callee pairs of resolved calls: ``src, dst``."""
    there = calls.where("caller_symbol is not null and resolved_symbol is not null and trim(resolved_symbol) <> ''")
    return there.select(F.col("caller_symbol").alias("src"), F.col("resolved_symbol").alias("dst")).distinct()


def impact(calls: DataFrame, symbols: DataFrame, file_part: str, max_depth: int) -> DataFrame:
    """``node, depth``: callers of the symbols in files whose path contains ``file_part``.

    A caller stands for its whole file: the next step goes on from all symbols
    of that file.
    """
    defs = symbols.select(F.concat("file", F.lit("::"), "name").alias("key"), F.col("file").alias("sf")).distinct()
    hops = calls.where("resolved_symbol is not null and trim(resolved_symbol) <> ''").select(F.col("resolved_symbol").alias("key"), F.col("file").alias("dst")).distinct()
    # from file to file; symbols come in once at the end
    edges = hops.join(defs, "key").select(F.col("sf").alias("src"), "dst").distinct()
    files = reach(edges, defs.where(F.contains("sf", F.lit(file_part))).select(F.col("sf").alias("node")), max_depth)
    return files.join(defs, F.col("node") == F.col("sf")).select(F.col("key").alias("node"), "depth")


def dead_symbols(symbols: DataFrame, used: DataFrame, mentions: DataFrame) -> DataFrame:
    """Symbols of no visible use: ``id, file, name, line_start, confidence``.

    ``used`` has ``name``, ``mentions`` has ``name, file, line``.  Left out are
    tests, entry points, used names and names mentioned on any other line.
    Exported ones get 75, others 90.
    """
    entry = F.lower("name").isin("main", "init", "setup", "teardown", "__init__", "new", "default")
    open_ = symbols.where(~F.coalesce("is_test", F.lit(False)) & ~entry).join(used.select("name").distinct(), "name", "left_anti")
    # a name may be mentioned very often; per name and file the least and greatest line say whether another line mentions it
    other = mentions.groupBy("name").agg(F.min(F.struct("file", "line")).alias("lo"), F.max(F.struct("file", "line")).alias("hi"))
    own = F.struct("file", F.col("line_start").alias("line"))
    elsewhere = open_.join(other, "name", "left").where(F.col("lo").isNull() | ((F.col("lo") == own) & (F.col("hi") == own)))
    return elsewhere.select("id", "file", "name", "line_start", F.when(F.col("exported"), 75).otherwise(90).alias("confidence"))
