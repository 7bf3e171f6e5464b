"""Token budgets: greedy filling that skips what does not fit and goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_fill(items: DataFrame, group: str, order: list[Column], tokens: str, item: str, budget: Column) -> DataFrame:
    """Items of each group that a budget takes in: ``group, item, tokens, used_before``.

    In ``order``, every item that still fits is taken, others are passed over.
    Only what can count goes to the fold: in the order, an item behind more than
    the budget of items of one token or more each cannot be judged without them,
    but an item larger than the budget never fits.  A budget is small, and so is the
    list: of items alike in size no more than the budget holds can be taken, so of
    each group and size only so many, first in order, are gathered.  Items of no
    tokens always fit.  Null sizes and groups are left out.
    """
    size = F.col(tokens).cast("long")
    sized = items.where(F.col(tokens).isNotNull() & F.col(group).isNotNull() & (size >= 0)).select(F.col(group).alias("g"), F.col(item).alias("i"), size.alias("t"), budget.cast("long").alias("b"), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]).alias("o"))
    free = sized.where("t = 0").select(F.col("g").alias(group), F.col("i").alias(item), F.col("t").alias(tokens))
    able = sized.where("t > 0 and t <= b").selectExpr("*", "row_number() over (partition by g, t order by o) as k").where("k * t <= b")
    kind = dict(sized.dtypes)["i"]
    packed = able.groupBy("g").agg(F.max("b").alias("b"), F.array_sort(F.collect_list(F.struct("o", "t", "i"))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<i:{kind},t:bigint>>").alias("taken"))

    def step(s: Column, x: Column, b: Column) -> Column:
        fits = s["used"] + x["t"] <= b
        return F.when(fits, F.struct((s["used"] + x["t"]).alias("used"), F.array_append(s["taken"], F.struct(x["i"].alias("i"), x["t"].alias("t"))).alias("taken"))).otherwise(s)

    folded = packed.select("g", F.explode(F.aggregate("xs", zero, lambda s, x: step(s, x, F.col("b")))["taken"]).alias("x"))
    return folded.select(F.col("g").alias(group), F.col("x.i").alias(item), F.col("x.t").alias(tokens)).unionByName(free)
