"""Contexts for a question, what changes affect, files on a topic, and bounded exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from .budget import greedy_fill

# fixed values: share of an export's budget by kind of fact, in percent, and tokens added for each fact
EXPORT_SHARES = {"symbol": (20, 20), "import": (8, 15), "call": (8, 15), "type_impl": (10, 15), "bridge": (5, 15), "doc": (5, 20), "doc_edge": (3, 10), "file": (5, 10), "code_edge": (3, 10)}
# fixed values: order of a match
PRIORITY = {"exact": 4, "prefix": 3, "fuzzy": 2, "bridge": 1, "import": 0}
# fixed values: fields whose matches rank no higher, however well they match
AT_MOST = {"tags": "fuzzy", "from_id": "bridge", "to_id": "bridge"}


def match_priority(text: Column, query: str) -> Column:
    """Rank of a match: the query itself, at the start, inside, or null."""
    low, q = F.lower(text), query.lower()
    return F.when(low == q, PRIORITY["exact"]).when(F.startswith(low, F.lit(q)), PRIORITY["prefix"]).when(F.contains(low, F.lit(q)), PRIORITY["fuzzy"])


def best_match(fields: list[str], query: str) -> Column:
    """The best rank of a query in any of the fields, -1 if it is in none."""

    def one(f: str) -> Column:
        rank = match_priority(F.col(f).cast("string"), query)
        return F.coalesce(F.when(rank.isNotNull(), F.least(rank, F.lit(PRIORITY[AT_MOST[f]]))) if f in AT_MOST else rank, F.lit(-1))

    return F.greatest(F.lit(-1), *map(one, fields))


def candidates(facts: dict[str, tuple[DataFrame, str, list[str]]], query: str) -> DataFrame:
    """``kind, item, priority, tokens`` of all facts that a query matches in any of their fields.

    ``facts`` has, by kind, a DataFrame, its id and the fields looked at.
    """

    def one(kind: str, df: DataFrame, key: str, fields: list[str]) -> DataFrame:
        best = best_match(fields, query)
        size = T.estimated_tokens(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
        hit = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item"), best.alias("priority"), size.alias("tokens")).where("priority >= 0")
        return hit.groupBy("kind", "item").agg(F.max("priority").alias("priority"), F.min("tokens").alias("tokens"))

    return reduce(DataFrame.unionByName, [one(k, *v) for k, v in facts.items()])


def bounded(found: DataFrame, budget: int) -> DataFrame:
    """What of the candidates a budget takes in: best match first, then the smaller, by kind and id."""
    named = found.withColumn("item", F.concat_ws("|", "kind", "item")).withColumn("all", F.lit("context"))
    return greedy_fill(named, "all", [-F.col("priority"), F.col("tokens"), F.col("item")], "tokens", "item", F.lit(budget)).select("item", "tokens")


def of_files(files: DataFrame, facts: dict[str, tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """``kind, item, priority, tokens, turn, place`` of the facts in ``files(file)``.

    ``facts`` has, by kind, a DataFrame with ``file, line``, its id, the field
    that is measured and the column in the line; ``turn`` counts the kinds,
    ``place`` is where in the source a fact stands.
    """

    def one(turn: int, kind: str, df: DataFrame, key: str, field: str, column: Column) -> DataFrame:
        near = df.join(files.select("file").distinct(), "file", "left_semi")
        row = near.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item"), T.estimated_tokens(F.coalesce(field, F.lit(""))).alias("tokens"), F.struct("file", "line", column.cast("int").alias("column")).alias("place"))
        return row.groupBy("kind", "item").agg(F.lit(PRIORITY["import"]).alias("priority"), F.min("tokens").alias("tokens"), F.lit(turn).alias("turn"), F.min("place").alias("place"))

    return reduce(DataFrame.unionByName, [one(n, k, *v) for n, (k, v) in enumerate(facts.items())])


def bounded_with_code(found: DataFrame, symbols: DataFrame, facts: dict[str, tuple[DataFrame, str, str, Column]], query: str, budget: int) -> DataFrame:
    """``bounded``, then what the rest of the budget takes in of the facts in the files of the symbols taken, kind by kind in source order.

    Only symbols count whose name the query matches.
    """
    first = materialise(bounded(found, budget))
    ids = first.where("item like 'symbol|%'").select(F.substr("item", F.lit(len("symbol|") + 1)).alias("id"))
    files = symbols.where(best_match(["name"], query) >= 0).join(ids, "id", "left_semi").select("file")
    left = first.agg((F.lit(budget) - F.coalesce(F.sum("tokens"), F.lit(0))).alias("left"))
    more = of_files(files, facts).withColumn("item", F.concat_ws("|", "kind", "item")).withColumn("all", F.lit("context")).crossJoin(F.broadcast(left))
    second = greedy_fill(more, "all", [F.col("turn"), F.col("place"), F.col("item")], "tokens", "item", F.col("left"))
    return first.unionByName(second.select("item", "tokens"))


def export_bounded(facts: dict[str, tuple[DataFrame, str]], total: int, name: str) -> DataFrame:
    """``kind, item, tokens``: of each kind, the facts in order of id that its share of the budget takes in."""
    rest = max(0, total - -(-len(name) // 4) - 100)

    def one(kind: str, df: DataFrame, key: str) -> DataFrame:
        share, extra = EXPORT_SHARES[kind]
        size = (T.estimated_tokens(F.to_json(F.struct(*df.columns))) + extra).alias("tokens")
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item"), size, F.lit(rest * share // 100).alias("budget"))

    rows = reduce(DataFrame.unionByName, [one(k, *v) for k, v in facts.items()])
    return greedy_fill(rows, "kind", [F.col("item")], "tokens", "item", F.col("budget"))


def topic_files(doc_nodes: DataFrame, bridge_edges: DataFrame, topic: str) -> DataFrame:
    """``path``: files that documents on a topic refer to, by title or path."""
    hits = doc_nodes.where(match_priority(F.col("title"), topic).isNotNull() | match_priority(F.col("path"), topic).isNotNull()).select(F.concat(F.lit("doc:"), "path").alias("from_id"))
    return bridge_edges.join(hits, "from_id", "left_semi").select(F.element_at(F.split("to_id", "::"), 1).alias("path")).distinct()


def diff_paths(text: str) -> list[str]:
    """New paths in a unified diff, each once, in order."""
    out = [line[6:].strip() for line in text.splitlines() if line.startswith("+++ b/")]
    return list(dict.fromkeys(out))


def affected(changed: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, bridge_edges: DataFrame) -> DataFrame:
    """``kind, item``: symbols in ``changed(path)``, calls of them from elsewhere, imports of the files and documents on them."""
    path = changed.select(F.col("path").alias("file")).distinct()
    syms = symbols.join(path, "file", "left_semi").select(F.concat("file", F.lit("::"), "name").alias("key")).distinct()
    callers = calls.join(syms, F.col("resolved_symbol") == F.col("key"), "left_semi").select(F.lit("caller").alias("kind"), F.coalesce("caller_symbol", F.concat("file", F.lit(":"), F.col("line").cast("string"))).alias("item"))
    importers = imports.join(path.select(F.col("file").alias("resolved_file")), "resolved_file", "left_semi").select(F.lit("import").alias("kind"), F.col("id").alias("item"))
    target = F.element_at(F.split("to_id", "::"), 1)
    docs = bridge_edges.withColumn("file", target).join(path, "file", "left_semi").select(F.lit("doc").alias("kind"), F.col("from_id").alias("item"))
    return reduce(DataFrame.unionByName, [syms.select(F.lit("symbol").alias("kind"), F.col("key").alias("item")), callers, importers, docs]).distinct()
