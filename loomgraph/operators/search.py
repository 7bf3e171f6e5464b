"""Literal, regular-expression, keyword, vector and hybrid search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
# fixed value: vectors in a block on average
BLOCK = 2000


def line_table(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, content``: one row per line, counted from 1; null texts have none."""
    return files.select(F.col(key), F.posexplode(T.lines(F.col(text))).alias("at", "content")).select(key, (F.col("at") + 1).alias("line"), "content")


def find_literal(table: DataFrame, needle: str, ignore_case: bool = True, whole_word: bool = False) -> DataFrame:
    """Lines that contain ``needle``; as a whole word it is always case-sensitive."""
    if whole_word:
        return table.where(F.array_contains(T.words(F.col("content")), needle))
    return table.where(F.contains(F.lower("content"), F.lit(needle.lower())) if ignore_case else F.contains("content", F.lit(needle)))


def overlapping(table: DataFrame, needle: str) -> DataFrame:
    """Every occurrence, overlapping ones too, with its 1-based byte column."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1))), lambda k: F.substring(F.col("content"), k, F.lit(len(needle))) == needle)
    return table.select("*", F.explode(at).alias("pos")).select(*table.columns, (F.octet_length(F.substring(F.col("content"), F.lit(1), F.col("pos") - 1)) + 1).alias("byte_column"))


def find_regex(table: DataFrame, pattern: str) -> DataFrame:
    """Every match that does not overlap another: the matching lines with ``match_no, match_text``."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    return table.where(F.col("content").rlike(pattern)).select("*", F.posexplode(found).alias("match_no", "match_text"))


def replace_preview(table: DataFrame, pattern: str, replacement: str, literal: bool = True) -> DataFrame:
    """Lines that a replacement would change, ``before`` and ``after``."""
    after = F.replace(F.col("content"), F.lit(pattern), F.lit(replacement)) if literal else F.regexp_replace("content", pattern, replacement)
    return table.select(*[c for c in table.columns if c != "content"], F.col("content").alias("before"), after.alias("after")).where("before <> after")


def replace_apply(table: DataFrame, key: str, pattern: str, replacement: str, literal: bool = True) -> DataFrame:
    """Whole texts after the replacement: ``key, text``; a text is one file, so its lines fit one row."""
    after = F.replace(F.col("content"), F.lit(pattern), F.lit(replacement)) if literal else F.regexp_replace("content", pattern, replacement)
    sorted_ = F.array_sort(F.collect_list(F.struct("line", after.alias("content"))))
    return table.groupBy(key).agg(F.array_join(F.transform(sorted_, lambda x: x["content"]), "\n").alias("text"))


def with_context(table: DataFrame, hit: Column, key: str, around: int) -> DataFrame:
    """Matching lines and those up to ``around`` lines from one, each once, with ``is_hit``."""
    hits = table.where(hit).select(F.col(key).alias("k"), F.col("line").alias("hit"))
    wanted = hits.select("k", F.explode(F.sequence(F.col("hit") - around, F.col("hit") + around)).alias("l")).distinct()
    return table.join(wanted, (table[key] == F.col("k")) & (table["line"] == F.col("l"))).select(*table.columns, F.coalesce(hit, F.lit(False)).alias("is_hit"))


def keyword_search(items: DataFrame, key: str, fields: list[Column], query: str, k: int, least: float = 0.0, lists: list[Column] = ()) -> DataFrame:
    """The ``k`` best items by the best score of their fields, and of the texts in their ``lists``; ties by key."""
    inside = [F.array_max(F.transform(x, lambda t: T.keyword_score(t, query))) for x in lists]
    best = F.greatest(F.lit(0.0), *[T.keyword_score(f, query) for f in fields], *inside)
    return best_of(items.select(F.col(key), best.alias("score")).where(F.col("score") > least), key).orderBy(F.desc("score"), key).limit(k)


def best_of(scored: DataFrame, key: str) -> DataFrame:
    """One row per key with its greatest score."""
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` most similar vectors to one query, similarity to six places."""
    return vectors.select(F.col(key), F.round(T.cosine(F.col(vector), F.lit([float(x) for x in query])), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def vector_search_all(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query_id, key, score``: for every row of ``queries`` the ``k`` most similar vectors, as ``vector_search`` has them for one.

    Both sides are put into blocks by a hash of the key, one row each.  Every
    block of queries meets every block of vectors in one task, which sends on
    no more than ``k`` rows a query.  A norm that is not a number counts as 0.
    """
    kind = dict(vectors.dtypes)[key]
    name = dict(queries.dtypes)[key]

    def blocks(df: DataFrame, ids: str, values: str) -> DataFrame:
        n = -(-df.count() // BLOCK) or 1
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n))).agg(F.collect_list(key).alias(ids), F.collect_list(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))).alias(values))

    def run(batches):
        import numpy as np

        def unit(xs):
            got = {}
            for at, x in enumerate(xs):
                got.setdefault(len(x), []).append((at, x))
            out = {}
            for size, own in got.items():
                m = np.array([x for _, x in own], dtype="float64").reshape(len(own), size)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                out[size] = [at for at, _ in own], m, np.where(norm > 0, norm, 0.0)
            return out

        for pdf in batches:
            for ids, xs, to, ys in zip(pdf["qi"], pdf["qv"], pdf["vi"], pdf["vv"], strict=True):
                score = np.zeros((len(ids), len(to)))
                mine, theirs = unit(xs), unit(ys)
                for size in (mine.keys() & theirs.keys()) - {0}:
                    (a, m, p), (b, n, r) = mine[size], theirs[size]
                    norms = p * r.T
                    score[np.ix_(a, b)] = np.divide(m @ n.T, norms, out=np.zeros_like(norms), where=norms > 0)
                score, to = np.round(score, 6) + 0.0, np.asarray(to)
                for at, one in enumerate(ids):
                    best = np.lexsort((to, -score[at]))[:k]
                    yield pd.DataFrame({"query_id": [one] * len(best), key: to[best], "score": score[at][best]})

    # the pairs are dealt out, as few blocks would else lie in few tasks
    pairs = blocks(queries, "qi", "qv").crossJoin(blocks(vectors, "vi", "vv")).repartition("qi", "vi").select("qi", "qv", "vi", "vv")
    some = pairs.mapInPandas(run, f"query_id {name}, {key} {kind}, score double")
    return some.selectExpr("*", f"row_number() over (partition by query_id order by score desc, {key}) as r").where(F.col("r") <= k).drop("r")


def fuse(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of short ranked lists ``key, score``: the sum of 1 / (60 + rank), ranks from 1.

    The lists are results of top-k searches, so that ranking each in one task
    is bounded by k.
    """
    ranked = None
    for one in lists:
        rank = one.selectExpr(key, f"row_number() over (order by score desc, {key}) as r")
        ranked = rank if ranked is None else ranked.unionByName(rank)
    return ranked.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("r"))), 8).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fuse_all(lists: list[DataFrame], by: str, key: str, k: int) -> DataFrame:
    """``by, key, score``: ``fuse`` for every value of ``by``, which each list has."""
    ranked = None
    for one in lists:
        rank = one.selectExpr(by, key, f"row_number() over (partition by {by} order by score desc, {key}) as r")
        ranked = rank if ranked is None else ranked.unionByName(rank)
    fused = ranked.groupBy(by, key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("r"))), 8).alias("score"))
    return fused.selectExpr("*", f"row_number() over (partition by {by} order by score desc, {key}) as r").where(F.col("r") <= k).drop("r")


def complete(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """Distinct names that start with ``prefix``, letter case ignored."""
    return names.where(F.startswith(F.lower(name), F.lit(prefix.lower()))).select(name).distinct()


def to_embed(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose content hash is not stored yet; equal new items are all kept."""
    return items.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
