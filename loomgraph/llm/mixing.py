"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topics; a document of several
topics counts in equal parts for each.  Only the tokens of the cells reach the
driver; their number is bounded by the categories.  The cells' weights are raked
to the marginals in turn, each source last and within its cap on repeats, so
that the sources' shares hold exactly.  A document's copies are its weight
rounded: the few with a large part of their source's tokens one by one from the
largest, each up or down as what the source still lacks demands; the others, their
weights scaled to what then is left, by systematic sampling along the source,
from that of a few starts which brings it nearest to its share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

RAKES = 100
ROWS_PER_SHARD = 200_000
STARTS = 16
# part of a source's tokens above which a document is placed on its own; there are no more than one over it of them
BIG = 0.001
# share of the tokens below which a language counts as ``other``
LEAST_LANGUAGE = 0.001
SETTLED = 1e-9


def canonical_source(source: Column) -> Column:
    """A source's usual name: trimmed, lower case, ``-`` and blanks as ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def canonical_language(lang: Column) -> Column:
    """A language code in lower case without region or script; null and blank ones are ``other``."""
    low = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return F.when(low == "", "other").otherwise(F.regexp_extract(low, r"^[^-_\s]*", 0))


Cell = tuple[str, str, "str | tuple[str, ...]"]


@dataclass
class Mix:
    """Weights by ``(source, language, topics)``, the total they give, and the shares aimed at by source, language and topic."""

    weights: dict[Cell, float]
    total: float
    targets: dict[str, float]
    languages: dict[str, float] = field(default_factory=dict)
    topics: dict[str, float] = field(default_factory=dict)


def _names(cell: Cell, axis: int) -> tuple[str, ...]:
    return cell[axis] if isinstance(cell[axis], tuple) else (cell[axis],)


def _sums(amounts: dict[Cell, float], axis: int) -> dict[str, float]:
    sums: dict[str, float] = {}
    for c, t in amounts.items():
        names = _names(c, axis)
        for k in names:
            sums[k] = sums.get(k, 0.0) + t / len(names)
    return sums


def rake(cells: dict[Cell, float], targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = RAKES) -> Mix:
    """Weights for ``cells`` (tokens by source, language and topics).

    ``targets`` has the share and cap of each source.  Sources without tokens,
    share or cap are left out and the other shares scaled up to one.  The
    language and topic marginals are those of the cells themselves.  A cell of
    several topics, a tuple, is scaled by the geometric mean of their factors.
    Without ``total`` the mix is as large as the caps allow with every share met;
    with it, a source that cannot give its share gives all it may.
    """
    have = _sums(cells, 0)
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and have.get(s, 0) > 0}
    if not usable:
        return Mix({}, 0.0, {})
    scale = sum(share for share, _ in usable.values())
    shares = {s: share / scale for s, (share, _) in usable.items()}
    size = min(have[s] * usable[s][1] / shares[s] for s in usable) if total is None else total
    kept = {c: t for c, t in cells.items() if c[0] in usable and t > 0}
    whole = sum(kept.values())
    order = sorted(kept, key=str)
    tokens = np.array([kept[c] for c in order])
    wanted = {axis: {k: v / whole for k, v in _sums(kept, axis).items()} for axis in (1, 2)}
    # for each axis, every pair of a cell and a name of it, and the part of the cell that counts for the name
    links = []
    for axis, share in wanted.items():
        number = {k: i for i, k in enumerate(share)}
        pairs = [(i, number[k], 1 / len(_names(c, axis))) for i, c in enumerate(order) for k in _names(c, axis)]
        cell, name, part = (np.array(x) for x in zip(*pairs, strict=True))
        links.append((cell, name, part, np.array(list(share.values())) * size))
    mine = {s: np.array([i for i, c in enumerate(order) if c[0] == s]) for s in shares}
    weight = np.array([min(usable[c[0]][1], size * shares[c[0]] / have[c[0]]) for c in order], dtype=float)
    for _ in range(rounds):
        before = weight.copy()
        for cell, name, part, due in links:
            got = np.bincount(name, (weight * tokens)[cell] * part, len(due))
            factor = np.log(np.where(got > 0, due / np.where(got > 0, got, 1.0), 1.0))
            weight *= np.exp(np.bincount(cell, factor[name] * part, len(order)))
        for s, at in mine.items():
            weight[at] = _fit(weight[at], tokens[at], shares[s] * size, usable[s][1])
        if (np.abs(weight - before) <= SETTLED * before).all():
            break
    return Mix(dict(zip(order, weight.tolist(), strict=True)), size, shares, *wanted.values())


def _fit(weight: np.ndarray, tokens: np.ndarray, wanted: float, cap: float) -> np.ndarray:
    """The weights scaled by one factor, none above ``cap``, to ``wanted`` tokens if they can give so many."""
    if cap * tokens.sum() <= wanted * (1 + 1e-12):
        return np.full(len(weight), float(cap))
    # between two weights at which another cell reaches the cap, the tokens are linear in the factor
    order = np.argsort(-weight, kind="stable")
    capped = np.concatenate([[0.0], cap * np.cumsum(tokens[order])[:-1]])
    loose = np.cumsum((weight * tokens)[order][::-1])[::-1]
    factor = (wanted - capped) / loose
    return np.minimum(cap, weight * factor[np.argmax(weight[order] * factor <= cap)])


@dataclass
class Held:
    """A source: its cap, documents and tokens, and the tokens it is to give."""

    cap: int
    documents: int = 0
    tokens: float = 0.0
    due: float = 0.0


def _cells(sized: DataFrame, targets: DataFrame, total: float | None) -> tuple[DataFrame, Mix, dict[str, Held]]:
    """The documents that may be used, their raked weights, and what their sources hold."""
    rows = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect() if r.source}
    topics = F.col("topics") if "topics" in sized.columns else F.array(F.col("topic"))
    topics = F.array_sort(F.array_distinct(F.filter(F.coalesce(topics, F.array().cast("array<string>")), lambda t: t.isNotNull())))
    docs = sized.where(F.col("source").isin(*rows) & (F.col("n_tokens") > 0) if rows else F.lit(False)).select(
        "doc_id", "source", F.coalesce("language", F.lit("other")).alias("language"), F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("other"))).alias("topics"), "n_tokens"
    )
    # no more than one over the least share
    whole = docs.agg(F.sum("n_tokens")).scalar()
    common = [r.language for r in docs.groupBy("language").agg(F.sum("n_tokens").alias("t")).where(F.col("t") >= LEAST_LANGUAGE * whole).collect()]
    docs = docs.withColumn("language", F.when(F.col("language").isin(*common), F.col("language")).otherwise("other") if common else F.lit("other"))
    # bounded by sources x languages x sets of topics
    cells = docs.groupBy("source", "language", "topics").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    made = rake({(r.source, r.language, tuple(r.topics)): float(r.t) for r in cells}, rows, total)
    held: dict[str, Held] = {}
    for r in cells:
        h = held.setdefault(r.source, Held(rows[r.source][1]))
        h.documents += r.n
        h.tokens += r.t
        h.due += r.t * made.weights.get((r.source, r.language, tuple(r.topics)), 0.0)
    return docs, made, held


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``doc_id, source, language, topics, n_tokens, weight, copies`` of the documents used.

    ``sized`` has ``doc_id, source, language, n_tokens`` and ``topics`` (array) or
    ``topic``, names already canonical, and should be a written table.  Documents
    of other sources, null sources and those without tokens stay out; null
    languages and documents without a topic are a category ``other``, and so are languages
    with less than ``LEAST_LANGUAGE`` of the tokens.  ``targets`` is a fixed small
    table of ``source, target_share, max_repeats``.  Repeated ids are documents of
    their own.
    """
    return _sampled(*_cells(sized, targets, total))


def _round_big(rows: list, held: dict[str, Held]) -> tuple[list[tuple[str, int, int]], list[tuple[str, float]]]:
    """Copies of the big documents by source and place, and the factor for the weights of a source's other documents."""
    copies: list[tuple[str, int, int]] = []
    lacks, due = dict.fromkeys(held, 0.0), dict.fromkeys(held, 0.0)
    for r in sorted(rows, key=lambda r: (r.source, r.k)):
        due[r.source] += r.weight * r.n_tokens
        lacks[r.source] += r.weight * r.n_tokens
        n = min(math.ceil(r.weight), max(math.floor(r.weight), math.floor(lacks[r.source] / r.n_tokens + 0.5)))
        copies.append((r.source, r.k, n))
        lacks[r.source] -= n * r.n_tokens
    rest = {s: h.due - due[s] for s, h in held.items()}
    return copies, [(s, max(0.0, 1 + lacks[s] / rest[s]) if rest[s] > 1e-9 * held[s].due else 1.0) for s in held]


def _sampled(docs: DataFrame, made: Mix, held: dict[str, Held]) -> DataFrame:
    spark = docs.sparkSession
    rows = [(s, g, list(t), w, held[s].cap, -(-held[s].documents // ROWS_PER_SHARD), held[s].tokens * BIG) for (s, g, t), w in made.weights.items()]
    weights = spark.createDataFrame(rows, "source string, language string, topics array<string>, weight double, cap int, shards int, most double")
    # cells and sources, bounded by the categories
    weighed = docs.join(F.broadcast(weights), ["source", "language", "topics"])
    big = weighed.where("n_tokens > most").selectExpr("*", "row_number() over (partition by source order by n_tokens desc, doc_id, language, topics) as k")
    # at most one over BIG of each source
    copied, factors = _round_big(big.select("source", "k", "weight", "n_tokens").collect(), held)
    big = big.join(F.broadcast(spark.createDataFrame(copied, "source string, k int, copies int")), ["source", "k"])
    small = weighed.where("n_tokens <= most").join(F.broadcast(spark.createDataFrame(factors, "source string, factor double")), "source").withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.col("cap").cast("double")))
    small = small.withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.col("shards")), "part": F.col("weight") - F.floor("weight")})
    # fractions summed along a source: within its shards here, over the shards before by their totals
    within = small.withColumn("upto", F.expr("sum(part) over (partition by source, shard order by n_tokens, doc_id rows between unbounded preceding and current row)"))
    sums = small.groupBy("source", "shard").agg(F.sum("part").alias("sum"))
    before = sums.select("source", "shard", F.expr("coalesce(sum(sum) over (partition by source order by shard rows between unbounded preceding and 1 preceding), 0D)").alias("before"))
    ranked = materialise(within.join(before, ["source", "shard"]).withColumn("upto", F.col("before") + F.col("upto")).drop("before"))

    def copies(start: Column) -> Column:
        n = F.floor("weight") + F.floor(F.col("upto") + start) - F.floor(F.col("upto") - F.col("part") + start)
        # sums of fractions may miss a whole number by a rounding error
        return F.least(F.greatest(n, F.floor("weight")), F.ceil("weight"))

    # of a few starts, the one that brings the source nearest to its share: one row per source
    tried = ranked.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("due"), *[F.sum(copies(F.lit(k / STARTS)) * F.col("n_tokens")).alias(f"s{k}") for k in range(STARTS)]).collect()
    chosen = [(r.source, min(range(STARTS), key=lambda k: (abs(r[f"s{k}"] - r.due), k)) / STARTS) for r in tried]
    starts = spark.createDataFrame(chosen, "source string, start double")
    small = ranked.join(F.broadcast(starts), "source").withColumn("copies", copies(F.col("start")).cast("int"))
    shown = ["doc_id", "source", "language", "topics", "n_tokens", F.round("weight", 6).alias("weight"), "copies"]
    return big.select(*shown).unionByName(small.select(*shown)).where("copies > 0")


def margins(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``axis, name, target_share, actual_share`` of every source, language and topic of the mix by ``mix``."""
    docs, made, held = _cells(sized, targets, None)
    wanted = [(axis, k, v) for axis, shares_ in (("source", made.targets), ("language", made.languages), ("topic", made.topics)) for k, v in shares_.items()]
    used = _sampled(docs, made, held).withColumn("t", F.col("n_tokens") * F.col("copies"))
    split = used.select(F.explode("topics").alias("name"), (F.col("t") / F.size("topics")).alias("t"))
    got = used.groupBy(F.lit("source").alias("axis"), F.col("source").alias("name")).agg(F.sum("t").alias("t"))
    got = got.unionByName(used.groupBy(F.lit("language").alias("axis"), F.col("language").alias("name")).agg(F.sum("t").alias("t")))
    got = got.unionByName(split.groupBy(F.lit("topic").alias("axis"), "name").agg(F.sum("t").alias("t")))
    # one row per category
    whole = F.sum("t").over(Window.partitionBy("axis"))
    share = got.select("axis", "name", (F.col("t") / whole).alias("actual_share"))
    table = docs.sparkSession.createDataFrame(wanted, "axis string, name string, target_share double")
    return table.join(share, ["axis", "name"], "left").select("axis", "name", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce("actual_share", F.lit(0.0)), 6).alias("actual_share"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: wanted and reached share of all tokens, documents, tokens and most copies."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    wanted = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    # one row per source of the fixed table
    total = got.agg(F.sum("n_tokens").alias("total"))
    joined = wanted.join(F.broadcast(got), "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = F.lit(0)
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_tokens", zero).alias("n_tokens"), "max_repeats", F.coalesce("most_copies", zero).alias("most_copies"))
