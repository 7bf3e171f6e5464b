"""Filling containers of fixed capacity: a configuration linear program over the histogram of lengths.

The histogram has a count for every length up to the capacity, however many
items there are, and all of it is in the program.  A configuration says how many
items of each length share a container.  Every length has a price; a bounded
knapsack dynamic program gives for each length the configuration of greatest
worth that holds it, and the best of these are raised until a part of the need
of some length is met, whose worth then falls exponentially with its cover.  Of
the configurations of one round, those that an earlier one left too few items for
take what is left and the greatest lengths that fit.  One pass covers everything.  Between passes the prices themselves are updated by
multiplicative weights: lengths that were placed in containers of little worth
become dearer.  Prices over the greatest worth of a configuration are a solution
of the dual, and so a bound that no packing can beat; passes end at a gap to it
of ``GAP``.  Amounts are rounded down, and what that leaves, less than the items
of one container for each configuration, is filled greatest length first.  Items
are then numbered within their length and sent to their container by that number.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# passes end at this gap between containers and bound, or where neither has moved for so many passes
GAP, STILL = 0.0005, 4
PASSES = 40
# part of a length's need that one configuration may meet in one round, fall of its worth with its cover, and step of the prices
STEP, RATE, ETA = 0.25, 0.01, 0.5
# how far below the best of a round a configuration's worth may be, and by what that grows with each round
SLACK, WIDER = 0.002, 1.6
# among equal worths, how far a configuration of the greatest lengths is above one of the least
TIE = 0.002
ROWS_PER_SHARD = 200_000


@dataclass
class Plan:
    """``runs`` of equal containers, each with its configuration ``{length: copies}`` and amount.

    ``bound`` is the program's dual bound, ``greedy`` the containers that filling
    by greatest length alone takes, ``by_program`` the items placed by the program.
    """

    capacity: int
    runs: list[tuple[dict[int, int], int]] = field(default_factory=list)
    bound: int = 0
    greedy: int = 0
    by_program: int = 0
    passes: int = 0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.runs)


class Knapsack:
    """Greatest worth for every room up to the capacity, no length more often than ``most``."""

    def __init__(self, capacity: int, lengths: np.ndarray, worth: np.ndarray, most: np.ndarray) -> None:
        self.best = np.zeros(capacity + 1)
        # each length in bundles of 1, 2, 4, ... copies, which together make any number of them
        self.bundles: list[tuple[int, int, int, np.ndarray]] = []
        for k, s in enumerate(lengths.tolist()):
            left, size = min(int(most[k]), capacity // s), 1
            while left > 0:
                n = min(size, left)
                left -= n
                size *= 2
                w = n * s
                with_it = self.best[:-w] + n * worth[k]
                better = with_it > self.best[w:] + 1e-12
                self.best[w:] = np.where(better, with_it, self.best[w:])
                self.bundles.append((k, n, w, np.packbits(better)))

    def configurations(self, rooms: np.ndarray) -> list[dict[int, int]]:
        """For each room the copies, by index of the length, that give its greatest worth."""
        rooms = rooms.copy()
        out: list[dict[int, int]] = [{} for _ in rooms]
        for k, n, w, better in reversed(self.bundles):
            at = rooms - w
            fits = at >= 0
            at[~fits] = 0
            taken = np.flatnonzero(fits & (((better[at >> 3] >> (7 - (at & 7))) & 1) > 0))
            if len(taken):
                rooms[taken] -= w
                for i in taken.tolist():
                    out[i][k] = out[i].get(k, 0) + n
        return out


def price(capacity: int, lengths: np.ndarray, worth: np.ndarray, most: np.ndarray) -> dict[int, int]:
    """The configuration of greatest worth by knapsack dynamic programming over the capacity."""
    return Knapsack(capacity, lengths, worth, most).configurations(np.array([capacity]))[0]


def _refilled(capacity: int, shape: dict[int, int], left: np.ndarray, number: dict[int, int], there: list[int]) -> dict[int, int]:
    """As much of a configuration as is left, filled up with the greatest lengths of ``there`` (sorted) that fit."""
    out = {s: k for s, n in shape.items() if (k := min(n, int(left[number[s]] + 1e-9))) > 0}
    room, at = capacity - sum(s * n for s, n in out.items()), len(there)
    while (at := bisect_right(there, room, 0, at)) > 0:
        s = there[at - 1]
        n = min(int(left[number[s]] + 1e-9) - out.get(s, 0), room // s)
        if n > 0:
            out[s] = out.get(s, 0) + n
            room -= n * s
        at -= 1
    return out


def cover(capacity: int, lengths: np.ndarray, need: np.ndarray, prices: np.ndarray) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Amounts of configurations that cover all but less than one item of each length, and the dual bound of the prices."""
    left = need.astype(float)
    number = {s: k for k, s in enumerate(lengths.tolist())}
    used: dict[tuple[tuple[int, int], ...], float] = {}
    bound, slack = 0.0, SLACK
    while True:
        open_ = np.flatnonzero(left >= 1 - 1e-9)
        if not len(open_):
            return [(dict(c), x) for c, x in used.items()], bound
        worth = prices[open_] * np.exp(-RATE * (1 - left[open_] / need[open_])) * (1 + TIE * lengths[open_] / capacity)
        most = np.floor(left[open_] + 1e-9)
        sack = Knapsack(capacity, lengths[open_], worth, most)
        if not used:
            bound = float((need * worth).sum() / sack.best[capacity])
        worth_of = dict(zip(lengths[open_].tolist(), worth.tolist(), strict=True))
        rooms = capacity - lengths[open_]
        value = worth + sack.best[rooms]
        near = np.flatnonzero(value >= (1 - slack) * value.max())
        near = near[np.argsort(-value[near], kind="stable")]
        floor = (1 - slack) * value.max()
        there = sorted(lengths[open_].tolist())
        for own, config in zip(near.tolist(), sack.configurations(rooms[near]), strict=True):
            # the knapsack may have taken all there are already
            config[own] = min(config.get(own, 0) + 1, int(most[own]))
            shape = {int(lengths[open_[k]]): n for k, n in config.items()}
            if any(left[number[s]] < n - 1e-9 for s, n in shape.items()):
                # others of this round have used some up: what is left of it, and the greatest that fit beside
                shape = _refilled(capacity, shape, left, number, there)
                if not shape or sum(worth_of[s] * n for s, n in shape.items()) < floor:
                    continue
            index, copies = np.array([number[s] for s in shape]), np.array(list(shape.values()))
            amount = min(float((left[index] / copies).min()), max(1.0, float((STEP * need[index] / copies).min())))
            left[index] -= amount * copies
            key = tuple(sorted(shape.items()))
            used[key] = used.get(key, 0.0) + amount
            for k, s in zip(index.tolist(), shape, strict=True):
                if left[k] < 1 - 1e-9 and there[(at := bisect_left(there, s)) : at + 1] == [s]:
                    del there[at]
        slack *= WIDER


def solve(histogram: dict[int, int], capacity: int, passes: int = PASSES, gap: float = GAP) -> Plan:
    """Containers for ``histogram`` (length to count, lengths from 1 to the capacity).

    Of the passes' roundings the one with fewest containers is taken, and
    filling by greatest length alone where that takes fewer still.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    alone = fill(counts, capacity)
    best = Plan(capacity, alone, greedy=sum(n for _, n in alone))
    if not counts:
        return best
    lengths = np.array(sorted(counts, reverse=True), dtype=np.int64)
    need = np.array([counts[s] for s in lengths.tolist()], dtype=float)
    number = {s: k for k, s in enumerate(lengths.tolist())}
    prices = lengths / capacity
    bound, fewest, still, done = float((need * prices).sum()), None, 0, 0
    while done < passes and still < STILL:
        amounts, dual = cover(capacity, lengths, need, prices)
        done += 1
        runs, left = [], dict(counts)
        for config, amount in sorted(amounts, key=lambda x: sorted(x[0].items())):
            n = int(amount + 1e-9)
            if n:
                runs.append((config, n))
                for s, c in config.items():
                    left[s] -= n * c
        rest = fill(left, capacity)
        total = sum(n for _, n in runs) + sum(n for _, n in rest)
        still = 0 if fewest is None or total < fewest or dual > bound * (1 + gap / 10) else still + 1
        bound = max(bound, dual)
        if fewest is None or total < fewest:
            fewest = total
            # as good as the other way counts as the program's
            if total <= best.containers:
                best.runs, best.by_program = runs + rest, sum(need.astype(int).tolist()) - sum(left.values())
        if fewest <= max(np.ceil(bound - 1e-6), bound * (1 + gap)):
            break
        # how dear each length came: the containers it was in, by what their worth falls short of
        dear = np.zeros(len(lengths))
        for config, amount in [*amounts, *rest]:
            worth = sum(prices[number[s]] * c for s, c in config.items())
            for s, c in config.items():
                dear[number[s]] += amount * c / worth
        dear /= need
        prices = prices * (dear / (dear * need).sum() * need.sum()) ** ETA
        prices /= prices.max()
    best.bound, best.passes = int(np.ceil(bound - 1e-6)), done
    return best


def fill(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Greatest length first, then always the greatest that still fits; equal containers as one group.

    Every group uses up a length, so there are no more groups than lengths.
    """
    counts = {s: n for s, n in left.items() if n > 0}
    sizes = sorted(counts)
    out = []
    while sizes:
        room, config, at = capacity, {}, len(sizes)
        while True:
            at = bisect_right(sizes, room, 0, at)
            if at == 0:
                break
            s = sizes[at - 1]
            n = min(counts[s], room // s)
            config[s] = n
            room -= n * s
            at -= 1
        amount = min(counts[s] // n for s, n in config.items())
        out.append((config, amount))
        for s, n in config.items():
            counts[s] -= amount * n
            if not counts[s]:
                sizes.remove(s)
                del counts[s]
    return out


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``pack_all`` for one capacity, without the column ``capacity``."""
    return pack_all(items, [capacity])[0].drop("capacity")


def pack_all(items: DataFrame, capacities: list[int]) -> tuple[DataFrame, dict[int, Plan]]:
    """``capacity, doc_id, piece_no, token_start, n_tokens, container_id`` for ``items(doc_id, n_tokens)``, and the plans.

    An item that exceeds the capacity is split: full containers of its own and
    one rest, which is packed like any item.  Items without tokens (and those
    with a null size) go into container 0.  Repeated ids are items of their
    own.  An empty table or no capacity gives no rows.  ``items`` should be a written table,
    as it is read several times.
    """
    spark = items.sparkSession
    if not capacities:
        return spark.createDataFrame([], f"capacity int, doc_id {dict(items.dtypes)['doc_id']}, piece_no int, token_start long, n_tokens long, container_id long"), {}
    shards = -(-items.count() // ROWS_PER_SHARD) or 1
    size = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long")
    base = items.select(F.explode(F.array(*[F.lit(c) for c in sorted(set(capacities))])).alias("capacity"), "doc_id", size.alias("n"), F.pmod(F.xxhash64("doc_id", size), F.lit(shards)).alias("shard"))
    full, rest = F.expr("n div capacity"), F.col("n") % F.col("capacity")
    rests = base.where(rest > 0).select("capacity", "doc_id", full.cast("int").alias("piece_no"), (full * F.col("capacity")).alias("token_start"), rest.alias("n_tokens"), "shard")
    # items of one length are numbered shard by shard, so that no length is in one task
    counts = rests.groupBy("capacity", "n_tokens", "shard").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("capacity", "n_tokens", "shard", F.expr("coalesce(sum(n) over (partition by capacity, n_tokens order by shard rows between unbounded preceding and 1 preceding), 0L)").alias("start"))
    within = rests.selectExpr("*", "row_number() over (partition by capacity, n_tokens, shard order by doc_id, token_start) as k")
    numbered = within.join(starts, ["capacity", "n_tokens", "shard"]).select("capacity", "doc_id", "piece_no", "token_start", "n_tokens", (F.col("start") + F.col("k") - 1).alias("number"))
    plans = _plans(counts, sorted(set(capacities)))
    held = spark.sparkContext.broadcast({c: _places(plan) for c, plan in plans.items()})

    def place(batches):
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            number = pdf.number.to_numpy()
            for (c, s), at in pdf.groupby(["capacity", "n_tokens"]).indices.items():
                ends, to = held.value[c][s]
                begin, first, copies = to[np.searchsorted(ends, number[at], side="right")].T
                container[at] = first + (number[at] - begin) // copies
            yield pdf.drop(columns="number").assign(container_id=container)

    kind = dict(items.dtypes)["doc_id"]
    packed = numbered.mapInPandas(place, f"capacity int, doc_id {kind}, piece_no int, token_start long, n_tokens long, container_id long")
    # containers of one piece each, numbered from behind the others by the place of their document
    big = base.where(full > 0).withColumn("f", full)
    sums = big.groupBy("capacity", "shard").agg(F.sum("f").alias("f"))
    offsets = sums.select("capacity", "shard", F.expr("coalesce(sum(f) over (partition by capacity order by shard rows between unbounded preceding and 1 preceding), 0L)").alias("offset"))
    before = F.expr("coalesce(sum(f) over (partition by capacity, shard order by doc_id, n rows between unbounded preceding and 1 preceding), 0L)")
    behind = F.create_map(*[F.lit(x) for c, plan in plans.items() for x in (c, plan.containers)])[F.col("capacity")]
    own = big.withColumn("before", before).join(offsets, ["capacity", "shard"]).select("capacity", "doc_id", "f", (behind + F.col("offset") + F.col("before")).alias("c0"))
    own = own.select("capacity", "doc_id", "c0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("f") - 1)).alias("p"))
    own = own.select("capacity", "doc_id", F.col("p").cast("int").alias("piece_no"), (F.col("p") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("long").alias("n_tokens"), (F.col("c0") + F.col("p")).cast("long").alias("container_id"))
    zero = F.lit(0).cast("long")
    empty = base.where("n = 0").select("capacity", "doc_id", F.lit(0).alias("piece_no"), zero.alias("token_start"), zero.alias("n_tokens"), zero.alias("container_id"))
    return packed.unionByName(own).unionByName(empty), plans


def _plans(counts: DataFrame, capacities: list[int]) -> dict[int, Plan]:
    """The plan of each capacity; each is made in a task of its own from at most as many counts as the capacity."""

    def make(key, pdf):
        plan = solve({int(s): int(n) for s, n in zip(pdf.n_tokens, pdf.n, strict=True)}, int(key[0]))
        return pd.DataFrame([(plan.capacity, plan.bound, plan.greedy, plan.by_program, plan.passes, [n for _, n in plan.runs], [list(c) for c, _ in plan.runs], [list(c.values()) for c, _ in plan.runs])], columns=names)

    schema = "capacity int, bound long, greedy long, by_program long, passes int, amounts array<long>, lengths array<array<int>>, copies array<array<int>>"
    names = [c.split()[0] for c in schema.split(", ")]
    made = counts.groupBy("capacity", "n_tokens").agg(F.sum("n").alias("n")).groupBy("capacity").applyInPandas(make, schema)
    plans = {c: Plan(c) for c in capacities}
    for r in made.collect():
        runs = [(dict(zip(s, k, strict=True)), n) for n, s, k in zip(r.amounts, r.lengths, r.copies, strict=True)]
        plans[r.capacity] = Plan(r.capacity, runs, r.bound, r.greedy, r.by_program, r.passes)
    return plans


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, where stretches of its items end, and for each stretch its first item, first container and copies in one."""
    stretches: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for config, amount in plan.runs:
        for s, n in config.items():
            mine = stretches.setdefault(s, [])
            begin = mine[-1][0] if mine else 0
            mine.append((begin + n * amount, begin, first, n))
        first += amount
    return {s: (np.array([x[0] for x in rows]), np.array([x[1:] for x in rows])) for s, rows in stretches.items()}


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """``n_containers, n_items, n_tokens, fill, fewest``: one row; ``fewest`` is the least number any packing needs."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest")).withColumns(
        {"fill": F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6), "fewest": F.ceil(F.col("n_tokens") / capacity)}
    )
