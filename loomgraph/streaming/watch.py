"""Watching for changes: sessions of events, debounced batches and a rate limit."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

# fixed value: seconds of rest after repeated failures
REST = 30.0
RELEVANT = r"\.(rs|py|pyi|tsx?|mts|jsx?|mjs|cjs|go|c|h|cpp|cc|hpp|cs|java|kt|kts|swift|md|mdx|json|ya?ml|toml)$"


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """``key, session, n_events``: events parted by ``gap`` of quiet.

    The same for batches and, with a watermark set on ``ts``, for streams,
    whose state is then bounded.  Null times are left out.
    """
    return events.where(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n_events"))


def debounced(changes: DataFrame, ts: str, path: str, quiet: str, late: str) -> DataFrame:
    """``session, root, paths`` of a stream of file changes: the paths of each top folder touched before a quiet time."""
    relevant = changes.where(F.col(path).rlike(RELEVANT) & ~F.col(path).rlike(r"(^|/)(\.git|target|node_modules)/"))
    root = F.element_at(F.split(path, "/"), 1).alias("root")
    return relevant.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("session"), root).agg(F.collect_set(path).alias("paths"))


def _admitted(times: list[float], recent: deque, most: int, span: float) -> list[bool]:
    out = []
    for t in times:
        while recent and t - recent[0] >= span:
            recent.popleft()
        ok = len(recent) < most
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def admit(events: DataFrame, ts: str, key: str, item: str, most: int, span: float) -> DataFrame:
    """``key, item, admitted`` at ``most`` events in ``span`` seconds; refused ones do not count.

    A key's events are folded in order of time: rows arrive sorted within their
    partition, so no key has to fit in memory.
    """
    kinds = dict(events.dtypes)
    secs = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    ordered = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(key, item, secs.alias("__t")).repartition(F.col(key)).sortWithinPartitions(key, "__t", item)

    def run(batches):
        now, recent = None, deque()
        for pdf in batches:
            ok = []
            for k, t in zip(pdf[key], pdf["__t"], strict=True):
                if k != now:
                    now, recent = k, deque()
                ok += _admitted([t], recent, most, span)
            yield pd.DataFrame({key: pdf[key], item: pdf[item], "admitted": ok})

    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {item} {kinds[item]}, admitted boolean")


def admit_stream(events: DataFrame, ts: str, key: str, item: str, most: int, span: float, late: str | None = None) -> DataFrame:
    """As ``admit`` on a stream: the state of a key is the times of at most ``most`` admitted events.

    With ``late``, how far events may be behind, a key's state goes once no event
    that could still come falls within ``span`` of its last one.
    """
    kinds = dict(events.dtypes)
    events = events.withWatermark(ts, late) if late else events

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [])
        for pdf in batches:
            pdf = pdf.sort_values([ts, item], kind="stable")
            times = [t.timestamp() for t in pdf[ts]]
            yield pd.DataFrame({key: pdf[key], item: pdf[item], "admitted": _admitted(times, recent, most, span)})
        state.update((list(recent),))
        if late and recent:
            # never before the watermark, which the state refuses
            state.setTimeoutTimestamp(max(int((recent[-1] + span) * 1000), state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {item} {kinds[item]}, admitted boolean", "recent array<double>", "append", timeout)


def on_batches(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, failures: int = 3, rests: int = 0, rest: float = REST):
    """Start a query that hands every micro-batch to ``update``.

    After so many failures in a row it rests ``rest`` seconds and goes on; after
    ``rests`` of these the query ends with the error.
    """
    failed = rested = 0

    def run(df: DataFrame, n: int) -> None:
        nonlocal failed, rested
        while True:
            try:
                update(df, n)
                failed = rested = 0
                return
            except Exception:
                failed += 1
                if failed >= failures:
                    if rested >= rests:
                        raise
                    rested += 1
                    failed = 0
                    time.sleep(rest)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
