"""Greedy packing of a stream: the open chunk of each key is state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.chunking import step


def pack_stream(items: DataFrame, key: str, order: str, text: str, cost: str, ts: str, budget: int, sep: int = 0, joiner: str = "\n", idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, chunk_id, chunk, n_items of a stream, as ``chunking.pack`` gives them of a table; a chunk is out as soon as it is closed.

    A chunk is closed by the item that no longer fits, or when the watermark (``ts``
    less ``late``) is ``idle`` past the key's latest item. A key's items must
    arrive in order from one batch to the next; within a batch they are sorted by
    ``order``. Items behind the watermark are dropped by Spark, so ``late`` must cover
    how far apart keys and batches may be. The state of a key is its open chunk (at most a budget of text, or one
    item) and how many were closed; it stays, so that chunk numbers go on.
    """
    kind = dict(items.dtypes)[key]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, chunk, parts, seen = state.get if state.exists else (0, 0, [], 0)
        parts, out = list(parts), []
        if state.hasTimedOut:
            if parts:
                out.append((own[0], chunk, joiner.join(parts), len(parts)))
                used, chunk, parts = 0, chunk + 1, []
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            for t, c in zip(rows[text], rows[cost]):
                now, number = step(used, chunk, 0 if pd.isna(c) else int(c), budget, sep)
                if number > chunk:
                    out.append((own[0], chunk, joiner.join(parts), len(parts)))
                    parts = []
                used, chunk = now, number
                parts.append(t)
            seen = max(seen, int(rows[ts].max().timestamp() * 1000))
        state.update((used, chunk, parts, seen))
        if parts:
            state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "chunk_id", "chunk", "n_items"])

    rows = items.withWatermark(ts, late).select(key, order, text, cost, ts)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, chunk_id int, chunk string, n_items long", "used long, chunk int, parts array<string>, seen long", "append", GroupStateTimeout.EventTimeTimeout)
