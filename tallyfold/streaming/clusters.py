"""Clusters of purchases as they are filed: the batch operator's trailing window and greedy cooldown, kept as state.

Of each ticker the state holds the purchases that the watermark has not passed, those of the last `days` days before it, and
the day that fired last; all three are bounded by the rows of `days` and the delay. Rows wait until the watermark has passed
their day and are then judged in the order of (day, row_no), so a stream gives the rows that the batch operator gives over all
purchases, whatever the order within the delay and however often the stream is stopped and started again from its checkpoint.
A row later than the delay is dropped; a null owner counts
as one owner, a null value as 0. History is a matter for the batch operator: in a single large batch all of its rows
wait in the state.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH = dt.date(1970, 1, 1)
OUT = "ticker string, day date, row_no long, n_owners int, total_value double"
STATE = "days array<int>, rows array<long>, owners array<string>, values array<decimal(28,4)>, passed int, last int"
DAY_MS = 86_400_000


def live_clusters(purchases: DataFrame, owners: int = 2, value: float = 0.0, days: int = 30, cooldown: int = 30, late: str = "3 days") -> DataFrame:
    """purchases: a stream of ticker, day, row_no, owner and value. Cluster events, each once the watermark has passed its day."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: list[tuple] = list(zip(*state.get[:4])) if state.exists else []
        passed, last = state.get[4:] if state.exists else (-1, None)
        for b in batches:
            held += [((d - EPOCH).days, int(n), o, v) for d, n, o, v in zip(b["day"], b["row_no"], b["owner"], b["value"])]
        held.sort(key=lambda r: r[:2])
        done = state.getCurrentWatermarkMs() // DAY_MS  # days before this one are complete
        out, seen, total, oldest = [], Counter(), Decimal(0), 0
        for day, row, owner, amount in held:
            if day >= done:
                break
            seen[owner] += 1
            total += amount or 0
            while held[oldest][0] < day - days:
                _, _, gone, less = held[oldest]
                seen[gone] -= 1
                if not seen[gone]:
                    del seen[gone]
                total -= less or 0
                oldest += 1
            if day > passed and len(seen) >= owners and total >= value and (last is None or day - last >= cooldown):
                last = day
                out.append((key[0], EPOCH + dt.timedelta(day), row, len(seen), float(total)))
        passed = max(passed, done - 1)
        held = [r for r in held if r[0] >= passed + 1 - days]
        waiting = [r[0] for r in held if r[0] > passed]
        state.update((*([*map(list, zip(*held))] or [[], [], [], []]), passed, last))
        if waiting:
            state.setTimeoutTimestamp(max((min(waiting) + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "day", "row_no", "n_owners", "total_value"])

    p = purchases.select(F.col("ticker").cast("string"), "day", F.col("row_no").cast("long"), F.col("owner").cast("string"), F.col("value").cast("decimal(28,4)"), F.col("day").cast("timestamp").alias("at"))
    return p.withWatermark("at", late).groupBy("ticker").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
