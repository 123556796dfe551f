"""Bounded queues in state: the depth of each and the moving average of its processing times."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolake.streaming.ordered import ROWS, in_order

#: The weight of a new processing time, and the seconds assumed before the first one.
ALPHA, COLD_S = 0.3, 90.0
#: Groups that queues are kept in.
SHARDS = 256
ADMISSION = "queue long, event long, depth long, admitted boolean, retry_after long, wait long, ema double"


class Admission(StatefulProcessor):
    """The queues of a shard: one row of state a queue, whatever the number of its events."""

    def __init__(self, most: int, concurrency: int):
        self.most, self.concurrency = most, max(1, concurrency)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("queues", "queue long", "depth long, ema double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for queue, events in groupby(in_order(rows, ["queue", "event"]), lambda e: int(e.queue)):
            depth, ema = self.state.getValue((queue,)) if self.state.containsKey((queue,)) else (0, None)
            for e in events:
                seconds = COLD_S if ema is None else ema
                retry = wait = None
                admitted = True
                if e.kind == "submit":
                    # a place is taken, and given back if the queue itself refuses the task after all
                    admitted = depth < self.most and not (e.refused is not None and bool(e.refused))
                    if admitted:
                        wait = int(depth / self.concurrency * seconds)
                        depth += 1
                    else:
                        retry = max(1, int(seconds / self.concurrency))
                else:
                    depth = max(depth - 1, 0)
                    if e.seconds is not None and e.seconds > 0:
                        ema = float(e.seconds) if ema is None else ALPHA * float(e.seconds) + (1 - ALPHA) * ema
                out.append((queue, e.event, depth, admitted, retry, wait, ema))
                if len(out) >= ROWS:
                    yield self._frame(out)
                    out.clear()
            self.state.updateValue((queue,), (depth, ema))
        if out:
            yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["queue", "event", "depth", "admitted", "retry_after", "wait", "ema"])
        return frame.astype({"retry_after": "Int64", "wait": "Int64", "ema": "Float64"})


def admissions(events: DataFrame, most: int = 50, concurrency: int = 4) -> DataFrame:
    """events: a stream of queue, event (the order), kind (submit or finish), seconds (of what has finished), refused.

    For each event the depth after it, and for a submit whether it was admitted: where ``most`` are waiting or the
    queue refuses, retry_after says in how many seconds a place is likely free, else wait how long the task has to
    wait. Times that are null or not above 0 don't count; a null queue is left out.
    """
    rows = events.filter(F.col("queue").isNotNull()).select("queue", "event", "kind", F.col("seconds").cast("double").alias("seconds"), "refused")
    shard = F.pmod(F.xxhash64("queue"), F.lit(SHARDS)).alias("shard")  # queues are many and short, so a call takes a shard of them
    return rows.select(shard, "*").groupBy("shard").transformWithStateInPandas(Admission(most, concurrency), ADMISSION, "Append", "None")
