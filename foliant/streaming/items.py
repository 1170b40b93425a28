"""The life of work items as a keyed state that their events change: claims, leases, progress, retries, ends.

The state of an item is folded from its events in the order of their time, across micro-batches; Spark keeps it in the
checkpoint, so a lost executor or a restart goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("COMPLETED", "FAILED", "CANCELED")
#: Percent that a claimed item has at least.
CLAIMED = 5


class Life(NamedTuple):
    """status; progress in percent, never falling within an attempt; retries; refused: claims and requests that did not fit
    the status; late: events after the end; timeouts: attempts whose lease ran out; expires: when the lease does."""

    status: str = "QUEUED"
    progress: int = 0
    retries: int = 0
    refused: int = 0
    late: int = 0
    timeouts: int = 0
    expires: int | None = None


def step(life: Life, at: int, kind: str, value: float | None, ttl: int | None, max_retries: int) -> Life:
    """The life after an event. Without a ttl there are no claims and leases: an item runs from the first.

    A running item whose lease ran out before the event was queued again then, or failed if it was tried often enough. The
    first end stays; what comes after it is late. Only queued items are claimed; progress renews the lease."""
    if ttl is not None and life.status == "PROCESSING" and life.expires < at:
        again = life.retries < max_retries
        life = life._replace(status="QUEUED" if again else "FAILED", retries=life.retries + again, progress=0 if again else life.progress, timeouts=life.timeouts + 1, expires=None)
    if life.status in TERMINAL:
        return life._replace(late=life.late + 1)
    if kind in TERMINAL:
        return life._replace(status=kind, progress=100, expires=None)
    runs = ttl is None or life.status == "PROCESSING"
    if kind == "STARTED" and not runs:
        return life._replace(status="PROCESSING", progress=max(CLAIMED, life.progress), expires=at + ttl)
    if kind == "PROGRESS" and runs:
        return life._replace(progress=max(life.progress, min(100, int(value or 0))), expires=None if ttl is None else at + ttl)
    if kind == "RETRY_REQUESTED" and runs:
        return life._replace(status="QUEUED", progress=0, retries=life.retries + 1, expires=None)
    return life._replace(refused=life.refused + 1)


def lives(events: DataFrame, key: str, ttl: int | None = None, max_retries: int = 3) -> DataFrame:
    """key and the fields of Life of each item that a micro-batch of a stream changes. events: key, at, id, kind, value; the
    rows of an item in a batch are put in the order of at, then id. Events without a key or a time are left out."""

    def fold(item: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = Life(*state.get) if state.exists else Life()
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        for at, kind, value in zip(rows["at"].tolist(), rows["kind"].tolist(), rows["value"].tolist()):
            life = step(life, at, kind, None if pd.isna(value) else value, ttl, max_retries)
        state.update(tuple(life))
        yield pd.DataFrame([[*item, *life]], columns=[key, *Life._fields]).astype({"expires": "Int64"})

    state = "status string, progress long, retries long, refused long, late long, timeouts long, expires long"
    known = events.filter(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, "at", "id", "kind", "value")
    kind = events.schema[key].dataType.simpleString()
    return known.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {state}", state, "update", GroupStateTimeout.NoTimeout)
