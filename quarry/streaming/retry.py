"""Retry state by repository as a stateful stream: attempts, last outcome, and when it may be fetched again."""

from __future__ import annotations

from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame

from quarry import tables

STATE = "attempts long, status string, retry_at double"
OUT = "repo string, attempts long, status string, retry_at double, accepted boolean"


def delay(state: str, retry_after: str | None, now: float) -> float:
    """Seconds until the next try; a server's wish is a number of seconds or an HTTP date, as in identity.retry_seconds."""
    if state == "rate_limited":
        try:
            return max(float(tables.RETRY_FLOOR), float(retry_after))
        except (TypeError, ValueError):
            pass
        try:
            return max(float(tables.RETRY_FLOOR), parsedate_to_datetime(retry_after).timestamp() - now)
        except (TypeError, ValueError, OverflowError):
            pass
    return float(tables.RETRY_SECONDS[state])


def retry_states(outcomes: DataFrame) -> DataFrame:
    """Stream of (repo, at seconds, state, retry_after) to one row a repository and batch.

    Outcomes count in order of time; one that comes before the repository may
    be fetched again is not accepted and changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, status, retry_at = state.get if state.exists else (0, None, float("-inf"))
        accepted = False
        rows = pd.concat(list(batches)).sort_values(["at", "state"])
        for r in rows.itertuples(index=False):
            if r.at < retry_at:
                continue
            attempts, status, retry_at, accepted = attempts + 1, r.state, r.at + delay(r.state, r.retry_after, r.at), True
        state.update((attempts, status, retry_at))
        yield pd.DataFrame({"repo": [key[0]], "attempts": [attempts], "status": [status], "retry_at": [retry_at], "accepted": [accepted]})

    return outcomes.groupBy("repo").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")
