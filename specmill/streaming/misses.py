"""Streams of crawl runs: misses and staleness of products as keyed state, and once-only writing of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_AFTER = 2
OUTPUT = "supplier_id bigint, identity_key string, run bigint, misses int, stale boolean"
STATE = "misses int, last_run bigint"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    misses, last = state.get if state.exists else (0, -1)
    rows = pd.concat(list(frames)).groupby("run", as_index=False)["seen"].max().sort_values("run")
    out = []
    for run, seen in zip(rows["run"], rows["seen"], strict=True):
        if run <= last:  # a run that came before is not counted twice
            continue
        misses, last = (0 if seen else misses + 1), int(run)
        out.append((*key, last, misses, misses >= STALE_AFTER))
    state.update((misses, last))
    yield pd.DataFrame(out, columns=["supplier_id", "identity_key", "run", "misses", "stale"])


def miss_stream(sightings: DataFrame) -> DataFrame:
    """A stream of (supplier_id, identity_key, run, seen), one a product and complete run, as misses after each run.

    State is two numbers a product. Runs must come in order for a product; late ones are left out.
    """
    return sightings.groupBy("supplier_id", "identity_key").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def once(write: Callable[[DataFrame, int], None], done: Callable[[], set[int]]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that leaves out batches written before a restart."""

    def batch(df: DataFrame, number: int) -> None:
        if number not in done():
            write(df, number)

    return batch
