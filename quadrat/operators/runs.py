"""Python over whole groups without a call per group: sorted partitions, cut only between groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _equal(rows: pd.DataFrame, last: pd.Series) -> pd.Series:
    """Which rows have the keys of last; nulls are equal to nulls."""
    return ((rows == last) | (rows.isna() & last.isna())).all(axis=1)


def by_runs(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """function over frames that hold whole groups of keys, many at once; one shuffle by the keys.

    A frame is an Arrow batch, and the group that runs into the next batch waits for it: memory follows
    the largest group, and calls follow batches rather than groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            tail = _equal(batch[keys], batch[keys].iloc[-1]).to_numpy()
            start = len(batch) - int(tail[::-1].argmin()) if not tail.all() else 0
            if start == 0:
                same = held and _equal(held[-1][keys].tail(1), batch[keys].iloc[-1]).all()
                if held and not same:
                    yield function(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch)
            else:
                yield function(pd.concat([*held, batch.iloc[:start]], ignore_index=True))
                held = [batch.iloc[start:]]
        if held:
            yield function(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
