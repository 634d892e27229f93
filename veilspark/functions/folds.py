"""Ordered folds over one key's rows, of any number, with the memory of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: str) -> DataFrame:
    """What ``step(state, row)`` gives for every row, ``(new state, values of schema)``, each key from ``start()`` in ``order``.

    One shuffle by key and a sort that spills; the rows then stream past the state, so no key is gathered anywhere, however many
    rows it has.  Null keys are a key of their own.
    """
    columns = rows.columns
    names = [f.split()[0] for f in schema.split(", ")]
    dealt = rows.withColumn("_key", F.to_json(F.struct(*keys))).repartition("_key").sortWithinPartitions("_key", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(b["_key"], b[columns].itertuples(index=False)):
                if row[0] != key:
                    key, state = row[0], start()
                state, values = step(state, row[1])
                out.append(values)
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(run, schema)
