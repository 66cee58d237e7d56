"""Streaming twins of the folds, and statistics over event time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful(df: DataFrame, keys: list[str], order: list[str], step, outputs: str) -> DataFrame:
    """A streaming df with the columns of outputs: the rule step (see trailnet.operators.folds) with its state kept between micro-batches.

    Rows of a micro-batch go in order; a row that arrives in a later batch comes after all of the earlier ones.
    """
    names = df.columns
    extra = [x.split()[0] for x in outputs.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(key, batches, held: GroupState):
        state = tuple(json.loads(held.get[0])) if held.exists else None
        for pdf in [pd.concat(list(batches))]:
            pdf = pdf.sort_values(order, kind="stable")
            got = {c: [] for c in extra}
            for row in pdf.to_dict("records"):
                state, out = step(state, row)
                for c in extra:
                    got[c].append(out[c])
            held.update((json.dumps(state),))
            yield pdf[names].assign(**{c: pd.Series(v, index=pdf.index, dtype=object) for c, v in got.items()})

    return df.groupBy(*keys).applyInPandasWithState(run, f"{schema}, {outputs}", "state string", "append", GroupStateTimeout.NoTimeout)


def dedup_fixes(df: DataFrame, keys: list[str], time: str, late: str = "15 minutes") -> DataFrame:
    """Repeated fixes (equal keys and time) once, while they are no later than late."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, time])


def session_counts(df: DataFrame, keys: list[str], time: str, gap: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Fixes per key and session: stretches of rows no more than gap apart."""
    return df.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("fixes"))


def window_counts(df: DataFrame, keys: list[str], time: str, size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Fixes per key and window. late None: df has its watermark already."""
    return (df.withWatermark(time, late) if late else df).groupBy(*keys, F.window(time, size).alias("window")).agg(F.count("*").alias("fixes"))
