"""Aggregates of the user's own, mergeable, in two phases.

``init()`` makes a state, ``update(state, pdf)`` takes rows in, ``merge(a, b)``
joins two states, ``finish(state)`` gives the result's values.  Each task folds its
own rows of every key into one state; only states are shuffled, so a key of any
size meets as one small row from each task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import ship

HELD = 10_000  # keys whose states a task holds before it hands them on
FAN_IN = 64  # states of a key that one task merges in the middle phase, about


@dataclass(frozen=True)
class Aggregate:
    init: Callable[[], object]
    update: Callable
    merge: Callable[[object, object], object]
    finish: Callable[[object], tuple]
    schema: str  # of finish's values

    def over(self, df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """``keys`` and the aggregate's values over ``columns`` of each key's rows,
        in no order.  Null keys are keys; without keys an empty table gives no
        row."""
        import pandas as pd

        ship(df.sparkSession)
        own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        init, update, merge, finish, held_keys = self.init, self.update, self.merge, self.finish, HELD
        names = [f.split()[0] for f in self.schema.split(",")]

        def packed(states: dict):
            values = list(zip(*states.keys(), strict=True)) if keys else []
            return pd.DataFrame({**{k: pd.Series(list(v), dtype=object) for k, v in zip(keys, values, strict=True)}, "state": [pickle.dumps(s) for s in states.values()]})

        def fold(parts):
            states: dict = {}
            for pdf in parts:
                groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
                for key, rows in groups:
                    key = tuple(None if k != k or k is None else k for k in (key if isinstance(key, tuple) else (key,))) if keys else ()
                    states[key] = update(states[key] if key in states else init(), rows[columns])
                if len(states) > held_keys:
                    yield packed(states)
                    states = {}
            if states:
                yield packed(states)

        def joined(pdf: pd.DataFrame):
            state = None
            for blob in pdf["state"]:
                other = pickle.loads(blob)  # noqa: S301  made by our own tasks
                state = other if state is None else merge(state, other)
            return state

        def some(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "state": [pickle.dumps(joined(pdf))]})

        def last(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{n: [v] for n, v in zip(names, finish(joined(pdf)), strict=True)}})

        state_schema = f"{own}, state binary" if keys else "state binary"
        states = df.select(*keys, *[c for c in columns if c not in keys]).mapInPandas(fold, state_schema)
        # Many tasks' states of one key meet in groups of FAN_IN first.
        from pyspark.sql import functions as F

        part = F.spark_partition_id() / F.lit(FAN_IN)
        some_states = states.withColumn("_part", F.floor(part)).groupBy(*keys, "_part").applyInPandas(lambda pdf: some(pdf.drop(columns=["_part"])), state_schema)
        return some_states.groupBy(*keys).applyInPandas(last, f"{own}, {self.schema}" if keys else self.schema)
