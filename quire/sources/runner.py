"""Model runners: a protocol, its use in Arrow batches, and fall-back between back ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Runner(Protocol):
    """A model: loaded once a worker, called with batches of rows, returns rows of ``schema``."""

    schema: str

    def load(self) -> None: ...

    def run(self, rows: pd.DataFrame) -> pd.DataFrame: ...


_LOADED: dict[str, Runner] = {}


def loaded(make: Callable[[], Runner], name: str) -> Runner:
    """The worker's instance of a runner; made and loaded at its first use."""
    if name not in _LOADED:
        runner = make()
        runner.load()
        _LOADED[name] = runner
    return _LOADED[name]


def apply_runner(df: DataFrame, make: Callable[[], Runner], name: str, schema: str, fallback: Callable[[], Runner] | None = None) -> DataFrame:
    """``df`` through a model in Arrow batches; a batch that fails goes to ``fallback``, if there is one.

    Filters belong before this call: the optimiser can't move them through it.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for rows in batches:
            try:
                yield loaded(make, name).run(rows)
            except Exception:
                if fallback is None:
                    raise
                yield loaded(fallback, f"{name}-fallback").run(rows)

    return df.mapInPandas(run, schema)


class Identity:
    """Gives its rows back; stands for a model in tests."""

    schema = ""

    def load(self) -> None:
        pass

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows
