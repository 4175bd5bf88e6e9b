"""Names of the registered queries and of their SQL checks."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galewise.plans import model_queries
from galewise.plans import queries as relational
from galewise.plans.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _public(module) -> dict[str, Query]:
    return {
        name: fn
        for name, fn in vars(module).items()
        if inspect.isfunction(fn) and fn.__module__ == module.__name__ and not name.startswith("_")
    }


def all_queries() -> dict[str, Query]:
    return {**_public(relational), **_public(model_queries)}


def all_oracles() -> dict[str, str]:
    return {name: ORACLES[name] for name in all_queries() if name in ORACLES}
