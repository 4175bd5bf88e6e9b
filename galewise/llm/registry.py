"""Names of the corpus queries and of their SQL checks."""

from __future__ import annotations

import inspect

from galewise.llm import queries
from galewise.llm.oracles import ORACLES


def llm_queries() -> dict:
    found = {k: f for k, f in vars(queries).items() if inspect.isfunction(f) and f.__module__ == queries.__name__ and k.startswith("op")}
    import corpus_pipeline

    return {**found, "pipeline": corpus_pipeline.run}


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
