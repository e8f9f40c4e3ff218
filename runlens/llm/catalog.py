"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

from ..session import ship_package

SUBJECTS = ["embedding", "simhash", "langid", "lm", "pii", "linededup", "decontam", "substring", "chat", "packing", "toxicity", "fim", "divergence"]


def _shipped(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def _all(what: str) -> dict:
    out: dict = {}
    for m in SUBJECTS:
        out.update(getattr(importlib.import_module(f"runlens.llm.{m}"), what, {}))
    return out


def queries() -> dict:
    return {k: _shipped(f) for k, f in _all("QUERIES").items()}


def oracle_sql() -> dict:
    return _all("ORACLE")
