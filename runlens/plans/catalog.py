"""All registered queries and their DuckDB oracles, merged from the subject
modules.  ``__spark_entry__`` exposes these to the driver."""

from __future__ import annotations

import importlib

from ..session import ship_package

# Subject modules, each exporting QUERIES (key -> fn(spark, sf_dir)) and
# ORACLE (key -> DuckDB SQL; absent for keys checked by golden tests only).
SUBJECTS = ["selection", "steps", "testruns", "patches", "replies", "documents", "edits", "symbols", "instances", "files", "live"]


def _modules():
    return [importlib.import_module(f"runlens.plans.{m}") for m in SUBJECTS]


def _shipped(fn):
    """Each query first makes the package importable on the executors."""
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        dup = set(out) & set(m.QUERIES)
        if dup:
            raise RuntimeError(f"duplicate query keys {dup}")
        out.update({k: _shipped(f) for k, f in m.QUERIES.items()})
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(getattr(m, "ORACLE", {}))
    return out
