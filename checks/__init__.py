"""Queries over the driver's tables, each with the DuckDB text it must agree with."""

import importlib

MODULES = ("q_flagship", "q_sources", "q_windows", "q_clean", "q_blend", "q_encode", "q_models", "q_influence")


def load():
    from checks.registry import ORACLES, QUERIES

    for m in MODULES:
        importlib.import_module(f"checks.{m}")
    return QUERIES, ORACLES


def _travel_by_value():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_travel_by_value()
