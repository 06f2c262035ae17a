"""Composed plans and the registry of queries."""

from importlib import import_module

SECTIONS = ("profiling", "series", "preparation", "anomalies", "forecasting", "searching", "publishing", "streams")


def load():
    """The catalog with all sections registered."""
    for name in SECTIONS:
        import_module(f"obsflow.plans.{name}")
    return import_module("obsflow.plans.catalog")
