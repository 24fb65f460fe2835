"""All registered queries and their plain-SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("ranking", "stored", "finding", "lifecycle", "graphs", "curation")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"recallspark.suite.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
