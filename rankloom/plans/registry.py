"""All registered queries: name -> (Spark function, comparison SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("rows", "windows", "responses", "marts", "merging", "statistics", "importance")


def registered() -> dict:
    out = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"rankloom.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"rankloom.plans.{name}":
                raise
            continue
        for key, entry in module.QUERIES.items():
            assert key not in out, key
            out[key] = entry
    return out
