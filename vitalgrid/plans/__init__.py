"""Registered query plans, grouped by the kind of table they work on."""

import importlib
import os

from vitalgrid.plans.registry import REGISTRY

MODULES = ("waves", "tables", "scalars", "epochs", "signals", "evaluation", "selection", "retrieval", "messages", "learning", "streams")


def load_all():
    here = os.path.dirname(__file__)
    for name in MODULES:
        if os.path.exists(os.path.join(here, f"{name}.py")):
            importlib.import_module(f"vitalgrid.plans.{name}")
    return REGISTRY.entries
