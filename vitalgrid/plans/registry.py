"""Registered queries: a Spark builder and, where one exists, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Entry:
    name: str
    covers: str
    build: Callable
    sql: str | None


@dataclass
class Registry:
    entries: dict[str, Entry] = field(default_factory=dict)

    def query(self, name: str, covers: str, sql: str | None = None):
        def add(fn):
            if name in self.entries:
                raise ValueError(f"query {name} registered twice")
            self.entries[name] = Entry(name, covers, fn, sql)
            return fn

        return add


REGISTRY = Registry()
query = REGISTRY.query
