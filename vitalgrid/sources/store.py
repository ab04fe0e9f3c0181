"""A stored table with versions: readers see the old or the new one, never none and never half of one.

``root/data/<id>`` are folders that are written once. ``root/versions/<number>`` lists the folders of a version; it is
written under another name and renamed when its folders are complete, and a number can be taken only once, so of two
writers that start from one version the second fails and starts anew. A reader pins the newest version it finds. Folders
of older versions are removed once ``keep`` newer ones exist.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.sources.files import file_system


class Conflict(RuntimeError):
    """Another writer took the version's number first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.fs, _ = file_system(spark, self.root)

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, oldest first; one per write kept."""
        folder = self._path("versions")
        if not self.fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(folder) if f.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version holds: its folders and notes; of the newest version if none is named."""
        found = self.versions()
        if not found:
            return None
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{version or found[-1]}")
        return json.loads(lines.first()[0])

    def read(self, schema=None, version: int | None = None) -> DataFrame:
        """The table of a version, which later writes do not change."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"nothing is stored under {self.root}")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.format(manifest["format"]).load([f"{self.root}/data/{f}" for f in manifest["folders"]])

    def replace(self, df: DataFrame, notes: dict | None = None, form: str = "parquet") -> int:
        """A new version that holds the rows given and no others."""
        return self._commit(lambda _: [], df, notes, form)

    def append(self, df: DataFrame, notes: dict | None = None, form: str = "parquet", seen: int | None = None) -> int:
        """A new version with the rows added; with ``seen`` only if that version is still the newest."""
        return self._commit(lambda m: m["folders"] if m else [], df, notes, form, seen)

    def _commit(self, kept: Callable, df: DataFrame, notes: dict | None, form: str, seen: int | None = None) -> int:
        numbers = self.versions()
        number = (numbers[-1] if numbers else 0) + 1
        if seen is not None and number != seen + 1:
            raise Conflict(f"{self.root} has version {number - 1}, not {seen}")
        folder = uuid.uuid4().hex
        df.write.format(form).save(f"{self.root}/data/{folder}")
        manifest = {"format": form, "folders": [*kept(self.manifest(numbers[-1]) if numbers else None), folder], "notes": notes or {}}
        draft, final = self._path("versions", f"_{folder}"), self._path("versions", str(number))
        stream = self.fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.root} was written by another")
        self._clean(number)
        return number

    def _clean(self, newest: int) -> None:
        """Removes versions that ``keep`` newer ones follow, and folders that only they hold."""
        old = [v for v in self.versions() if v <= newest - self.keep]
        if not old:
            return
        held = {f for v in self.versions() if v not in old for f in self.manifest(v)["folders"]}
        gone = {f for v in old for f in self.manifest(v)["folders"]} - held
        for v in old:
            self.fs.delete(self._path("versions", str(v)), False)
        for f in gone:
            self.fs.delete(self._path("data", f), True)
