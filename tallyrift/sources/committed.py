"""A table whose changes happen at once or not at all.

Data lie in folders that nothing reads until a version of the log names them; the log's newest version is the table. A
version is written aside and renamed to its number, which fails where another writer was sooner. So a job that is killed leaves files that
nobody reads, readers see one version or the next, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Times that a change is tried anew after another writer's.
TRIES = 20


class Committed:
    """The table at ``path``: _log/<version>.json and data/<folder>/."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("_log")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("_log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The newest version: version, folders, writers (the last batch of each), schema."""
        versions = self._versions()
        if not versions:
            return {"version": -1, "folders": [], "writers": {}, "schema": None}
        file = self._fs.open(self._at(f"_log/{versions[-1]}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def _add(self, state: dict) -> bool:
        """Make ``state`` the newest version; False if there is one of its number."""
        aside, named = self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/{state['version']}.json")
        file = self._fs.create(aside, False)
        try:
            file.write(bytearray(json.dumps(state).encode()))
        finally:
            file.close()
        option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, named, options)
            return True
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        """The rows of the newest version; an error before the first."""
        state = self.state()
        if state["schema"] is None:
            raise ValueError(f"there is no table at {self.path}")
        schema = StructType.fromJson(state["schema"])
        if not state["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in state["folders"]))

    def change(self, make: Callable[[DataFrame | None], DataFrame], replace: bool, writer: str | None = None, batch: int | None = None) -> bool:
        """Add the rows that ``make`` gives for the table as it is, None at first, or put them in its place.

        A ``batch`` of a ``writer`` that isn't beyond the writer's last one is done already: False. Where another writer was sooner,
        ``make`` is asked again for the table that it left.
        """
        for _ in range(TRIES):
            state = self.state()
            if batch is not None and batch <= state["writers"].get(writer, -1):
                return False
            rows = make(self.read() if state["schema"] is not None else None)
            folder = uuid.uuid4().hex
            rows.write.parquet(f"{self.path}/data/{folder}")
            writers = state["writers"] | ({writer: batch} if batch is not None else {})
            if self._add({"version": state["version"] + 1, "folders": [*([] if replace else state["folders"]), folder], "writers": writers, "schema": rows.schema.jsonValue()}):
                return True
            self._fs.delete(self._at(f"data/{folder}"), True)
        raise RuntimeError(f"{self.path} changed {TRIES} times while this change was made")

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        return self.change(lambda _: rows, False, writer, batch)

    def append_first_seen(self, rows: DataFrame, key: str, writer: str | None = None, batch: int | None = None) -> bool:
        """Add the rows whose key the table doesn't have, one of each key."""
        new = rows.dropDuplicates([key])
        return self.change(lambda old: new if old is None else new.join(old.select(key), key, "left_anti").select(*rows.columns), False, writer, batch)

    def overwrite(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        return self.change(lambda _: rows, True, writer, batch)

    def upsert(self, rows: DataFrame, key: list[str], writer: str | None = None, batch: int | None = None) -> bool:
        """Put rows in the place of those with their key; ``rows`` has a key once."""
        return self.change(lambda old: rows if old is None else old.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows), True, writer, batch)

    def compact(self) -> bool:
        """The same rows in one folder; a reader of an older version still finds its own until ``clean``."""
        return self.change(lambda old: old, True)

    def clean(self) -> None:
        """Delete versions before the newest and data that it doesn't name. Not while a change is being made."""
        state = self.state()
        for v in self._versions()[:-1]:
            self._fs.delete(self._at(f"_log/{v}.json"), False)
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() not in state["folders"]:
                    self._fs.delete(s.getPath(), True)
