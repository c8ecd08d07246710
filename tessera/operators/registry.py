"""A registry of schema versions for many entities, in a folder, for any number of writers.

Rows lie in Parquet folders; a numbered log entry, which is made only if no other writer has made it, names the folder that it
adds. Whoever comes second reads again and decides anew, so no version is lost or given twice. Compaction writes one folder of
all rows and an entry that readers start from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import governance
from tessera.operators.governance import latest
from tessera.operators.nesting import PATH_SCHEMA, path_rows

REGISTRY_SCHEMA = "entity string, version int, table_name string, schema_hash string, at timestamp, breaking boolean, summary string, schema string, inside array<string>, entry long"


class Conflict(RuntimeError):
    """Another writer was faster, again and again."""


def versions(registry: DataFrame) -> DataFrame:
    """One row a version: when it was made and last changed, its present state, and all its changes in order."""
    last = F.struct("entry", "schema_hash", "schema", "inside")
    said = F.array_sort(F.collect_list(F.struct("entry", "summary")))
    rows = registry.groupBy("entity", "version").agg(
        F.max(last).alias("last"), F.min("at").alias("generated_at"), F.max("at").alias("modified_at"), F.min_by("breaking", "entry").alias("breaking"), said.alias("said"), F.count(F.lit(1)).alias("states"),
    )
    text = F.array_join(F.filter(F.transform("said", lambda s: s["summary"]), lambda s: s != ""), ",")
    return rows.select("entity", "version", F.concat_ws("_v", "entity", F.col("version").cast("string")).alias("table_name"), "last.schema_hash", "generated_at", "modified_at", "breaking", text.alias("summary"), "states", "last.schema", "last.inside")


class Registry:
    """See the module. The file system's rename has to fail where the target is there; for local files a link does that."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _publish(self, number: int, entry: dict) -> bool:
        """Make log entry ``number``, whole, unless it is there."""
        target, draft = self._at(f"_log/{number:020d}.json"), self._at(f"_log/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._files.getUri().getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(local(target), local(draft))
                except Py4JJavaError as e:
                    if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                        raise
                    return False
                return True
            return not self._files.exists(target) and self._files.rename(draft, target)
        finally:
            self._files.delete(draft, False)

    def _entries(self) -> list[int]:
        folder = self._at("_log")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _entry(self, number: int) -> dict:
        stream = self._files.open(self._at(f"_log/{number:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> tuple[int, list[str]]:
        """The number of the last entry, and the folders that hold the rows as of it."""
        numbers, folders = self._entries(), []
        for n in reversed(numbers):
            entry = self._entry(n)
            folders.append(entry["folder"])
            if entry["whole"]:
                break
        return (numbers[-1] if numbers else 0), folders[::-1]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(*(f"{self.path}/{f}" for f in folders))

    def rows(self) -> DataFrame:
        return self._read(self.state()[1])

    def current(self, entity: str):
        return latest(self.rows().where(F.col("entity") == entity)).first()

    def commit(self, make: Callable[[DataFrame], DataFrame], tries: int = 20, whole: bool = False) -> int:
        """Append what ``make`` gives for the rows known, with columns of REGISTRY_SCHEMA but ``at`` and ``entry``; the number of rows.

        Where another writer was faster, ``make`` is asked again with what is known then.
        """
        for _ in range(tries):
            number, folders = self.state()
            folder = f"rows-{uuid.uuid4().hex}"
            made = make(self._read(folders))
            at = F.coalesce("at", F.current_timestamp()) if "at" in made.columns else F.current_timestamp()
            entry = F.coalesce("entry", F.lit(number + 1).cast("long")) if "entry" in made.columns else F.lit(number + 1).cast("long")
            made = made.withColumns({"at": at, "entry": entry}).select(*(c.split()[0] for c in REGISTRY_SCHEMA.split(", ")))
            made.write.parquet(f"{self.path}/{folder}")
            n = self._read([folder]).count()
            if (n or whole) and self._publish(number + 1, {"folder": folder, "whole": whole}):
                return n
            self._files.delete(self._at(folder), True)
            if not n and not whole:
                return 0
        raise Conflict(f"{self.path}: no entry after {tries} tries")

    def compact(self) -> int:
        """One folder of all rows, from which readers start; rows of writers at the same time stay. Older folders are for :meth:`clean`."""
        return self.commit(lambda known: known.coalesce(1), whole=True)

    def clean(self) -> int:
        """Delete the folders that readers no longer start from; to be called when no reader of an older state is left."""
        gone = 0
        numbers = self._entries()
        starts = [n for n in numbers if self._entry(n)["whole"]]
        for n in numbers:
            if starts and n < starts[-1]:
                self._files.delete(self._at(self._entry(n)["folder"]), True)
                self._files.delete(self._at(f"_log/{n:020d}.json"), False)
                gone += 1
        return gone

    def put_all(self, fields: DataFrame, policy: str = "AUTO") -> int:
        """Record every entity's schema under a policy; ``fields`` are rows of names, types, modes and descriptions, nested ones by path."""
        # Some rows a column each, of which several steps take their part.
        new = governance.with_nested(fields).persist()
        held = []

        def make(known: DataFrame) -> DataFrame:
            last = latest(known).persist()
            changes = governance.diff(governance.known_columns(last), new).persist()
            held.extend((last, changes))
            return governance.next_versions(last, new, changes, policy)

        try:
            return self.commit(make)
        finally:
            for df in (new, *held):
                df.unpersist()

    def put(self, entity: str, columns: list[dict], breaking: bool = False, summary: str = "", in_place: bool = False) -> int:
        """Record one schema and return its version; an unchanged one is not written again."""
        top = governance.with_nested(self.spark.createDataFrame(path_rows(entity, columns), PATH_SCHEMA))
        made = governance.recorded(top).first()
        digest, schema, inside = (made.schema_hash, made.schema, made.inside) if made else (governance.digest_of(top.limit(0)), "[]", [])
        held: list[int] = []

        def make(known: DataFrame) -> DataFrame:
            now = latest(known.where(F.col("entity") == entity)).first()
            same = now is not None and now.schema_hash == digest
            version = now.version if same else 1 if now is None else now.version + (not in_place)
            held[:] = [version]
            row = [] if same else [(entity, version, f"{entity}_v{version}", digest, breaking, summary, schema, inside)]
            return self.spark.createDataFrame(row, "entity string, version int, table_name string, schema_hash string, breaking boolean, summary string, schema string, inside array<string>").coalesce(1)

        self.commit(make)
        return held[0]
