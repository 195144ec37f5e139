"""Tables that change together: data is written first, then one small file makes all of it the next state.

A state is a manifest: which folders hold each table. Writers stage folders that nobody reads, and then create the
manifest of the next number; whoever comes second finds the number taken and has a Conflict. A writer that is lost
before that leaves folders without meaning, one that is lost after it has done its work.

A keyed table lies in buckets by the hash of its key. A manifest names a folder for each bucket, so a change writes the
buckets that its keys fall into and leaves all others where they are.

Works on any file system that Spark reads, if a rename there doesn't replace a file (HDFS and its kind) or a
link can be made (local disks).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


class Conflict(Exception):
    """Another writer has committed since the state that this one read."""


class Files:
    """Small files of a folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def ages(self, folder: str) -> dict[str, int]:
        """Milliseconds since 1970 of each entry's last change."""
        at = self._path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A whole new file, or False where there is one of that name: among several writers one succeeds."""
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._path(name)
        self.fs.mkdirs(final.getParent())
        try:
            if self.fs.getUri().getScheme() != "file":
                return not self.fs.exists(final) and self.fs.rename(draft, final)
            local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(local(final), local(draft))
                return True
            except Exception:
                if self.fs.exists(final):
                    return False
                raise
        finally:
            self.fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def bucket(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Commits:
    """The states of a folder of tables. keep: how many of the last ones stay readable."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 10, buckets: int = BUCKETS):
        self.spark, self.path, self.keep, self.buckets = spark, path.rstrip("/"), max(1, keep), buckets
        self.files = Files(spark, self.path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("commits") if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> dict:
        """The last manifest: number, tables, keyed, facts. Number 0 is a folder without any."""
        numbers = self.numbers()
        return json.loads(self.files.text(f"commits/{numbers[-1]}.json")) if numbers else {"number": 0, "tables": {}, "keyed": {}, "facts": {}}

    def stage(self, rows: DataFrame, name: str) -> str:
        """Write rows where no state names them yet; the folder's name."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def staged(self, folder: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def stage_keyed(self, rows: DataFrame, name: str, key: str) -> dict[str, str]:
        """Write whole buckets of rows; the folder of each bucket that has any. Few rows make few files: one a bucket."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket(key, self.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}

    def read(self, state: dict, name: str, schema) -> DataFrame:
        folder = state["tables"].get(name)
        return self.staged(folder, schema) if folder else self.spark.createDataFrame([], schema)

    def read_keyed(self, state: dict, name: str, schema, some: Iterable[int] | None = None) -> DataFrame:
        """A keyed table's rows, of some buckets or of all."""
        folders = state["keyed"].get(name, {})
        wanted = folders.values() if some is None else [folders[str(b)] for b in sorted(set(some)) if str(b) in folders]
        paths = [f"{self.path}/{f}" for f in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, base: dict, tables: dict[str, str] | None = None, keyed: dict[str, dict[str, str | None]] | None = None, facts: dict | None = None) -> dict:
        """Make base with these changes the next state; a bucket of None has no rows left. Conflict if base isn't the last state any more."""
        state = {"number": base["number"] + 1, "tables": base["tables"] | (tables or {}), "keyed": dict(base["keyed"]), "facts": base["facts"] | (facts or {})}
        for name, changed in (keyed or {}).items():
            state["keyed"][name] = {b: f for b, f in (state["keyed"].get(name, {}) | changed).items() if f}
        if not self.files.create(f"commits/{state['number']}.json", json.dumps(state)):
            raise Conflict(f"state {state['number']} of {self.path} is another writer's")
        self._forget()
        return state

    @staticmethod
    def _folders(state: dict) -> set[str]:
        named = [*state["tables"].values(), *(f for folders in state["keyed"].values() for f in folders.values()), *state["facts"].get("folders", [])]
        return {"/".join(f.split("/")[:2]) for f in named}

    def _forget(self) -> None:
        """Drop states that are older than keep, and the folders that only they name."""
        numbers = self.numbers()
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        if not old:
            return
        load = lambda n: json.loads(self.files.text(f"commits/{n}.json"))
        named = set().union(*(self._folders(load(n)) for n in kept))
        gone = set().union(*(self._folders(load(n)) for n in old)) - named
        for n in old:
            self.files.delete(f"commits/{n}.json")
        for folder in gone:
            self.files.delete(folder)

    def sweep(self, before_ms: int) -> int:
        """Delete folders that no state names and that were last changed before a time: those of writers that were lost."""
        named = set().union(set(), *(self._folders(json.loads(self.files.text(f"commits/{n}.json"))) for n in self.numbers()))
        lost = [n for n, at in self.files.ages("data").items() if f"data/{n}" not in named and at < before_ms]
        for name in lost:
            self.files.delete(f"data/{name}")
        return len(lost)

    def mark(self, name: str) -> bool:
        """Note that something was done; False if it was noted before."""
        return self.files.create(f"marks/{name}", "")

    def marked(self, name: str) -> bool:
        return self.files.exists(f"marks/{name}")
