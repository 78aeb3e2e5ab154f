"""A store of keyed records: batches are added, reading merges each key's rows, compaction swaps in one generation.

A batch is a folder of Parquet with a row for each of its keys. The manifest, a small file with a number, names the folders
that are the store: a base with one row for each key, and the batches since. A writer adds the next manifest when its folder
is complete; the file system lets only one writer have a number, and the other adds its batch to what it then finds. So a
reader, who takes the manifest with the highest number, sees whole batches only, and the same ones however long it reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = dict[str, Callable[[str], Column]]


@dataclass(frozen=True)
class Manifest:
    """The folders that are the store, and the last batch of each writer that the base holds."""

    number: int = 0
    base: str | None = None
    batches: tuple[str, ...] = ()
    through: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"base": self.base, "batches": self.batches, "through": self.through})


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, below: str = "") -> list[str]:
        where = self.at(below) if below else self.root
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that appears whole; false, and nothing written, if there is one of that name."""
        made = self.at(f"_{uuid.uuid4().hex}")
        out = self.fs.create(made)
        out.write(text.encode())
        out.close()
        files = self.jvm.org.apache.hadoop.fs
        never = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.fs.mkdirs(self.at(name).getParent())
            files.FileContext.getFileContext(made.toUri(), self.conf).rename(made, self.at(name), never)
        except Py4JJavaError as error:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def last_wins(columns: list[str], version: str = "version") -> Merge:
    """Of a key's rows the one with the highest version; of equal versions always the same one."""
    rest = [c for c in columns if c != version]
    order = lambda: F.struct(F.col(version), F.xxhash64(*rest))
    return {c: (lambda name: F.max_by(name, order())) for c in rest} | {version: F.max}


class VersionedStore:
    """Records of ``schema`` by ``keys``. ``merge`` has an aggregate for each other column; aggregating aggregates has to
    give what aggregating all rows gives (sums, minima, :func:`last_wins`), so rows may come in any batch and any order."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: Merge):
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), keys, merge
        self.schema = T.StructType.fromDDL(schema)
        self.folder = Folder(spark, self.path)

    def manifest(self) -> Manifest:
        numbers = [n for n in self.folder.names("manifest") if n.isdigit()]
        if not numbers:
            return Manifest()
        found = json.loads(self.folder.read(f"manifest/{numbers[-1]}"))
        return Manifest(int(numbers[-1]), found["base"], tuple(found["batches"]), found["through"])

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Adds the manifest after the newest; again on the one that another writer added meanwhile."""
        while True:
            now = self.manifest()
            wanted = change(now)
            if wanted is None:
                return False
            if self.folder.create(f"manifest/{now.number + 1:020d}", wanted.text()):
                return True

    def merged(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema if f.name not in self.keys]
        found = rows.groupBy(*self.keys).agg(*[self.merge[c](c).alias(c) for c in rest])
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds rows. ``batch`` is a writer's name and the number of its batch, rising: one that the store has already is
        left out, so a stream may play a batch again."""
        name = f"batch-{batch[0]}-{batch[1]:020d}" if batch else f"batch-{uuid.uuid4().hex}"

        def missing(now: Manifest) -> Manifest | None:
            held = name in now.batches or (batch is not None and batch[1] <= now.through.get(batch[0], -1))
            return None if held else replace(now, batches=(*now.batches, name))

        if missing(self.manifest()) is None:
            return False
        self.merged(rows).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self._commit(missing)

    def _rows(self, names: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def read(self, now: Manifest | None = None) -> DataFrame:
        """A row for each key. Of the base only rows with a key in some later batch are merged; the others stay where they
        are, and are not shuffled while those keys are few enough for Spark to broadcast."""
        now = now or self.manifest()
        if not now.batches:
            return self._rows((now.base,)) if now.base else self.spark.createDataFrame([], self.schema)
        added = self._rows(now.batches)
        if not now.base:
            return self.merged(added)
        base = self._rows((now.base,))
        touched = added.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
        return base.join(touched, same, "left_anti").unionByName(self.merged(base.join(touched, same, "left_semi").unionByName(added)))

    def compact(self) -> bool:
        """Writes what is there now as a new base. Batches that come meanwhile stay batches; if another compaction was
        faster, this one's is dropped."""
        then = self.manifest()
        if not then.batches:
            return False
        name = f"base-{uuid.uuid4().hex}"
        self.read(then).write.parquet(f"{self.path}/{name}")
        numbered = [n.rsplit("-", 1) for n in then.batches if n.count("-") > 1]
        through = dict(then.through)
        for writer, number in numbered:
            writer = writer.removeprefix("batch-")
            through[writer] = max(through.get(writer, -1), int(number))

        def swapped(now: Manifest) -> Manifest | None:
            if now.base != then.base:
                return None
            return replace(now, base=name, batches=tuple(b for b in now.batches if b not in then.batches), through=through)

        done = self._commit(swapped)
        if not done:
            self.folder.delete(name)
        return done

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests but for the last ``keep``, and the bases and batches that only those named. Readers that
        began on an older manifest lose their files; batches that are being written stay."""
        numbers = [n for n in self.folder.names("manifest") if n.isdigit()]
        named = lambda n: {*(found := json.loads(self.folder.read(f"manifest/{n}")))["batches"], found["base"]}
        old, kept = numbers[:-keep], numbers[-keep:]
        for name in set().union(*map(named, old)) - set().union(*map(named, kept)) - {None}:
            self.folder.delete(name)
        for n in old:
            self.folder.delete(f"manifest/{n}")
