"""The catalog: names to immutable table versions. A statement builds a new version and swaps it in; a savepoint is a copy of the dict.

With a store, data are Parquet files that are never changed, and each commit writes a manifest: every table's columns, key, indexes, statistics and files.
A catalog opened on the store reads the last manifest, so what was committed outlives the session, and what wasn't is never seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.types import EngineError, Type, of_spark


@dataclass(frozen=True)
class Table:
    """One version of a table. df has exactly the declared columns, in order, with the engine's types. files: a stored table's data files.
    copies: for each secondary index of a stored table the files of a copy sorted by its column. rows: those of a table that has literal rows alone."""

    name: str
    types: dict[str, Type]
    df: DataFrame
    key: str | None = None
    indexes: tuple[str, ...] = ()
    files: tuple[str, ...] | None = None
    copies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rows: tuple[tuple, ...] | None = None

    def described(self) -> str:
        marks = lambda c: ("[pk]" if c == self.key else "") + ("[sk]" if c in self.indexes else "")
        return f"{self.name}(" + ", ".join(f"{c}{marks(c)} {t.value}" for c, t in self.types.items()) + ")"


def schema_of(types: dict[str, Type]) -> T.StructType:
    return T.StructType([T.StructField(c, t.spark()) for c, t in types.items()])


class Store:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().toString() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file, whole or not at all; fails if it exists, as when another writer was faster."""
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(part, self._path(path)):
            self._fs.delete(part, False)
            raise EngineError("another session has committed to this store")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, name: str, df: DataFrame) -> tuple[str, ...]:
        """df as new data files, which are returned."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return tuple(p for p in self.listed(folder) if p.endswith(".parquet"))


@dataclass
class Catalog:
    """store: a folder for tables that last. If it is set, what DML adds or keeps is written there as Parquet; else versions stay plans."""

    spark: SparkSession
    store: str | None = None
    tables: dict[str, Table] = field(default_factory=dict)
    stats: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.disk = Store(self.spark, self.store) if self.store else None
        self.version = 0
        if self.disk and (found := [p for p in self.disk.listed(f"{self.disk.root}/_commits") if p.endswith(".json")]):
            self.version = int(found[-1].rsplit("/", 1)[1].removesuffix(".json"))
            self._load(json.loads(self.disk.read(found[-1])))

    # what lasts

    def _load(self, manifest: dict) -> None:
        from quern.stats import Stats

        for name, t in manifest["tables"].items():
            types = {c: Type[k] for c, k in t["columns"]}
            table = Table(name, types, self.stored(types, t["files"]), t["key"], tuple(t["indexes"]), tuple(t["files"]), {c: tuple(f) for c, f in t["copies"].items()})
            self.put(table)
            if t["stats"]:
                self.stats[name] = Stats(**t["stats"])

    def commit(self) -> None:
        """Make the present versions of all stored tables last."""
        if not self.disk:
            return
        told = {}
        for name, t in self.tables.items():
            if t.files is not None:
                s = self.stats.get(name)
                told[name] = {"columns": [[c, k.name] for c, k in t.types.items()], "key": t.key, "indexes": t.indexes, "files": t.files, "copies": t.copies, "stats": s and {"rows": s.rows, "distinct": s.distinct, "width": s.width}}
        self.disk.create(f"{self.disk.root}/_commits/{self.version + 1:012d}.json", json.dumps({"tables": told}))
        self.version += 1

    def stored(self, types: dict[str, Type], files) -> DataFrame:
        return self.spark.read.schema(schema_of(types)).parquet(*files) if files else self.spark.createDataFrame([], schema_of(types))

    # tables

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(f"table {name} not found")
        return self.tables[name]

    def put(self, table: Table) -> None:
        self.tables[table.name] = table

    def create(self, name: str, types: dict[str, Type], key: str | None) -> None:
        self.put(Table(name, types, self.spark.createDataFrame([], schema_of(types)), key, files=() if self.disk else None, rows=None if self.disk else ()))

    def register(self, name: str, df: DataFrame, key: str | None = None) -> Table:
        """Make a DataFrame a table of this session. Columns without a counterpart among the engine's types are left out; DECIMAL becomes FLOAT."""
        types = {f.name.lower(): k for f in df.schema.fields if (k := of_spark(f.dataType))}
        out = df.select(*[F.col(f"`{f.name}`").cast(types[f.name.lower()].spark()).alias(f.name.lower()) if f.dataType != types[f.name.lower()].spark() else F.col(f"`{f.name}`").alias(f.name.lower()) for f in df.schema.fields if f.name.lower() in types])
        self.put(table := Table(name.lower(), types, out, key))
        return table

    def register_parquet(self, name: str, path: str, key: str | None = None) -> Table:
        return self.register(name, self.spark.read.parquet(path), key)

    def literal(self, rows: list[tuple], types: dict[str, Type]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema_of(types))

    # changes

    def _sorted(self, df: DataFrame, column: str | None) -> DataFrame:
        """Clustered, so that row-group statistics prune points and ranges of the column."""
        return df.sortWithinPartitions(column) if column else df

    def _copies(self, table: Table, files: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
        """For each index the same rows, dealt out in ranges of its column and sorted."""
        added = self.stored(table.types, files)
        return {c: (*table.copies.get(c, ()), *self.disk.write(f"{table.name}.{c}", self._sorted(added.repartitionByRange(F.col(f"`{c}`")), c))) for c in table.indexes} if files else dict(table.copies)

    def index(self, table: Table, column: str) -> None:
        new = replace(table, indexes=(*table.indexes, column))
        if table.files:
            made = self._sorted(table.df.repartitionByRange(F.col(f"`{column}`")), column)
            new = replace(new, copies={**table.copies, column: self.disk.write(f"{table.name}.{column}", made)})
        self.put(new)

    def violated(self, table: Table, new: DataFrame) -> tuple[bool, int]:
        """Whether a new key occurs twice or exists, and how many rows are new. One pass, in which every new value is computed, so that what can't be computed fails now."""
        every = F.xxhash64(*[F.col(f"`{c}`") for c in table.types]).alias("every")
        if table.key is None:
            return False, new.agg(F.count(F.lit(1)).alias("n"), F.max(every)).first()["n"]
        key = F.col(f"`{table.key}`").alias("key")
        both = new.select(key, F.lit(1).alias("fresh"), every).unionByName(table.df.select(key, F.lit(0).alias("fresh"), F.lit(0).cast("long").alias("every")))
        by_key = both.groupBy("key").agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("n"), F.max("every").alias("every"))
        r = by_key.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("n"), F.max((F.col("fresh") > 0) & (F.col("n") > 1)).alias("twice"), F.max("every")).first()
        return bool(r["twice"]), r["n"]

    def append(self, table: Table, rows: DataFrame, literal: list[tuple] | None = None) -> int:
        """Add rows, computed once, and return how many."""
        if self.disk and table.files is not None:
            files = self.disk.write(table.name, self._sorted(rows, table.key))
            new = self.stored(table.types, files)
            twice, n = self.violated(table, new) if table.key is not None else (False, new.count())
            if not twice:
                every = (*table.files, *files)
                self.put(replace(table, df=self.stored(table.types, every), files=every, copies=self._copies(table, files)))
        else:
            twice, n = self.violated(table, rows)
            if not twice and literal is not None and table.rows is not None:
                every = (*table.rows, *literal)  # one literal relation, however many statements it came from
                self.put(replace(table, df=self.literal(list(every), table.types), rows=every))
            elif not twice:
                self.put(replace(table, df=table.df.unionByName(rows), rows=None))
        if twice:
            raise EngineError("primary key constraint violation")
        return n

    def delete(self, table: Table, gone) -> int:
        """Remove the rows where gone holds, and return how many. Of a stored table only files with such rows are written anew."""
        if not self.disk or table.files is None:
            n = table.df.where(gone).count()
            if n:
                self.put(replace(table, df=table.df.where(~gone), rows=None))
            return n

        def without(files: tuple[str, ...], name: str, order: str | None) -> tuple[tuple[str, ...], int]:
            df = self.stored(table.types, files)
            hit = {r["file"]: r["n"] for r in df.where(gone).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()} if files else {}  # one row for each file
            plain = lambda p: p.split(":", 1)[-1].lstrip("/")
            touched = {plain(f) for f in hit}
            old = [f for f in files if plain(f) in touched]
            left = self.disk.write(name, self._sorted(self.stored(table.types, old).where(~gone), order)) if old else ()
            return (*[f for f in files if plain(f) not in touched], *left), sum(hit.values())

        files, n = without(table.files, table.name, table.key)
        if n:
            copies = {c: without(f, f"{table.name}.{c}", c)[0] for c, f in table.copies.items()}
            self.put(replace(table, df=self.stored(table.types, files), files=files, copies=copies))
        return n
