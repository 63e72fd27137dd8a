"""Tables as lists of immutable Parquet parts, with a manifest that says which parts count.

An insert adds a part; updates and deletes write a new one that replaces the old. The manifest
is a small JSON text, replaced by rename, so readers never see half a change, and a snapshot for a transaction
is a copy of it. Reads are plain Parquet scans: Catalyst pushes filters and columns to them.
"""

from __future__ import annotations

import copy
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CatalogError
from tessera.operators import spatial
from tessera.plans.ast import Type
from tessera.sources import files
from tessera.workspace import settle

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Parts of a table after which an insert also merges them.
PARTS = 64
_SPARK = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def cut_bytes(text: Column, length: int) -> Column:
    """At most ``length`` bytes of UTF-8, never half a character."""
    raw = text.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, max(0, length - i)).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= length, text).otherwise(F.coalesce(*tries))


def check_name(name: str) -> str:
    if not NAME.fullmatch(name or ""):
        raise CatalogError(f"not a name: {name}")
    return name.lower()


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, dict] = {}
        self.saved: dict | None = None
        if files.exists(spark, self._manifest()):
            self.tables = json.loads(files.read_text(spark, self._manifest()))

    def _manifest(self) -> str:
        return f"{self.root}/manifest.json"

    def persist(self) -> None:
        if self.saved is None:  # within a transaction only its end is written
            files.write_text(self.spark, self._manifest(), json.dumps(self.tables))

    # -- transactions

    def begin(self) -> None:
        if self.saved is not None:
            raise CatalogError("a transaction is open")
        self.saved = copy.deepcopy(self.tables)

    def commit(self) -> None:
        if self.saved is None:
            raise CatalogError("no transaction is open")
        old, self.saved = self.saved, None
        self.persist()
        self._collect(old)

    def rollback(self) -> None:
        """Tables, rows and indexes as they were at the beginning."""
        if self.saved is None:
            raise CatalogError("no transaction is open")
        new, self.tables, self.saved = self.tables, self.saved, None
        self._collect(new)

    def _collect(self, other: dict) -> None:
        """Remove parts that no table refers to any more."""
        live = {p for t in self.tables.values() for p in t["parts"]}
        for t in other.values():
            for p in t["parts"]:
                if p not in live and not t["external"]:
                    files.remove(self.spark, p)

    # -- definitions

    def table(self, name: str) -> dict:
        key = name.lower()
        if key not in self.tables:
            raise CatalogError(f"unknown table: {name}")
        return self.tables[key]

    def create(self, name: str, columns: list[tuple[str, Type]], key: str, storage: str = "heap", if_missing: bool = False) -> bool:
        name = check_name(name)
        if name in self.tables:
            if if_missing:
                return False
            raise CatalogError(f"table exists: {name}")
        names = [check_name(c) for c, _ in columns]
        if key.lower() not in names:
            raise CatalogError(f"unknown key column: {key}")
        self.tables[name] = {
            "columns": [[n, t.kind, t.length] for n, (_, t) in zip(names, columns)],
            "key": key.lower(),
            "storage": storage,
            "parts": [],
            "version": 0,
            "external": False,
            "indexes": {f"pk_{name}": {"columns": [key.lower()], "kind": "hash", "unique": True, "metric": None, "primary": True}},
        }
        self.persist()
        return True

    def attach(self, name: str, path: str, key: str) -> None:
        """A read-only table over Parquet files that are already there."""
        name = check_name(name)
        schema = self.spark.read.parquet(path).schema
        self.tables[name] = {
            "columns": [[f.name.lower(), f.dataType.simpleString(), None] for f in schema.fields],
            "key": key.lower(),
            "storage": "heap",
            "parts": [path],
            "version": 0,
            "external": True,
            "indexes": {},
        }

    def drop(self, name: str, if_there: bool = False) -> bool:
        key = name.lower()
        if key not in self.tables:
            if if_there:
                return False
            raise CatalogError(f"unknown table: {name}")
        gone = self.tables.pop(key)
        self.persist()
        if self.saved is None:
            self._collect({key: gone})
        return True

    def create_index(self, table: str, columns: list[str], kind: str, name: str | None = None, unique: bool = False, if_missing: bool = False, metric: str | None = None) -> bool:
        meta = self.table(table)
        columns = [c.lower() for c in columns]
        known = {c[0] for c in meta["columns"]}
        for c in columns:
            if c not in known:
                raise CatalogError(f"unknown column: {c}")
        name = (name or f"idx_{table}_{'_'.join(columns)}_{kind}").lower()
        if any(name in t["indexes"] for t in self.tables.values()):
            if if_missing:
                return False
            raise CatalogError(f"index exists: {name}")
        if unique and kind != "hash":
            raise CatalogError("UNIQUE goes with HASH only")
        if kind == "bplus_clustered":
            if meta["storage"] != "heap":
                raise CatalogError("a clustered index needs a heap table")
            if any(i["kind"] == kind for i in meta["indexes"].values()):
                raise CatalogError("one clustered index per table")
        if unique:
            twice = self.read(table).groupBy(*[F.col(f"`{c}`") for c in columns]).count().filter("count > 1")
            if not twice.isEmpty():
                raise CatalogError(f"values repeat in {', '.join(columns)}")
        meta["indexes"][name] = {"columns": columns, "kind": kind, "unique": unique, "metric": metric, "primary": False}
        if kind in ("bplus_clustered", "rtree"):
            self._layout(table)
        self.persist()
        return True

    def drop_index(self, name: str, table: str | None = None, if_there: bool = False) -> bool:
        name = name.lower()
        for t, meta in self.tables.items():
            if name in meta["indexes"] and table in (None, t):
                if meta["indexes"][name]["primary"]:
                    raise CatalogError("the index of the key cannot be dropped")
                del meta["indexes"][name]
                self.persist()
                return True
        if if_there:
            return False
        raise CatalogError(f"unknown index: {name}")

    def spatial_columns(self, table: str, alias: str | None = None) -> tuple[str, str]:
        """The point columns of a table: of its only spatial index, else by their usual names."""
        trees = [i["columns"] for i in self.table(table)["indexes"].values() if i["kind"] == "rtree"]
        named = [c for c in trees if alias in c]
        if named or len(trees) == 1:
            return tuple((named or trees)[0])
        return spatial.coordinates(self.read(table))

    # -- rows

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(c, _SPARK.get(kind) or T.DataType.fromDDL(kind)) for c, kind, _ in self.table(name)["columns"]])

    def read(self, name: str) -> DataFrame:
        meta = self.table(name)
        if not meta["parts"]:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(*meta["parts"])

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex[:12]}"

    def _writable(self, name: str) -> dict:
        meta = self.table(name)
        if meta["external"]:
            raise CatalogError(f"{name} is read-only")
        return meta

    def _laid_out(self, name: str, df: DataFrame) -> DataFrame:
        """Sort key of the files: the clustered index, the grid cell of a spatial one, or the key of a sequential table."""
        meta = self.table(name)
        for i in meta["indexes"].values():
            if i["kind"] == "bplus_clustered":
                c = i["columns"][0]
                return df.repartitionByRange(F.col(c)).sortWithinPartitions(c)
            if i["kind"] == "rtree":
                from tessera.functions import geo

                cell = geo.cell(*[F.col(c) for c in i["columns"]])
                return df.withColumn("_cell", cell).repartitionByRange("_cell").sortWithinPartitions("_cell").drop("_cell")
        if meta["storage"] == "sequential":
            return df.repartitionByRange(F.col(meta["key"])).sortWithinPartitions(meta["key"])
        return df

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        """Columns in order and of their types; VARCHAR(n) is cut to n bytes."""
        out = []
        for c, kind, length in self.table(name)["columns"]:
            x = df[f"`{c}`"].cast(_SPARK.get(kind) or T.DataType.fromDDL(kind))
            out.append((cut_bytes(x, length) if length else x).alias(c))
        return df.select(*out)

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows whose keys are new; a repeated or null key is an error and nothing is added."""
        meta = self._writable(name)
        rows = settle(self.shaped(name, rows), f"rows-{name}")
        n = rows.count()
        if not n:
            return 0
        for i in meta["indexes"].values():
            if i["unique"]:
                self._check_unique(name, rows, i["columns"][0])
        path = self._path(name)
        self._laid_out(name, rows).write.parquet(path)
        meta["parts"].append(path)
        meta["version"] += 1
        if len(meta["parts"]) > PARTS:
            self.compact(name)
        self.persist()
        return n

    def _check_unique(self, name: str, rows: DataFrame, column: str) -> None:
        key = rows.select(F.col(f"`{column}`").alias("k"))
        if column == self.table(name)["key"] and not key.filter("k is null").isEmpty():
            raise CatalogError(f"the key {column} is missing")
        if not key.groupBy("k").count().filter("count > 1").isEmpty():
            raise CatalogError(f"repeated value of {column}")
        if self.table(name)["parts"] and not self.read(name).select(F.col(f"`{column}`").alias("k")).join(key, "k", "left_semi").isEmpty():
            raise CatalogError(f"value of {column} exists")

    def replace(self, name: str, rows: DataFrame, check: bool = False) -> None:
        """New content of a table: one new part instead of the old ones."""
        meta = self._writable(name)
        path = self._path(name)
        shaped = self.shaped(name, rows)
        if check:
            shaped = settle(shaped, f"rows-{name}")
            for i in meta["indexes"].values():
                if i["unique"] and not shaped.groupBy(F.col(f"`{i['columns'][0]}`")).count().filter("count > 1").isEmpty():
                    raise CatalogError(f"repeated value of {i['columns'][0]}")
            if not shaped.filter(F.col(f"`{meta['key']}`").isNull()).isEmpty():
                raise CatalogError("the key is missing")
        self._laid_out(name, shaped).write.parquet(path)
        old = list(meta["parts"])
        meta["parts"], meta["version"] = [path], meta["version"] + 1
        self.persist()
        if self.saved is None:
            self._collect({name: {"parts": old, "external": False}})

    def _layout(self, name: str) -> None:
        if self.table(name)["parts"] and not self.table(name)["external"]:
            self.replace(name, self.read(name))

    def compact(self, name: str) -> None:
        """Merge the parts and lay them out anew."""
        self._layout(name)

    def signature(self, name: str) -> str:
        """Changes whenever the rows do."""
        meta = self.table(name)
        return f"{name}:{meta['version']}:{','.join(meta['parts'])}"

    def describe(self) -> list[dict]:
        """Tables with columns, key, indexes, bytes on disk and rows."""
        return [
            {
                "name": n,
                "columns": [{"name": c, "type": k, "length": x} for c, k, x in t["columns"]],
                "key": t["key"],
                "storage": t["storage"],
                "indexes": t["indexes"],
                "bytes": sum(files.size(self.spark, p) for p in t["parts"]),
                "rows": self.read(n).count(),
                "source": "files" if t["external"] else "engine",
            }
            for n, t in sorted(self.tables.items())
        ]
