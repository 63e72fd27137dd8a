"""The engine: statements in, results out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import workspace
from tessera.catalog import Catalog
from tessera.errors import EngineError
from tessera.locks import LockManager
from tessera.operators import spatial
from tessera.plans import ast as A
from tessera.plans.compiler import Compiler, _value
from tessera.plans.parser import parse, split_statements


@dataclass
class Result:
    """What a statement gave. ``frame`` is lazy; ``rows`` collects it."""

    success: bool
    statement: str
    columns: list[str] = field(default_factory=list)
    frame: DataFrame | None = None
    affected_rows: int = 0
    execution_time_ms: float = 0.0
    execution_plan: dict | None = None
    error: str | None = None

    @property
    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.frame.collect()] if self.frame is not None else []


class Engine:
    """One session: a catalog, named points, an optional feature model, at most one open transaction."""

    def __init__(self, spark: SparkSession, root: str | None = None, features=None):
        self.spark = spark
        self.catalog = Catalog(spark, root or workspace.path(spark, "warehouse"))
        self.points: dict[str, tuple[float, float]] = {}
        self.features = features
        self.locks = LockManager()

    def sql(self, text: str) -> DataFrame:
        """A SELECT as a lazy DataFrame."""
        made = parse(text)
        if not isinstance(made, A.Select):
            raise EngineError("sql() takes a SELECT; use execute()")
        return Compiler(self.catalog, self.points, self.features).select(made)

    def query(self, q: A.Query) -> DataFrame:
        """A SELECT built in Python."""
        return Compiler(self.catalog, self.points, self.features).select(q.statement())

    def execute(self, text: str, raise_on_error: bool = False) -> Result:
        began = time.perf_counter()
        try:
            out = self.run(parse(text), text)
        except Exception as e:
            if raise_on_error:
                raise
            out = Result(False, text, error=str(e))
        out.execution_time_ms = (time.perf_counter() - began) * 1000
        return out

    def script(self, text: str) -> list[Result]:
        """All statements of a text, one after another."""
        return [self.execute(s) for s in split_statements(text)]

    def run(self, s: Any, text: str = "") -> Result:
        if isinstance(s, A.Select):
            compiler = Compiler(self.catalog, self.points, self.features)
            df = compiler.select(s)
            return Result(True, text, df.columns, df, execution_plan=self._plan(s, compiler))
        if isinstance(s, A.Explain):
            return self._explain(s, text)
        if isinstance(s, A.SetPoint):
            self.points[s.name] = s.point
            return Result(True, text)
        if isinstance(s, A.Transaction):
            getattr(self.catalog, s.action)()
            if s.action != "begin":
                self.locks.release(id(self))
            return Result(True, text)
        return Result(True, text, affected_rows=self._write(s))

    def _write(self, s: Any) -> int:
        table = s.table if getattr(s, "table", None) else "*"
        self.locks.acquire(id(self), table)
        try:
            if isinstance(s, A.CreateTable):
                return int(self.catalog.create(s.table, list(s.columns), s.key, s.storage, s.if_missing))
            if isinstance(s, A.DropTable):
                return int(self.catalog.drop(s.table, s.if_there))
            if isinstance(s, A.CreateIndex):
                return int(self.catalog.create_index(s.table, list(s.columns), s.kind, s.name, s.unique, s.if_missing, s.metric))
            if isinstance(s, A.DropIndex):
                return int(self.catalog.drop_index(s.name, s.table, s.if_there))
            if isinstance(s, A.Insert):
                return self._insert(s)
            if isinstance(s, A.Delete):
                return self._delete(s)
            if isinstance(s, A.Update):
                return self._update(s)
            raise EngineError("unknown statement")
        finally:
            if self.catalog.saved is None:
                self.locks.release(id(self))

    def _literal(self, v: Any) -> Any:
        if isinstance(v, A.Features):
            if self.features is None:
                raise EngineError("no feature model is loaded")
            return "[" + ", ".join(f"{x:.6f}" for x in self.features(v.file, v.kind)) + "]"
        return v

    def _insert(self, s: A.Insert) -> int:
        schema = self.catalog.schema(s.table)
        if len(s.values) != len(schema):
            raise EngineError(f"{len(schema)} values expected, {len(s.values)} given")
        values = [self._literal(v) for v in s.values]
        cells = [(F.lit(None) if v is None else _value(v, f.dataType)).cast(f.dataType).alias(f.name) for v, f in zip(values, schema.fields)]
        return self.catalog.append(s.table, self.spark.range(1).select(*cells))

    def _hit(self, df: DataFrame, where: Any, table: str):
        if where is None:
            return F.lit(True)
        return F.coalesce(Compiler(self.catalog, self.points).condition(df, where, table), F.lit(False))

    def _delete(self, s: A.Delete) -> int:
        df = self.catalog.read(s.table)
        hit = self._hit(df, s.where, s.table)
        n = df.filter(hit).count()
        if n:
            self.catalog.replace(s.table, df.filter(~hit))
        return n

    def _update(self, s: A.Update) -> int:
        df = self.catalog.read(s.table)
        changes = {c: self._literal(v) for c, v in s.changes}
        for c in changes:
            if c not in df.columns:
                raise EngineError(f"unknown column: {c}")
        hit = self._hit(df, s.where, s.table)
        n = df.filter(hit).count()
        if n:
            unique = {i["columns"][0] for i in self.catalog.table(s.table)["indexes"].values() if i["unique"]}
            new = [
                (F.when(hit, F.lit(None) if changes[f.name] is None else _value(changes[f.name], f.dataType).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f.name in changes else F.col(f"`{f.name}`")).alias(f.name)
                for f in df.schema.fields
            ]
            self.catalog.replace(s.table, df.select(*new), check=bool(unique & set(changes)))
        return n

    # -- EXPLAIN

    def _plan(self, s: Any, compiler: Compiler) -> dict:
        if not isinstance(s, A.Select):
            return {"table": getattr(s, "table", None), "planner_type": {"Insert": "direct_write", "Update": "direct_write", "Delete": "direct_write", "SetPoint": "session", "Transaction": "transaction"}.get(type(s).__name__, "ddl"), "steps": []}
        kinds = {x["operator"] for x in compiler.steps}
        kind = "vector" if "VectorTopK" in kinds else "text" if "TextRank" in kinds else "spatial" if "GeoFilter" in kinds else "relational"
        indexes = [n for n, i in self.catalog.table(s.table)["indexes"].items() if any(c in str(s.where) for c in i["columns"])]
        return {"table": s.table, "planner_type": kind, "access_path": compiler.steps[0]["operator"], "used_indexes": indexes, "steps": compiler.steps}

    def _explain(self, e: A.Explain, text: str) -> Result:
        """Logical steps and Spark's plan; ANALYZE also runs the statement, writes included."""
        s = e.statement
        compiler = Compiler(self.catalog, self.points, self.features)
        plan: dict = {}
        if isinstance(s, A.Select):
            df = compiler.select(s)
            plan = self._plan(s, compiler)
            plan["spark"] = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            if e.analyze:
                began = time.perf_counter()
                n = df.count()
                plan["analyze"] = {"rows": n, "execution_time_ms": (time.perf_counter() - began) * 1000}
        else:
            plan = self._plan(s, compiler)
            if e.analyze:
                began = time.perf_counter()
                n = self.run(s).affected_rows
                plan["analyze"] = {"rows": n, "execution_time_ms": (time.perf_counter() - began) * 1000}
        lines = [f"{i + 1}. {x['operator']} " + ", ".join(f"{k}={v}" for k, v in x.items() if k != "operator") for i, x in enumerate(plan.get("steps", []))]
        lines += [x for x in plan.get("spark", "").splitlines()]
        frame = self.spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
        return Result(True, text, frame.columns, frame, execution_plan=plan)

    # -- facade of the web service

    def tables(self) -> list[dict]:
        return self.catalog.describe()

    def spatial_query(self, table: str, kind: str, metric: str | None = None, **options) -> DataFrame:
        meta = self.catalog.table(table)
        lat, lon = self.catalog.spatial_columns(table)
        df = self.catalog.read(table)
        df = df.withColumns({"lat": F.col(lat), "lon": F.col(lon)})
        return spatial.panel(df, kind, meta["key"], metric=metric, **options)

    def map_points(self, table: str, label: str | None = None) -> tuple[DataFrame, DataFrame]:
        lat, lon = self.catalog.spatial_columns(table)
        df = self.catalog.read(table)
        return spatial.points(df, label or self.catalog.table(table)["key"], lat, lon), spatial.bounds(df, lat, lon)


