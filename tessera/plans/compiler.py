"""Statements to DataFrames.

Everything composes: search predicates, joins, groups and sorts may stand in one SELECT. The
filter on the FROM table comes first, then the search, joins, groups, sort, projection, limit;
one lazy plan is built and Catalyst decides how to run it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog
from tessera.errors import CatalogError, EngineError
from tessera.functions import geo, vectors
from tessera.operators import relational, text, vector
from tessera.plans import ast as A
from tessera.plans.parser import walk


class Compiler:
    def __init__(self, catalog: Catalog, points: dict[str, tuple[float, float]] | None = None, features=None):
        self.catalog, self.points = catalog, points or {}
        self.features = features  # file, kind -> vector
        self.steps: list[dict] = []

    def step(self, operator: str, **details) -> None:
        self.steps.append({"operator": operator, **details})

    # -- names

    def resolve(self, df: DataFrame, name: A.Name, tables: list[str]) -> str:
        """The frame's column for a name; a joined table's clashing column is ``table.column``."""
        if name.table is not None:
            if name.table not in tables:
                raise CatalogError(f"unknown table: {name.table}")
            full = f"{name.table}.{name.column}"
            if full in df.columns:
                return full
            if name.column in df.columns and name.column in self._columns(name.table):
                return name.column
            raise CatalogError(f"unknown column: {full}")
        if name.column in df.columns:
            return name.column
        raise CatalogError(f"unknown column: {name.column}")

    def _columns(self, table: str) -> list[str]:
        return [c[0] for c in self.catalog.table(table)["columns"]]

    def _point(self, point: Any) -> tuple[float, float]:
        if isinstance(point, str):
            if point not in self.points:
                raise EngineError(f"unknown point: {point}")
            return self.points[point]
        return point

    # -- conditions

    def distance(self, d: A.Distance, table: str) -> Column:
        lat, lon = self.catalog.spatial_columns(table, d.column)
        return geo.distance(F.col(lat), F.col(lon), self._point(d.point), d.metric)

    def condition(self, df: DataFrame, c: Any, table: str) -> Column:
        """A condition on the rows of one table."""
        if isinstance(c, (A.All_, A.Any_)):
            parts = [self.condition(df, p, table) for p in c.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(c, A.All_) else out | p
            return out
        if isinstance(c, A.Compare) and isinstance(c.left, A.Distance):
            lat, lon = self.catalog.spatial_columns(table, c.left.column)
            return geo.within(F.col(lat), F.col(lon), self._point(c.left.point), float(c.value), c.left.metric, strict=c.op == "<")
        if isinstance(c, A.Inside):
            lat, lon = self.catalog.spatial_columns(table, c.column)
            return geo.in_polygon(F.col(lat), F.col(lon), list(c.ring))
        if isinstance(c, (A.Compare, A.Between)):
            column = self.resolve(df, c.left, [table])
            kind = df.schema[column].dataType
            x = F.col(f"`{column}`")
            if isinstance(c, A.Between):
                return (x >= _value(c.low, kind)) & (x <= _value(c.high, kind))
            if c.value is None:
                return {"=": x.isNull(), "!=": x.isNotNull()}.get(c.op, F.lit(False))
            v = _value(c.value, kind)
            return {"=": x == v, "!=": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[c.op]
        raise EngineError("MATCH and SIMILAR_TO belong in SELECT, under AND")

    # -- SELECT

    def select(self, s: A.Select) -> DataFrame:
        meta = self.catalog.table(s.table)
        df = self.catalog.read(s.table)
        tables = [s.table]
        self.step("Scan", table=s.table, storage=meta["storage"])
        search = next((c for c, _ in walk(s.where) if isinstance(c, (A.Match, A.Similar))), None)
        spatial_leaves = [c for c, _ in walk(s.where) if isinstance(c, A.Inside) or isinstance(c, A.Compare) and isinstance(c.left, A.Distance)]
        rest = _without(s.where, search)
        where = None if rest is None else self.condition(df, rest, s.table)
        if where is not None:
            self.step("GeoFilter" if spatial_leaves else "Filter", table=s.table)
        if isinstance(search, A.Match):
            df = self._match(s, search, df, where, meta)
        elif isinstance(search, A.Similar):
            df = self._similar(s, search, df, where, meta)
        elif where is not None:
            df = df.filter(where)
        measured = next((c.left for c in spatial_leaves if isinstance(c, A.Compare)), None) or next((k.by for k in s.order if isinstance(k.by, A.Distance)), None)
        plain = not s.group and not any(i.kind == "aggregate" for i in s.items)
        if measured is not None and plain:
            lat, lon = self.catalog.spatial_columns(s.table, measured.column)
            df = df.withColumns({"_lat": F.col(lat), "_lon": F.col(lon), "_distance": self.distance(measured, s.table)})
        sort_by = {}
        for n, key in enumerate(s.order):
            if isinstance(key.by, A.Distance):
                df = df.withColumn(f"_key{n}", self.distance(key.by, s.table))
                sort_by[n] = f"_key{n}"
        for j in s.joins:
            right = self.catalog.read(j.table)
            left_key = self.resolve(df, j.left, tables)
            if j.right.table not in (None, j.table):
                raise CatalogError(f"{j.right.table} is not the joined table")
            if j.right.column not in right.columns:
                raise CatalogError(f"unknown column: {j.right.column}")
            df = relational.joined(df, right, left_key, j.right.column, j.how, j.table)
            tables.append(j.table)
            self.step("Join", table=j.table, how=j.how)
        return self._finish(s, df, tables, sort_by, search is not None)

    def _match(self, s: A.Select, m: A.Match, df: DataFrame, where: Column | None, meta: dict) -> DataFrame:
        if m.column not in df.columns:
            raise CatalogError(f"unknown column: {m.column}")
        model = "tfidf" if s.using == "tf_idf" else "bm25"
        self.step("TextRank", model=model, column=m.column)
        if df.isEmpty():
            raise EngineError("the table is empty")
        if where is not None and df.filter(where).isEmpty():
            raise EngineError("no row meets the other conditions")
        if model == "bm25":
            return text.bm25(df, m.column, m.query, where=where)
        return text.tfidf(df, meta["key"], m.column, m.query, where=where)

    def _similar(self, s: A.Select, m: A.Similar, df: DataFrame, where: Column | None, meta: dict) -> DataFrame:
        if isinstance(m.target, A.Name):
            raise EngineError("SIMILAR_TO takes a vector or a file")
        if isinstance(m.target, str):
            if m.target.strip().startswith("["):
                query = vectors.literal(m.target)
            elif self.features is None:
                raise EngineError("no feature model is loaded")
            else:
                query = self.features(m.target, None)
        else:
            query = vectors.literal(m.target)
        rows = df if where is None else df.filter(where)
        column = m.column or self._vector_column(rows)
        if dict(rows.dtypes)[column] == "string":
            rows = rows.withColumn("_vector", vectors.parse(F.col(column)))
        else:
            rows = rows.withColumn("_vector", F.col(column).cast("array<double>"))
        k = m.k if s.order or s.limit is None else min(m.k, s.limit)
        stored = next((i["metric"] for i in meta["indexes"].values() if i["kind"] == "ivf" and i["metric"]), None)
        metric = s.metric or stored or "euclidean"
        self.step("VectorTopK", metric=metric, k=k, technique=s.using or "exact")
        return vector.top_k(rows, "_vector", query, k, meta["key"], metric).drop("_vector") if k else rows.limit(0)

    def _vector_column(self, rows: DataFrame) -> str:
        names = dict(rows.dtypes)
        usual = [n for n in vector.VECTOR_NAMES if n in names]
        arrays = [c for c, t in names.items() if t in ("array<float>", "array<double>")]
        texts = [c for c, t in names.items() if t == "string"]
        if usual or len(arrays) == 1:
            return (usual or arrays)[0]
        if not texts:
            raise EngineError("no vector column")
        seen = rows.agg(*[F.count(vectors.parse(F.col(f"`{c}`"))).alias(c) for c in texts]).first()
        found = [c for c in texts if seen[c]]
        if len(found) != 1:
            raise EngineError("name the vector column")
        return found[0]

    def _finish(self, s: A.Select, df: DataFrame, tables: list[str], sort_by: dict[int, str], ranked: bool) -> DataFrame:
        aggregates = [i for i in s.items if i.kind == "aggregate"]
        hidden = [c for c in df.columns if c.startswith("_key")]
        if s.group or aggregates:
            if any(i.kind == "star" for i in s.items):
                raise EngineError("* does not go with groups")
            keys = [self.resolve(df, n, tables) for n in s.group]
            out = []
            for i in s.items:
                if i.kind == "column" and self.resolve(df, i.name, tables) not in keys:
                    raise EngineError(f"{i.name.column} is not grouped")
            made = []
            for i in aggregates:
                column = None if i.name is None else self.resolve(df, i.name, tables)
                made.append(relational.aggregate(i.function, column, i.alias))
            self.step("Aggregate", keys=keys)
            df = relational.grouped(df, keys, made)
            for i in s.items:
                if i.kind == "column":
                    out.append(next(k for k in keys if k in (i.name.column, f"{i.name.table}.{i.name.column}")))
                elif i.kind == "aggregate":
                    out.append(i.alias or ("count_all" if i.name is None else f"{i.function}_{i.name.column}"))
        else:
            out = []
            for i in s.items:
                if i.kind == "star":
                    out += [c for c in df.columns if c not in hidden]
                elif i.kind == "column":
                    out.append(self.resolve(df, i.name, tables))
                elif i.kind == "score":
                    if "_score" not in df.columns:
                        raise EngineError("SCORE() needs MATCH or SIMILAR_TO")
                    out.append(("_score", i.alias))
        names = {a: c for c, a in (x for x in out if isinstance(x, tuple))}
        order = []
        for n, key in enumerate(s.order):
            if n in sort_by:
                column = sort_by[n]
            elif isinstance(key.by, A.Name) and key.by.table is None and key.by.column in names:
                column = names[key.by.column]
            else:
                column = self.resolve(df, key.by, tables)
            order.append(relational.order(F.col(f"`{column}`"), key.descending))
        if not order and ranked and "_score" in df.columns:
            order = [F.col("_score").desc(), F.col(self.catalog.table(s.table)["key"]).asc()]
        elif not order and "_distance" in df.columns:
            order = [F.col("_distance").asc()]
        if order:
            self.step("TopK" if s.limit is not None else "Sort")
        df = relational.top(df, order, s.limit)
        seen: set[str] = set()
        columns = []
        for x in out:
            c, a = x if isinstance(x, tuple) else (x, x)
            if a not in seen:
                seen.add(a)
                columns.append(F.col(f"`{c}`").alias(a))
        self.step("Project", columns=sorted(seen))
        return df.select(*columns)


def _value(v: Any, kind: T.DataType) -> Column:
    """A literal for a column: numbers for numeric ones, text for text; dates by their ISO text."""
    if isinstance(kind, T.NumericType):
        if isinstance(v, bool):
            return F.lit(int(v))
        if isinstance(v, (int, float)):
            return F.lit(v)
        try:
            return F.lit(float(v))
        except ValueError as e:
            raise EngineError(f"not a number: {v}") from e
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.lit(str(v)).cast(kind)
    return F.lit(v if isinstance(v, str) else str(v))


def _without(condition: Any, leaf: Any) -> Any:
    """The condition with one AND-ed leaf taken out."""
    if leaf is None or condition is None:
        return condition
    if condition is leaf:
        return None
    if isinstance(condition, A.All_):
        parts = [p for p in (_without(p, leaf) for p in condition.parts) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else A.All_(tuple(parts))
    return condition
