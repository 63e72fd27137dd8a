"""CSV with a header: types from the values, and imports that report their bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CatalogError, EngineError
from tessera.plans.ast import Type

#: Errors that a report quotes.
QUOTED = 10


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under trimmed, lower-cased names, with ``_broken`` for rows of another width."""
    head = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = [c.strip().lower() for c in head.columns]
    if not names or len(set(names)) != len(names):
        raise EngineError("the header is missing or repeats a name")
    shape = ", ".join(f"`{n}` string" for n in names) + ", _broken string"
    return spark.read.schema(shape).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_broken").option("enforceSchema", True).option("escape", '"').csv(path)


def infer(spark: SparkSession, path: str) -> list[tuple[str, Type]]:
    """(name, type) of each column in one pass: INT if every value is one, else DOUBLE, else VARCHAR of the most bytes.

    An all-empty column is INT. Fewer than two lines are an error.
    """
    df = read_text(spark, path)
    names = [c for c in df.columns if c != "_broken"]
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        aggregates += [
            F.min(F.when(v.isNotNull(), v.rlike(r"^[+-]?\d+$") & v.try_cast("int").isNotNull())).alias(f"i{i}"),
            F.min(F.when(v.isNotNull(), v.try_cast("double").isNotNull())).alias(f"d{i}"),
            F.max(F.octet_length(v)).alias(f"l{i}"),
        ]
    row = df.agg(*aggregates).first()
    if not row["n"]:
        raise EngineError("a CSV needs a header and a row")
    out = []
    for i, c in enumerate(names):
        if row[f"i{i}"] is None or row[f"i{i}"]:
            out.append((c, Type("int")))
        elif row[f"d{i}"]:
            out.append((c, Type("double")))
        else:
            out.append((c, Type("string", row[f"l{i}"])))
    return out


def _cell(c: str, kind: str) -> Column:
    v = F.trim(F.col(f"`{c}`"))
    empty = v.isNull() | (v == "")
    if kind == "string":
        return F.when(empty, "").otherwise(v)
    number = v.try_cast("double")
    if kind in ("int", "bigint"):  # fractions are cut off
        return F.when(empty, F.lit(0)).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).try_cast(kind)
    return F.when(empty, F.lit(0.0)).otherwise(number)


def typed(df: DataFrame, columns: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Good rows with types, and bad rows with ``_error``. Empty cells become 0, 0.0 or ''."""
    wrong = F.when(F.col("_broken").isNotNull(), "row of another width")
    for c, kind in columns:
        if kind != "string":
            wrong = wrong.when(_cell(c, kind).isNull(), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))))
    marked = df.withColumn("_error", wrong)
    good = marked.filter("_error is null").select(*[_cell(c, kind).alias(c) for c, kind in columns])
    return good, marked.filter("_error is not null")


def import_into(catalog, table: str, path: str) -> dict:
    """Append a file's good rows to a table whose columns it has in any order; bad rows are counted, ten are quoted.

    Rows whose key is there already, or repeats within the file (the first row in file order counts), fail too.
    """
    meta = catalog.table(table)
    df = read_text(catalog.spark, path)
    columns = [(c, k) for c, k, _ in meta["columns"]]
    missing = [c for c, _ in columns if c not in df.columns]
    if missing:
        raise CatalogError(f"the file has no column {', '.join(missing)}")
    place = "_at"
    while place in df.columns:
        place += "_"
    good, bad = typed(df.withColumn(place, F.monotonically_increasing_id().cast("string")), [*columns, (place, "bigint")])
    key = meta["key"]
    row = F.struct(place, *[F.col(c) for c, _ in columns])
    fresh = good.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(place)).alias("row")).select("row.*").drop(place)
    if meta["parts"]:
        fresh = fresh.join(catalog.read(table).select(key), key, "left_anti")
    n_read = df.select(F.lit(1)).count()
    inserted = catalog.append(table, fresh.select(*[c for c, _ in columns]))
    errors = [r["_error"] for r in bad.select("_error").limit(QUOTED).collect()]
    if not errors and inserted < n_read:
        errors = ["the key is there already"]
    return {"rows_read": n_read, "inserted": inserted, "failed": n_read - inserted, "errors": errors}


def import_new(catalog, table: str, path: str, key: str | None = None) -> dict:
    """Make a table of a file; one bad row and there is no table."""
    columns = infer(catalog.spark, path)
    catalog.create(table, columns, key or columns[0][0])
    try:
        report = import_into(catalog, table, path)
        if report["failed"]:
            raise EngineError(f"{report['failed']} bad rows: {report['errors'][:1]}")
        return report
    except Exception:
        catalog.drop(table)
        raise
