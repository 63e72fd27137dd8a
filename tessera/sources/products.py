"""Product exports and catalogues to clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import cut_bytes
from tessera.errors import EngineError

#: Spellings of the columns of an export.
NAMES = {
    "id": ("id", "product_id", "producto_id", "sku", "codigo"),
    "nombre": ("nombre", "name", "title", "titulo", "producto"),
    "categoria": ("categoria", "category", "rubro", "tipo"),
    "precio": ("precio", "price", "valor", "importe"),
    "descripcion": ("descripcion", "description", "detalle"),
    "imagen": ("imagen", "image", "foto", "image_path"),
}


def price(text: Column) -> Column:
    """``1.234,56``, ``1,234.56``, ``S/ 12``: the last separator with one or two digits behind it is the decimal one."""
    digits = F.regexp_replace(text, r"[^0-9,.\-]", "")
    comma = F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")
    point = F.regexp_replace(digits, ",", "")
    return F.when(digits.rlike(r",\d{1,2}$"), comma).when(digits.rlike(r"\.\d{1,2}$"), point).otherwise(F.regexp_replace(digits, "[,.]", "")).try_cast("double")


def normalise(export: DataFrame, least: int = 1, most: int | None = None, name_bytes: int = 96) -> DataFrame:
    """id, nombre, categoria, precio, descripcion, imagen; bad or repeated ids, empty names, bad prices or a wrong number of rows are errors."""
    low = {c.strip().lower(): c for c in export.columns}
    picked = {}
    for want, names in NAMES.items():
        have = next((low[n] for n in names if n in low), None)
        if have is None and want in ("id", "nombre", "precio"):
            raise EngineError(f"the export has no {want}")
        picked[want] = F.lit("") if have is None else F.trim(F.coalesce(F.col(f"`{have}`").cast("string"), F.lit("")))
    category = F.initcap(F.regexp_replace(picked["categoria"], r"[\s_/|>-]+", " "))
    out = export.select(
        picked["id"].try_cast("int").alias("id"),
        cut_bytes(F.regexp_replace(picked["nombre"], r"\s+", " "), name_bytes).alias("nombre"),
        F.when(category == "", "General").otherwise(category).alias("categoria"),
        price(picked["precio"]).alias("precio"),
        F.regexp_replace(picked["descripcion"], r"\s+", " ").alias("descripcion"),
        picked["imagen"].alias("imagen"),
    )
    seen = out.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("id").isNull() | (F.col("id") < 1)).alias("bad_id"),
        F.count_if(F.col("nombre") == "").alias("bad_name"),
        F.count_if(F.col("precio").isNull() | (F.col("precio") <= 0)).alias("bad_price"),
    ).first()
    if seen["bad_id"] or seen["ids"] != seen["n"] or seen["bad_name"] or seen["bad_price"]:
        raise EngineError(f"bad rows: {seen.asDict()}")
    if seen["n"] < least or most is not None and seen["n"] > most:
        raise EngineError(f"{seen['n']} products, between {least} and {most} wanted")
    return out


def cut_words(text: Column, length: int) -> Column:
    """At most ``length`` bytes, ended at a word."""
    cut = cut_bytes(text, length)
    return F.when(F.octet_length(text) <= length, text).otherwise(F.rtrim(F.regexp_replace(cut, r"\s+\S*$", "")))


def catalogue(spark: SparkSession, path: str, language: str = "es", categories: dict[str, str] | None = None, per_category: int = 100, seed: str = "catalogue") -> DataFrame:
    """Products of a JSON-lines catalogue (gz or plain), one per image and per name without its variant.

    Rows need an id, a name in the language and an image; the seeded hash of the id orders each category,
    whose first rows are kept, and gives a price between 5 and 500, even in its logarithm.
    """
    tagged = "array<struct<language_tag string, value string>>"
    raw = spark.read.schema(f"item_id string, item_name {tagged}, brand {tagged}, product_type array<struct<value string>>, bullet_point {tagged}, main_image_id string").json(path)
    said = lambda c: F.get(F.filter(c, lambda x: x["language_tag"].startswith(language)), 0)["value"]
    kind = F.get("product_type", 0)["value"]
    if categories:
        table = F.create_map(*[x for k, v in sorted(categories.items()) for x in (F.lit(k), F.lit(v))])
        kind = F.try_element_at(table, kind)
    brand = F.coalesce(said("brand"), F.lit(""))
    name = F.trim(F.regexp_replace(said("item_name"), r"\s+", " "))
    rows = raw.select("item_id", "main_image_id", kind.alias("category"), brand.alias("brand_name"), name.alias("item"), F.coalesce(said("bullet_point"), F.lit("")).alias("text")).filter("item is not null and item <> '' and category is not null and main_image_id is not null and item_id is not null")
    rows = rows.withColumn("name", cut_words(F.regexp_replace(F.trim(F.when((F.col("brand_name") != "") & F.startswith(F.lower("item"), F.lower("brand_name")), F.expr("substr(item, length(brand_name) + 1)")).otherwise(F.col("item"))), r"^[\s,–-]+", ""), 96))
    rows = rows.withColumns({"root": F.trim(F.lower(F.regexp_replace("name", r"[,(].*$|\d+", ""))), "draw": F.sha2(F.concat(F.lit(seed), F.col("item_id")), 256)})
    one = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("draw", "item_id"))
    rows = rows.withColumn("_i", one("main_image_id")).filter("_i = 1").withColumn("_r", one("root")).filter("_r = 1")
    rows = rows.withColumn("_n", one("category")).filter(F.col("_n") <= per_category)
    unit = F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(16**12)
    return rows.select("item_id", "name", "category", F.round(5 * F.pow(F.lit(100.0), unit), 2).alias("price"), "text", F.col("main_image_id").alias("image"))


def load_missing(catalog, table: str, rows: DataFrame) -> int:
    """Add the rows whose keys a table has not yet; running it again adds nothing."""
    key = catalog.table(table)["key"]
    fresh = rows.dropDuplicates([key])
    if catalog.table(table)["parts"]:
        fresh = fresh.join(catalog.read(table).select(key), key, "left_anti")
    return catalog.append(table, fresh.select(*[c[0] for c in catalog.table(table)["columns"]]))
