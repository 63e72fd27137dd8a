"""Registered queries over the driver's tables, and the SQL that checks them.

Where the engine's dialect can say a query, it is said in it, so parser and compiler are
checked with the operators. Doubles are rounded on both sides; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import workspace
from tessera.engine import Engine
from tessera.functions import geo, vectors
from tessera.functions.tokens import tokens
from tessera.operators import audio, bow, evaluate, recommend, relational, spatial, text, vector
from tessera.sources import csvio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "benchmark": "item_id",
}
#: Suppliers and customers have no place in the data; this one follows from the key.
PLACE = "CAST(-12.0464 AS DOUBLE) + CAST(({k} * 37) % 1000 - 500 AS DOUBLE) / 5000 AS lat, CAST(-77.0428 AS DOUBLE) + CAST(({k} * 91) % 1000 - 500 AS DOUBLE) / 5000 AS lon"
CENTRE = (-12.0464, -77.0428)
RING = [(-12.10, -77.10), (-12.10, -77.00), (-12.00, -77.00), (-12.00, -77.10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    e = Engine(spark)
    for n in names:
        e.catalog.attach(n, f"{sf_dir}/{n}.parquet", KEYS[n])
    return e


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores with coordinates."""
    lat, lon = PLACE.format(k="s_suppkey").split(" AS lat, ")
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", f"{lat} AS lat", lon)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought what and when, from orders and their lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("day"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"), "l_linenumber", F.col("l_quantity").alias("amount"))
    return o.join(i, "o_orderkey")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    names = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(n, digits) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def dialect(name: str, tables: str, statement: str, sql: str, digits: int = 6) -> None:
    """A query in the engine's dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(engine(spark, sf_dir, *tables.split()).sql(statement), digits)

    register(name, sql)(run)


# -- scans, filters, projections

dialect(
    "flagship",
    "lineitem",
    "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag ORDER BY l_returnflag",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag",
)
dialect("scan_project", "nation", "SELECT n_name, nation.n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation")
dialect("scan_all", "region", "SELECT * FROM region", "SELECT * FROM region")
dialect("filter_eq", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
dialect("filter_ne", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> BUILDING", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
dialect("filter_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.5 AND o_totalprice <= 200000", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_totalprice > 1000.5 AND o_totalprice <= 200000")
dialect("filter_between", "part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
dialect(
    "filter_and",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.02 AND l_returnflag = 'R'",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.02 AND l_returnflag = 'R'",
)
dialect(
    "filter_or_union",
    "orders",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 1 OR o_custkey = 7 OR o_custkey = 11",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 7, 11)",
)
dialect(
    "filter_string",
    "part",
    "SELECT p_partkey, p_name FROM part WHERE p_name >= 'm' AND p_name < 's'",
    "SELECT p_partkey, p_name FROM part WHERE p_name >= 'm' AND p_name < 's'",
)
dialect("filter_date", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
dialect("pk_lookup", "orders", "SELECT * FROM orders WHERE o_orderkey = 5", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 5")
dialect("pk_range", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 20 AND 60 ORDER BY c_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 20 AND 60")
dialect("limit_sorted", "orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 25", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")


@register("lookup_union", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (3, 14, 15, 92, 65)")
def lookup_union(spark, sf_dir):
    return relational.union_of_lookups(table(spark, sf_dir, "part"), "p_partkey", [3, 14, 15, 92, 65]).select("p_partkey", "p_brand")


# -- joins

_J = "SELECT c_custkey, c_name, n_name FROM customer {how} JOIN nation ON c_nationkey = n_nationkey"
dialect("join_inner", "customer nation", _J.format(how="INNER"), _J.format(how="INNER"))
dialect(
    "join_left",
    "nation supplier",
    "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey",
    "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey",
)
dialect(
    "join_right",
    "supplier nation",
    "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
)
dialect(
    "join_full",
    "supplier customer",
    "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
)
dialect(
    "join_chain",
    "orders customer nation region",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
dialect(
    "filter_before_join",
    "orders customer",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 250000",
    "SELECT o_orderkey, c_mktsegment FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o JOIN customer c ON o.o_custkey = c.c_custkey",
)


@register("join_name_collision", 'SELECT a.id, a.name, b.id AS "b.id", b.name AS "b.name" FROM (SELECT n_nationkey AS id, n_name AS name FROM nation) a JOIN (SELECT r_regionkey AS id, r_name AS name FROM region) b ON a.id = b.id')
def join_name_collision(spark, sf_dir):
    a = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    b = table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS name")
    return relational.joined(a, b, "id", "id", "inner", "b")


# -- groups

dialect(
    "agg_global",
    "lineitem",
    "SELECT COUNT(*), SUM(l_quantity), AVG(l_discount), MIN(l_tax), MAX(l_extendedprice) FROM lineitem",
    "SELECT count(*) AS count_all, round(sum(l_quantity), 6) AS sum_l_quantity, round(avg(l_discount), 6) AS avg_l_discount, round(min(l_tax), 6) AS min_l_tax, round(max(l_extendedprice), 6) AS max_l_extendedprice FROM lineitem",
)
dialect(
    "agg_global_empty",
    "orders",
    "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, MAX(o_orderkey) AS last FROM orders WHERE o_orderkey < 0",
    "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, NULL::DOUBLE AS mean, NULL::BIGINT AS last",
)


@register("agg_count_col", "SELECT n_nationkey, count(s_suppkey) AS n, count(*) AS rows_all FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def agg_count_col(spark, sf_dir):
    e = engine(spark, sf_dir, "nation", "supplier")
    return e.sql("SELECT n_nationkey, COUNT(s_suppkey) AS n, COUNT(*) AS rows_all FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")


dialect(
    "group_one",
    "orders",
    "SELECT o_orderstatus, COUNT(*) AS n, AVG(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus",
    4,
)
dialect(
    "group_two",
    "lineitem",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_extendedprice) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
    2,
)
dialect("group_distinct", "part", "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type", "SELECT DISTINCT p_brand, p_type FROM part")
dialect(
    "group_order_alias",
    "orders",
    "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20",
)
dialect(
    "join_group",
    "orders customer",
    "SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY total DESC",
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    2,
)
dialect("group_min_max_text", "customer", "SELECT c_mktsegment, MIN(c_name) AS first_name, MAX(c_name) AS last_name FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, min(c_name) AS first_name, max(c_name) AS last_name FROM customer GROUP BY c_mktsegment")

# -- sorts

dialect(
    "sort_multi",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey ASC, l_linenumber ASC LIMIT 100",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 100",
)
dialect(
    "topk_tie",
    "part",
    "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 40",
    "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 40",
)


@register("sort_desc_nulls", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier s ON n_nationkey = s_nationkey ORDER BY s_suppkey DESC NULLS FIRST, n_nationkey LIMIT 12")
def sort_desc_nulls(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    j = relational.joined(a, b, "n_nationkey", "s_nationkey", "left", "supplier")
    return relational.top(j, [relational.order(F.col("s_suppkey"), True), relational.order(F.col("n_nationkey"))], 12).select("n_nationkey", "s_suppkey")


# -- spatial

_STORES = f"(SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, {PLACE.format(k='s_suppkey')} FROM supplier)"
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(lat - (-12.0464)) / 2), 2) + cos(radians(-12.0464)) * cos(radians(lat)) * pow(sin(radians(lon - (-77.0428)) / 2), 2)))))"
_EUC = "sqrt(pow(lat - (-12.0464), 2) + pow(lon - (-77.0428), 2))"


@register("geo_range_haversine", f"SELECT id, round({_HAV}, 3) AS d FROM {_STORES} WHERE {_HAV} <= 6000")
def geo_range_haversine(spark, sf_dir):
    return spatial.in_circle(stores(spark, sf_dir), CENTRE, 6000).select("id", F.round("_distance", 3).alias("d"))


@register("geo_range_euclid", f"SELECT id, round({_EUC}, 9) AS d FROM {_STORES} WHERE {_EUC} < 0.0512345")
def geo_range_euclid(spark, sf_dir):
    return spatial.in_circle(stores(spark, sf_dir), CENTRE, 0.0512345, "euclidean", strict=True).select("id", F.round("_distance", 9).alias("d"))


@register("geo_range_attr", f"SELECT id, round(balance, 2) AS balance FROM {_STORES} WHERE {_HAV} <= 9000 AND balance > 2000")
def geo_range_attr(spark, sf_dir):
    return spatial.in_circle(stores(spark, sf_dir).filter("balance > 2000"), CENTRE, 9000).select("id", F.round("balance", 2).alias("balance"))


@register("geo_knn", f"SELECT id, round({_HAV}, 3) AS d FROM {_STORES} ORDER BY {_HAV}, id LIMIT 10")
def geo_knn(spark, sf_dir):
    return spatial.nearest(stores(spark, sf_dir), CENTRE, 10, "id").select("id", F.round("_distance", 3).alias("d"))


@register("geo_knn_filtered", f"SELECT id, round({_EUC}, 9) AS d FROM {_STORES} WHERE balance < 5000 ORDER BY {_EUC}, id LIMIT 7")
def geo_knn_filtered(spark, sf_dir):
    return spatial.nearest(stores(spark, sf_dir).filter("balance < 5000"), CENTRE, 7, "id", "euclidean").select("id", F.round("_distance", 9).alias("d"))


@register("geo_polygon", f"SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM {_STORES} WHERE lat BETWEEN -12.1 - 1e-12 AND -12.0 + 1e-12 AND lon BETWEEN -77.1 - 1e-12 AND -77.0 + 1e-12")
def geo_polygon(spark, sf_dir):
    return spatial.in_polygon(stores(spark, sf_dir), RING).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@register("geo_bounds", f"SELECT round(min(lat), 9) AS south, round(min(lon), 9) AS west, round(max(lat), 9) AS north, round(max(lon), 9) AS east, count(*) AS n_points FROM {_STORES}")
def geo_bounds(spark, sf_dir):
    return rounded(spatial.bounds(stores(spark, sf_dir)), 9)


@register(
    "geo_batch_knn",
    f"WITH q AS (SELECT id AS query, lat AS qlat, lon AS qlon FROM {_STORES} WHERE id % 100 = 0), p AS (SELECT * FROM {_STORES}), d AS (SELECT query, id AS key, sqrt(pow(lat - qlat, 2) + pow(lon - qlon, 2)) AS distance FROM q, p) SELECT query, key, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS r FROM d) WHERE r <= 1",
)
def geo_batch_knn(spark, sf_dir):
    s = stores(spark, sf_dir)
    points = [(r["id"], r["lat"], r["lon"]) for r in s.filter("id % 100 = 0").select("id", "lat", "lon").collect()]
    return spatial.nearest_batch(s, points, 1, "id", "euclidean").select("query", "key", F.round("distance", 9).alias("distance"))


@register("geo_map_points", f"SELECT name AS label, round(lat, 9) AS lat, round(lon, 9) AS lon FROM {_STORES}")
def geo_map_points(spark, sf_dir):
    return rounded(spatial.points(stores(spark, sf_dir), "name"), 9)


@register(
    "geo_store_stock",
    f"SELECT s.id, round({_HAV}, 3) AS d, round(sum(l_quantity), 2) AS amount FROM {_STORES} s JOIN lineitem ON l_suppkey = s.id WHERE l_partkey = 1 AND {_HAV} <= 20000 GROUP BY s.id, lat, lon",
)
def geo_store_stock(spark, sf_dir):
    stock = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tienda_id"), F.col("l_partkey").alias("producto_id"), F.col("l_quantity").alias("cantidad"))
    found = recommend.stores_with_stock(stores(spark, sf_dir), stock, 1, CENTRE, 20000)
    return found.select("id", F.round("distance_m", 3).alias("d"), F.round("amount", 2).alias("amount"))


# -- text

_TOK = r"regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_POST = f"toks AS (SELECT doc_id, source, n_chars, {_TOK} AS t FROM documents), post AS (SELECT doc_id, u.term, count(*) AS tf FROM toks, unnest(t) AS u(term) GROUP BY ALL), stat AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks), lens AS (SELECT doc_id, len(t) AS len FROM toks), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"
_BM = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))"


def _query_sql(words: str) -> str:
    return "q AS (SELECT term, count(*)::DOUBLE AS times FROM (VALUES " + ", ".join(f"('{w}')" for w in words.split()) + ") v(term) GROUP BY term)"


def _bm25_sql(words: str, where: str = "", limit: int = 10) -> str:
    return f"WITH {_POST}, {_query_sql(words)}, s AS (SELECT post.doc_id, sum(times * {_BM}) AS score FROM post JOIN q USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stat GROUP BY post.doc_id) SELECT s.doc_id, round(score, 6) AS score FROM s JOIN toks USING (doc_id) {where} ORDER BY round(score, 6) DESC, s.doc_id LIMIT {limit}"


QUERY = "the thand ererth of"
REPEAT = "und enge enge nicht und und"


@register("text_tokens", f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, list_aggregate({_TOK}[1:5], 'string_agg', ' ') AS head FROM documents")
def text_tokens(spark, sf_dir):
    t = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.nullif(F.array_join(F.slice(t, 1, 5), " "), F.lit("")).alias("head"))


@register("text_stats", f"WITH {_POST} SELECT term, df::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post JOIN dfs USING (term) GROUP BY term, df")
def text_stats(spark, sf_dir):
    return longs(text.lexicon(text.postings(table(spark, sf_dir, "documents"), "doc_id", "text")), "df", "cf")


def _ranked(spark, sf_dir, query, limit=10, where=None):
    found = text.bm25(table(spark, sf_dir, "documents"), "text", query, where=where).select("doc_id", F.round("_score", 6).alias("score"))
    return found.orderBy(F.col("score").desc(), "doc_id").limit(limit)


register("text_bm25", _bm25_sql(QUERY))(lambda spark, sf_dir: _ranked(spark, sf_dir, QUERY))
register("text_bm25_repeat", _bm25_sql(REPEAT))(lambda spark, sf_dir: _ranked(spark, sf_dir, REPEAT))
register("text_match_filter", _bm25_sql(QUERY, "WHERE source = 'src0'"))(lambda spark, sf_dir: _ranked(spark, sf_dir, QUERY, where=F.col("source") == "src0"))


@register("text_match_order_col", f"WITH {_POST}, {_query_sql('erer erth')} SELECT doc_id, n_chars FROM toks WHERE doc_id IN (SELECT doc_id FROM post JOIN q USING (term)) ORDER BY n_chars DESC, doc_id LIMIT 15")
def text_match_order_col(spark, sf_dir):
    e = engine(spark, sf_dir, "documents")
    return e.sql("SELECT doc_id, n_chars FROM documents WHERE MATCH(text, 'erer erth') USING BM25 ORDER BY n_chars DESC, doc_id LIMIT 15")


_TFIDF = f"""WITH {_POST}, {_query_sql(QUERY)}, w AS (SELECT doc_id, term, (1 + log10(tf)) * log10(n / df) AS w FROM post JOIN dfs USING (term), stat),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
qw AS (SELECT term, (1 + log10(times)) * log10(n / df) AS w FROM q JOIN dfs USING (term), stat), qn AS (SELECT sqrt(sum(w * w)) AS qnorm FROM qw WHERE w > 0)
SELECT doc_id, round(least(1.0, sum(w.w * qw.w) / any_value(norm) / any_value(qnorm)), 6) AS score FROM w JOIN qw USING (term) JOIN norms USING (doc_id), qn WHERE qw.w > 0 GROUP BY doc_id HAVING sum(w.w * qw.w) > 0 ORDER BY score DESC, doc_id LIMIT 10"""


@register("text_tfidf", _TFIDF)
def text_tfidf(spark, sf_dir):
    found = text.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("_score", 6).alias("score"))
    return found.orderBy(F.col("score").desc(), "doc_id").limit(10)


_BATCH = f"""WITH {_POST}, q AS (SELECT item_id AS query, u.term, count(*)::DOUBLE AS times FROM benchmark, unnest({_TOK}) AS u(term) GROUP BY ALL)
SELECT query, key, round(score, 6) AS score FROM (SELECT query, post.doc_id AS key, sum(times * {_BM}) AS score, row_number() OVER (PARTITION BY query ORDER BY round(sum(times * {_BM}), 6) DESC, post.doc_id) AS r FROM post JOIN q USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stat GROUP BY query, post.doc_id) WHERE r <= 5"""


@register("text_batch", _BATCH)
def text_batch(spark, sf_dir):
    from pyspark.sql import Window

    s = text.batch_bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    s = s.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")


@register("text_index_lookup", f"WITH {_POST} SELECT doc_id AS key, tf FROM post WHERE term = 'ererth'")
def text_index_lookup(spark, sf_dir):
    index = text.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", workspace.path(spark, "index"), "v1")
    return index.lookup(spark, "ererth").select("key", "tf")


# -- vectors

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DOT = "list_inner_product(embedding::DOUBLE[], q)"
_SQL = {
    "euclidean": ("1 / (1 + list_distance(embedding::DOUBLE[], q))", "list_distance(embedding::DOUBLE[], q)"),
    "cosine": ("list_cosine_similarity(embedding::DOUBLE[], q)",) * 2,
    "dot": (_DOT,) * 2,
}


def _first_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


def _vector(name: str, metric: str, where: str = "TRUE") -> None:
    score, raw = _SQL[metric]
    sql = f"SELECT vec_id, round({score}, 6) AS score, round({raw}, 6) AS raw FROM embeddings, {_Q} WHERE {where} ORDER BY {score} DESC, vec_id LIMIT 10"

    def run(spark, sf_dir):
        found = vector.top_k(table(spark, sf_dir, "embeddings"), "embedding", _first_vector(spark, sf_dir), 10, "vec_id", metric, None if where == "TRUE" else F.expr(where))
        return found.select("vec_id", F.round("_score", 6).alias("score"), F.round("_raw_metric", 6).alias("raw"))

    register(name, sql)(run)


_vector("vec_euclid", "euclidean")
_vector("vec_cosine", "cosine")
_vector("vec_dot", "dot")
_vector("vec_filtered", "cosine", "label = 3")


@register("vec_parse", "SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vec_parse(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    listed = F.when(F.col("vec_id") % 2 == 0, F.to_json(F.col("embedding").cast("array<double>"))).otherwise(F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "))
    v = vectors.parse(listed)
    return t.select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_BATCH_VEC = "SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"
_TOP5 = f"(SELECT query, key, round(s, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, key) AS rank FROM ({_BATCH_VEC}))"


def _batch(spark, sf_dir, k=5):
    t = table(spark, sf_dir, "embeddings")
    return vector.batch_top_k(t, "embedding", "vec_id", t.filter("vec_id % 100 = 0"), "vec_id", "embedding", k, "cosine", skip_self=True)


@register("vec_batch_topk", f"SELECT query, key, score, rank::INTEGER AS rank FROM {_TOP5} WHERE rank <= 5")
def vec_batch_topk(spark, sf_dir):
    return rounded(_batch(spark, sf_dir))


@register("vec_precision_label", f"SELECT query, round(avg((a.label = b.label)::INTEGER), 6) AS precision, max(CASE WHEN rank = 1 THEN (a.label = b.label)::INTEGER::DOUBLE END) AS top1 FROM {_TOP5} t JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = key WHERE rank <= 5 GROUP BY query")
def vec_precision_label(spark, sf_dir):
    return rounded(evaluate.label_precision(_batch(spark, sf_dir), table(spark, sf_dir, "embeddings"), label_key="vec_id"))


@register("vec_ivf_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vec_ivf_recall(spark, sf_dir):
    """Whether the inverted file finds nine in ten of the 10 nearest, over every 100th vector."""
    t = table(spark, sf_dir, "embeddings")
    index = vector.InvertedFile.build(t, "embedding", "vec_id", "cosine").save(workspace.path(spark, "ivf"))
    queries = t.filter("vec_id % 100 = 0")
    exact = vector.batch_top_k(t, "embedding", "vec_id", queries, "vec_id", "embedding", 10, "cosine")
    found = index.batch_top_k(queries, "vec_id", "embedding", 10)
    return vector.recall(found, exact).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


@register("vec_space_quality", "SELECT round(avg(CASE WHEN a.label = b.label THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END), 6) AS intra, round(avg(CASE WHEN a.label <> b.label THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END), 6) AS inter FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id")
def vec_space_quality(spark, sf_dir):
    return rounded(evaluate.space_quality(table(spark, sf_dir, "embeddings"), "label", "embedding"))


# -- bags of words: vectors as local descriptors, labels as objects, label means as the codebook

_CENTRES = "cent AS (SELECT label AS word, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_HIST = f"{_CENTRES}, near AS (SELECT vec_id, e.label AS object, arg_min(word, round(list_distance(embedding::DOUBLE[], c), 9) * 1000 + 0) AS word FROM embeddings e, cent GROUP BY vec_id, e.label), hist AS (SELECT object, word, count(*) AS n FROM near GROUP BY object, word)"


@register("bow_histogram", f"WITH {_HIST} SELECT object, word, n FROM hist")
def bow_histogram(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return bow.histogram(t.withColumnRenamed("label", "object"), "object", "embedding", bow.class_means(t, "label", "embedding"))


_TFI = f"{_HIST}, nobj AS (SELECT count(DISTINCT object)::DOUBLE AS n_obj FROM hist), dfw AS (SELECT word, count(*)::DOUBLE AS df FROM hist GROUP BY word), tot AS (SELECT object, sum(n)::DOUBLE AS total FROM hist GROUP BY object), w AS (SELECT object, word, n / total * (ln((1 + n_obj) / (1 + df)) + 1) AS x FROM hist JOIN dfw USING (word) JOIN tot USING (object), nobj), nrm AS (SELECT object, sqrt(sum(x * x)) AS l FROM w GROUP BY object), tfidf AS (SELECT object, word, x / l AS weight FROM w JOIN nrm USING (object))"


def _bow(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return bow.tfidf(bow.histogram(t.withColumnRenamed("label", "object"), "object", "embedding", bow.class_means(t, "label", "embedding")))


@register("bow_tfidf", f"WITH {_TFI} SELECT object, word, round(weight, 6) AS weight FROM tfidf")
def bow_tfidf(spark, sf_dir):
    return rounded(_bow(spark, sf_dir))


@register("bow_cosine_topk", f"WITH {_TFI} SELECT a.object AS query, b.object AS key, round(sum(a.weight * b.weight), 6) AS score FROM tfidf a JOIN tfidf b USING (word) WHERE a.object <> b.object GROUP BY a.object, b.object")
def bow_cosine_topk(spark, sf_dir):
    return rounded(bow.similar(_bow(spark, sf_dir)))


# -- audio: labels as tracks, seconds in order of the vectors' ids

_SEG = "seg AS (SELECT vec_id, label AS track, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS second, embedding::DOUBLE[] AS v FROM embeddings)"
_CAND = f"{_SEG}, qs AS (SELECT second AS q_second, v AS qv FROM seg WHERE track = 2 AND second < 12), pairs AS (SELECT q_second, track, second, list_cosine_similarity(v, qv) AS score FROM qs, seg), cand AS (SELECT q_second, track, second, score FROM (SELECT *, row_number() OVER (PARTITION BY q_second ORDER BY round(score, 12) DESC, track, second) AS r FROM pairs) WHERE r <= 25)"


def _segments(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("track"), (F.row_number().over(w) - 1).alias("second"), F.col("embedding").cast("array<double>").alias("v"))


def _candidates(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return audio.candidates(s, s.filter("track = 2 AND second < 12").select(F.col("second").alias("q_second"), "v"), 25)


@register("audio_candidates", f"WITH {_CAND} SELECT q_second, track, second, round(score, 6) AS score FROM cand")
def audio_candidates(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir))


@register(
    "audio_align",
    f"WITH {_CAND}, best AS (SELECT track, second - q_second AS off, q_second, max(score) AS s FROM cand WHERE score >= 0.2 GROUP BY ALL), g AS (SELECT track, off, count(*) AS matched, avg(s) AS mean, count(*) / 12.0 * avg(s) AS score FROM best GROUP BY track, off HAVING count(*) >= 2) SELECT track, round(score, 6) AS score, round(mean, 6) AS mean_similarity, round(matched / 12.0, 6) AS coverage, matched AS matched_seconds, off AS offset_seconds FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score, 12) DESC, off) AS r FROM g) WHERE r = 1",
)
def audio_align(spark, sf_dir):
    found = audio.align(_candidates(spark, sf_dir), 12, min_similarity=0.2, top=None)
    return rounded(found.select("track", "score", "mean_similarity", "coverage", "matched_seconds", "offset_seconds"))


# -- recommendations

_BUY = "buy AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_COP = f"WITH {_BUY}, x AS (SELECT u FROM buy WHERE i = 1 ORDER BY u LIMIT 300), n AS (SELECT count(*)::DOUBLE AS n FROM x) SELECT i AS item, round(count(*) / any_value(n), 6) AS score, count(*) AS evidence FROM buy JOIN x USING (u), n WHERE i <> 1 {{extra}} GROUP BY i"


@register("rec_copurchase", _COP.format(extra=""))
def rec_copurchase(spark, sf_dir):
    return rounded(recommend.copurchase(purchases(spark, sf_dir), 1, "user", "item"))


@register("rec_copurchase_user", _COP.format(extra="AND i NOT IN (SELECT i FROM buy WHERE u = (SELECT min(u) FROM x))"))
def rec_copurchase_user(spark, sf_dir):
    p = purchases(spark, sf_dir)
    u = p.filter("item = 1").agg(F.min("user")).first()[0]
    return rounded(recommend.copurchase(p, 1, "user", "item", exclude_user=u))


@register("rec_metadata", "WITH x AS (SELECT p_type AS t, p_retailprice AS p FROM part WHERE p_partkey = 5) SELECT p_partkey, round(1 / (1 + abs(p_retailprice - p) / greatest(abs(p), 1)), 6) AS score FROM part, x WHERE p_type = t AND p_partkey <> 5")
def rec_metadata(spark, sf_dir):
    return rounded(recommend.metadata(table(spark, sf_dir, "part"), 5, "p_partkey", "p_type", "p_retailprice"))


@register("rec_visual", f"SELECT vec_id, round((list_cosine_similarity(embedding::DOUBLE[], q) + 1) / 2, 6) AS score FROM embeddings, {_Q} WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def rec_visual(spark, sf_dir):
    return rounded(recommend.visual(table(spark, sf_dir, "embeddings"), 0, 10, "vec_id"))


@register("rec_text", f"WITH {_POST}, q AS (SELECT u.term, count(*)::DOUBLE AS times FROM toks, unnest(t) AS u(term) WHERE doc_id = 3 GROUP BY u.term), s AS (SELECT post.doc_id, sum(times * {_BM}) AS score FROM post JOIN q USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stat GROUP BY post.doc_id) SELECT doc_id, round(score, 5) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 11) WHERE doc_id <> 3 ORDER BY score DESC, doc_id LIMIT 10")
def rec_text(spark, sf_dir):
    return rounded(recommend.similar_text(table(spark, sf_dir, "documents"), 3, 10, "doc_id", "text"), 5)


@register("rec_stores", f"SELECT s.id, round({_HAV}, 3) AS d FROM {_STORES} s WHERE {_HAV} <= 15000 AND id IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 2 AND l_quantity > 0) ORDER BY {_HAV}, s.id LIMIT 5")
def rec_stores(spark, sf_dir):
    stock = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tienda_id"), F.col("l_partkey").alias("producto_id"), F.col("l_quantity").alias("cantidad"))
    return recommend.stores_with_stock(stores(spark, sf_dir), stock, 2, CENTRE, 15000, 5).select("id", F.round("distance_m", 3).alias("d"))


def _scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.lit("price").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")).filter("id % 3 <> 0")
    b = p.select(F.lit("size").alias("source"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")).filter("id % 2 = 0")
    c = p.select(F.lit("flat").alias("source"), F.col("p_partkey").alias("id"), F.lit(4.0).alias("score")).filter("id % 7 = 0")
    return a.unionByName(b).unionByName(c)


_SC = "raw AS (SELECT 'price' AS source, p_partkey AS id, p_retailprice AS score FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'size', p_partkey, p_size::DOUBLE FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'flat', p_partkey, 4.0 FROM part WHERE p_partkey % 7 = 0), best AS (SELECT source, id, max(score) AS score FROM raw GROUP BY source, id), norm AS (SELECT source, id, CASE WHEN max(score) OVER (PARTITION BY source) > min(score) OVER (PARTITION BY source) THEN (score - min(score) OVER (PARTITION BY source)) / (max(score) OVER (PARTITION BY source) - min(score) OVER (PARTITION BY source)) ELSE 1.0 END AS score FROM best)"


@register("rec_normalize", f"WITH {_SC} SELECT source, id, round(score, 6) AS score FROM norm")
def rec_normalize(spark, sf_dir):
    return rounded(recommend.normalised(_scores(spark, sf_dir)))


@register("rec_fusion", f"WITH {_SC}, w AS (SELECT * FROM (VALUES ('price', 3.0), ('size', 1.0), ('flat', 1.0)) v(source, w)), f AS (SELECT id, sum(w / 5.0 * score) AS score, count(*) AS n_sources FROM norm JOIN w USING (source) WHERE id <> 14 GROUP BY id) SELECT id, round(score, 6) AS score, n_sources FROM f ORDER BY round(score, 12) DESC, n_sources DESC, id LIMIT 20")
def rec_fusion(spark, sf_dir):
    return rounded(recommend.fuse(_scores(spark, sf_dir), {"price": 3.0}, 14, 20).select("id", "score", "n_sources"))


_BASK = "bk AS (SELECT o_custkey AS u, o_orderdate AS day, list_sort(list(DISTINCT l_partkey)) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1)"


@register("rec_baskets", f"WITH {_BASK} SELECT u AS \"user\", day, a.anchor, (len(items) - 1)::INTEGER AS n_relevant FROM bk, unnest(items) AS a(anchor)")
def rec_baskets(spark, sf_dir):
    return recommend.baskets(purchases(spark, sf_dir), "user", "day", "item").select("user", "day", "anchor", F.size("relevant").alias("n_relevant"))


# -- evaluation: nearest vectors against labels

_REL = "rel AS (SELECT a.vec_id AS case_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"
_EVAL = f"WITH {_REL}, rk AS (SELECT query AS case_id, key AS id, rank FROM {_TOP5} WHERE rank <= 10), h AS (SELECT rk.case_id, rank FROM rk JOIN rel USING (case_id, id)), n AS (SELECT case_id, count(*) AS n_rel FROM rel GROUP BY case_id)"


def _eval(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    ranked = _batch(spark, sf_dir, 10).select(F.col("query").alias("case_id"), F.col("key").alias("id"), "rank")
    a, b = t.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"), "label"), t.select(F.col("vec_id").alias("id"), "label")
    return ranked, a.join(b, "label").filter("case_id <> id").select("case_id", "id")


@register("eval_precision", f"{_EVAL} SELECT n.case_id, round(coalesce(sum((rank <= 10)::INTEGER), 0) / 10.0, 6) AS precision, round(coalesce(sum((rank <= 10)::INTEGER), 0) / any_value(n_rel)::DOUBLE, 6) AS recall, (coalesce(sum((rank <= 10)::INTEGER), 0) > 0)::INTEGER::DOUBLE AS hit, round(coalesce(sum((rank <= 3)::INTEGER), 0) / 3.0, 6) AS precision_3 FROM n LEFT JOIN h USING (case_id) GROUP BY n.case_id")
def eval_precision(spark, sf_dir):
    return rounded(evaluate.ranking_metrics(*_eval(spark, sf_dir)).select("case_id", "precision", "recall", "hit", "precision_3"))


@register("eval_ndcg_mrr", f"{_EVAL}, i AS (SELECT case_id, sum(1 / log2(g + 1)) AS ideal FROM n, generate_series(1, 10) s(g) WHERE g <= n_rel GROUP BY case_id) SELECT n.case_id, round(coalesce(sum(1 / log2(rank + 1)), 0) / any_value(ideal), 6) AS ndcg, round(coalesce(1.0 / min(rank), 0), 6) AS mrr FROM n LEFT JOIN h USING (case_id) JOIN i USING (case_id) GROUP BY n.case_id")
def eval_ndcg_mrr(spark, sf_dir):
    return rounded(evaluate.ranking_metrics(*_eval(spark, sf_dir)).select("case_id", "ndcg", "mrr"))


@register(
    "eval_leave_last",
    'WITH r AS (SELECT o_custkey AS "user", l_partkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT "user", max(CASE WHEN r = 1 THEN item END) AS held, max(CASE WHEN r = 2 THEN item END) AS anchor FROM r WHERE r <= 2 GROUP BY "user" HAVING max(CASE WHEN r = 2 THEN item END) IS NOT NULL',
)
def eval_leave_last(spark, sf_dir):
    p = purchases(spark, sf_dir)
    return recommend.leave_last(p, "user", "item", [F.col(c).desc() for c in ("day", "o_orderkey", "l_linenumber", "item", "amount")])


@register("eval_coverage", f"SELECT (SELECT count(*) FROM embeddings) AS n_items, count(DISTINCT key) AS n_shown, round(count(DISTINCT key) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS coverage FROM {_TOP5} WHERE rank <= 5")
def eval_coverage(spark, sf_dir):
    return rounded(evaluate.coverage(_batch(spark, sf_dir).select(F.col("key").alias("vec_id")), table(spark, sf_dir, "embeddings"), "vec_id"))


@register("data_checks", "SELECT 'bad_amounts' AS name, count(*) AS n FROM lineitem WHERE NOT l_quantity > 0 OR l_quantity IS NULL UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_products', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def data_checks(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "item")
    found = evaluate.check_data(p, table(spark, sf_dir, "part"), "item", "l_quantity", "p_partkey")
    return spark.createDataFrame(sorted(found.items()), "name string, n bigint")


# -- writes: the same logical result

def _orders_table(spark, sf_dir) -> Engine:
    e = Engine(spark)
    e.execute("CREATE TABLE sales (id BIGINT PRIMARY KEY, customer BIGINT, status VARCHAR(1), total DOUBLE)", True)
    e.catalog.append("sales", table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS customer", "o_orderstatus AS status", "o_totalprice AS total"))
    return e


_SALES = "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, round(o_totalprice, 6) AS total FROM orders"


@register("dml_insert", f"{_SALES} UNION ALL SELECT -1, 7, 'O', 12.5")
def dml_insert(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.execute("INSERT INTO sales VALUES (-1, 7, 'O', 12.5)", True)
    return rounded(e.sql("SELECT * FROM sales"))


@register("dml_update", "SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_totalprice > 150000 THEN 'X' ELSE o_orderstatus END AS status, round(o_totalprice, 6) AS total FROM orders")
def dml_update(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.execute("UPDATE sales SET status = 'X' WHERE total > 150000", True)
    return rounded(e.sql("SELECT * FROM sales"))


@register("dml_delete", f"{_SALES} WHERE NOT (o_orderstatus = 'F' OR o_custkey < 50)")
def dml_delete(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    e.execute("DELETE FROM sales WHERE status = F OR customer < 50", True)
    return rounded(e.sql("SELECT * FROM sales"))


@register("txn_rollback", _SALES)
def txn_rollback(spark, sf_dir):
    e = _orders_table(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM sales WHERE customer > 10", "INSERT INTO sales VALUES (-5, 1, 'P', 1)", "ROLLBACK"):
        e.execute(s, True)
    return rounded(e.sql("SELECT * FROM sales"))


def _csv(spark, sf_dir) -> str:
    where = workspace.path(spark, "csv")
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS Id", "p_name AS Name", "p_retailprice AS ` Price `", "CASE WHEN p_partkey % 10 = 0 THEN 'oops' ELSE cast(p_size AS string) END AS Size")
    t.write.option("header", True).csv(where)
    return where


@register("csv_infer", "SELECT * FROM (VALUES ('id', 'int', NULL), ('name', 'string', (SELECT max(octet_length(p_name::BLOB))::INTEGER FROM part)), ('price', 'double', NULL), ('size', 'string', 4)) v(name, type, length)")
def csv_infer(spark, sf_dir):
    found = csvio.infer(spark, _csv(spark, sf_dir))
    return spark.createDataFrame([(n, t.kind, t.length) for n, t in found], "name string, type string, length int")


@register("csv_import_report", "SELECT count(*) AS rows_read, count(*) FILTER (p_partkey % 10 <> 0) AS inserted, count(*) FILTER (p_partkey % 10 = 0) AS failed FROM part")
def csv_import_report(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE goods (id INT PRIMARY KEY, name VARCHAR(40), price FLOAT, size INT)", True)
    r = csvio.import_into(e.catalog, "goods", _csv(spark, sf_dir))
    return spark.createDataFrame([(r["rows_read"], r["inserted"], r["failed"])], "rows_read bigint, inserted bigint, failed bigint")
