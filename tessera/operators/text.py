"""Full-text ranking: statistics, BM25, TF-IDF cosine, postings.

Statistics always come from the whole table; filters only choose which hits are shown. A
single BM25 query needs no postings: one aggregation counts documents, lengths and document frequencies
of the query's terms, and the scores are a projection over the scan. Postings serve
TF-IDF norms, many queries at once, and saved indexes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.tokens import tokenize, tokens

K1, B = 1.2, 0.75


def bm25_idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def tfidf_idf(n: int, df: int) -> float:
    return math.log10(n / df) if df else 0.0


def terms_of(query: str, **options) -> Counter:
    """The query's terms and how often each is named; none is an error."""
    found = Counter(tokenize(query, **options))
    if not found:
        raise EngineError("the query has no searchable term")
    return found


def _tokenized(docs: DataFrame, text: str, tokenizer=tokens) -> DataFrame:
    return docs.withColumn("_tokens", tokenizer(F.col(text)))


def _times(words: Column, word: str) -> Column:
    """How often a word is in an array, within generated code."""
    return F.size(words) - F.size(F.array_remove(words, word))


def statistics(docs: DataFrame, text: str, terms: list[str], tokenizer=tokens) -> tuple[int, float, dict[str, int]]:
    """Documents, mean length (empty ones included), and document frequency of the given terms: one row."""
    t = F.col("_tokens")
    row = (
        _tokenized(docs.select(text), text, tokenizer)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(t)).alias("avgdl"), *[F.count_if(F.array_contains(t, w)).alias(f"t{i}") for i, w in enumerate(terms)])
        .first()
    )
    return row["n"], row["avgdl"] or 0.0, {w: row[f"t{i}"] for i, w in enumerate(terms)}


def bm25(docs: DataFrame, text: str, query: str, tokenizer=tokens, k1: float = K1, b: float = B, where: Column | None = None) -> DataFrame:
    """``docs`` that match, with ``_score``; a term that the query repeats counts as often."""
    wanted = terms_of(query)
    n, avgdl, df = statistics(docs, text, list(wanted), tokenizer)
    if not n:
        raise EngineError("the table is empty")
    rows = _tokenized(docs if where is None else docs.filter(where), text, tokenizer)
    t = F.col("_tokens")
    share = F.size(t) / F.lit(avgdl or 1.0)
    score = F.lit(0.0)
    for word, times in sorted(wanted.items()):
        tf = _times(t, word)
        score = score + times * bm25_idf(n, df[word]) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * share))
    hit = F.arrays_overlap(t, F.array(*[F.lit(w) for w in wanted]))
    # every hit scores above 0; a filter on the score would be pushed down and tokenise again
    return rows.filter(hit).withColumn("_score", score).drop("_tokens")


def postings(docs: DataFrame, key: str, text: str, tokenizer=tokens) -> DataFrame:
    """(term, key, tf): counts are combined before the shuffle."""
    return _tokenized(docs, text, tokenizer).select(F.col(key).alias("key"), F.explode("_tokens").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"))


def lexicon(posted: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def document_norms(posted: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(key, norm) over all terms of a document with weight (1 + log10 tf) log10(N / df)."""
    weight = (1 + F.log10("tf")) * F.log10(F.lit(float(max(n, 1))) / F.col("df"))
    return posted.join(terms, "term").groupBy("key").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def tfidf(docs: DataFrame, key: str, text: str, query: str, tokenizer=tokens, where: Column | None = None) -> DataFrame:
    """``docs`` that match, with ``_score``: cosine of query and document, 1 at most."""
    wanted = terms_of(query)
    n, _, df = statistics(docs, text, list(wanted), tokenizer)
    if not n:
        raise EngineError("the table is empty")
    weights = {w: (1 + math.log10(c)) * tfidf_idf(n, df[w]) for w, c in wanted.items() if df[w]}
    weights = {w: x for w, x in weights.items() if x > 0}
    size = math.sqrt(sum(x * x for x in weights.values()))
    rows = _tokenized(docs if where is None else docs.filter(where), text, tokenizer)
    t = F.col("_tokens")
    if not weights:
        return rows.drop("_tokens").withColumn("_score", F.lit(0.0)).filter(F.lit(False))
    product = F.lit(0.0)
    for word, x in sorted(weights.items()):
        tf = _times(t, word)
        product = product + F.when(tf > 0, (x / size) * (1 + F.log10(tf)) * tfidf_idf(n, df[word])).otherwise(0.0)
    hits = rows.filter(F.arrays_overlap(t, F.array(*[F.lit(w) for w in weights]))).withColumn("_product", product).drop("_tokens")
    # norms are needed of the hits alone, but each needs the df of all of its terms
    posted = postings(docs, key, text, tokenizer)
    norms = document_norms(posted.join(hits.select(F.col(key).alias("key")).distinct(), "key", "left_semi"), lexicon(posted).select("term", "df"), n)
    scored = hits.join(norms, hits[key] == norms["key"]).drop("key") if key != "key" else hits.join(norms, "key")
    return scored.withColumn("_score", F.least(F.lit(1.0), F.when(F.col("norm") > 0, F.col("_product") / F.col("norm")).otherwise(0.0))).drop("_product", "norm").filter("_score > 0")


def match(docs: DataFrame, key: str, text: str, query: str, model: str = "bm25", where: Column | None = None, limit: int | None = None, tokenizer=tokens) -> DataFrame:
    """Ranked hits with ``_score``, best first, ties by key."""
    name = model.lower().replace("_", "")
    if name not in ("bm25", "tfidf"):
        raise EngineError(f"unknown text model: {model}")
    found = bm25(docs, text, query, tokenizer, where=where) if name == "bm25" else tfidf(docs, key, text, query, tokenizer, where)
    found = found.orderBy(F.col("_score").desc(), F.col(key).asc())
    return found if limit is None else found.limit(limit)


def batch_bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, tokenizer=tokens, k1: float = K1, b: float = B, reproducible: bool = False) -> DataFrame:
    """(query, key, score) of all hits of many queries in one job; repeats in a query add up.

    ``reproducible`` adds up each hit's parts by size, so that equal texts have scores equal to the last bit.
    """
    rows = _tokenized(docs.select(key, text), text, tokenizer)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_tokens")).alias("avgdl")).first()
    asked = _tokenized(queries, query_text, tokenizer).select(F.col(query_key).alias("query"), F.explode("_tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = asked.select("term").distinct()
    posted = (
        rows.select(F.col(key).alias("key"), F.size("_tokens").alias("len"), F.explode("_tokens").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("term", "key", "len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["avgdl"] or 1.0)))
    score = F.aggregate(F.sort_array(F.collect_list(part)), F.lit(0.0), lambda x, y: x + y) if reproducible else F.sum(part)
    return posted.join(asked.join(df, "term"), "term").groupBy("query", "key").agg(score.alias("score"))


def sparse_cosine(a: dict[str, float], b: dict[str, float]) -> float:
    """Cosine of two sparse vectors; 0 where one is empty."""
    size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return max(-1.0, min(1.0, sum(x * b.get(t, 0.0) for t, x in a.items()) / size)) if size else 0.0


@dataclass
class TextIndex:
    """A saved inverted index: postings sorted by term, lexicon, document lengths and norms.

    ``signature`` is the version of the table it was built from; another version asks for a rebuild.
    """

    folder: str
    signature: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, folder: str, signature: str, tokenizer=tokens) -> TextIndex:
        spark = docs.sparkSession
        posted = postings(docs, key, text, tokenizer)
        # a range shuffle by term makes files whose statistics find a term without a scan
        posted.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{folder}/postings")
        posted = spark.read.parquet(f"{folder}/postings")
        lexicon(posted).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/lexicon")
        terms = spark.read.parquet(f"{folder}/lexicon")
        lengths = _tokenized(docs, text, tokenizer).select(F.col(key).alias("key"), F.size("_tokens").alias("len"))
        n = lengths.count()
        lengths.join(document_norms(posted, terms, n), "key", "left").write.mode("overwrite").parquet(f"{folder}/documents")
        spark.createDataFrame([(signature, n)], "signature string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
        return cls(folder, signature)

    @classmethod
    def load(cls, spark, folder: str, signature: str) -> TextIndex | None:
        """The saved index, if it is of this version."""
        try:
            row = spark.read.parquet(f"{folder}/meta").first()
        except Exception as e:  # noqa: BLE001  nothing saved there
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return cls(folder, signature) if row["signature"] == signature else None

    def lookup(self, spark, term: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings").filter(F.col("term") == term)

    def search(self, spark, query: str, model: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
        """(key, score) of all hits."""
        wanted = terms_of(query)
        docs = spark.read.parquet(f"{self.folder}/documents")
        stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).first()
        n = stats["n"]
        df = {r["term"]: r["df"] for r in spark.read.parquet(f"{self.folder}/lexicon").filter(F.col("term").isin(*wanted)).collect()}
        posted = spark.read.parquet(f"{self.folder}/postings").filter(F.col("term").isin(*wanted))
        bm = model.lower() == "bm25"
        weights = {w: (c * bm25_idf(n, df[w]) if bm else (1 + math.log10(c)) * tfidf_idf(n, df[w])) for w, c in wanted.items() if w in df}
        weights = {w: x for w, x in weights.items() if x > 0}
        if not weights:
            return spark.createDataFrame([], posted.select("key").schema).withColumn("score", F.lit(0.0))
        size = 1.0 if bm else math.sqrt(sum(x * x for x in weights.values()))
        pick = lambda table: F.create_map(*[x for w, v in sorted(table.items()) for x in (F.lit(w), F.lit(float(v)))])[F.col("term")]
        rows = posted.filter(F.col("term").isin(*weights)).join(docs, "key")
        if bm:
            part = pick(weights) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["avgdl"])))
        else:
            part = pick(weights) / size * (1 + F.log10("tf")) * pick({w: tfidf_idf(n, df[w]) for w in weights}) / F.col("norm")
        return rows.groupBy("key").agg(F.sum(part).alias("score")).withColumn("score", F.col("score") if bm else F.least(F.lit(1.0), "score")).filter("score > 0")
