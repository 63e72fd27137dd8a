"""Corpus preparation: language, near-duplicates, benchmark leaks, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import workspace
from tessera.llm import decontamination, langid, mixing, simhash, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Characters in one step of the token output, a quarter of what it takes alone: the heap is grown by the stages before.
TOKEN_STEP = tokens.STEP >> 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those whose language is too close to call.

    Repeated rows are judged alike; without labelled texts nothing is known and nothing stays; an empty table stays empty.
    """
    content = langid.dictionaries(langid.training_rows(docs, ~langid.held_out()))
    found = langid.identify(docs.select(*COLUMNS), content)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.MARGIN)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; null and empty texts form one group, rows without an id come last."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found; null and empty texts stay."""
    return decontamination.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source's words meet its target; documents without words go, null sources form one of their own."""
    return mixing.mixed(docs.select(*COLUMNS), mixing.word_count(F.col("text")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-id files and returns a digest of each document read back from them; a null text has the end id only."""
    where = workspace.path(spark, "tokens")
    tokens.write_tokens(docs, where, step=TOKEN_STEP)
    return tokens.read_tokens(spark, where, digest=True)


STAGES = [
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mixture),
    ("token-id output", token_ids),
]

#: Compression, fingerprints, a latent space and arithmetic coding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
