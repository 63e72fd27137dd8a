"""URL filter: fixed host/path rules first, mined association rules for the rest.

URLs with a label become transactions of tokens (host labels, words of the path, names in
the query) plus an item for a bad label. Spark's FP-growth finds the frequent token sets and
the rules that imply the bad item; rules below the support, rules whose confidence is not well above the share of bad
URLs (by lift, and by a test against chance), and rules that a shorter one makes needless, are pruned. The rest are matched by an inverted
index from token to rules: a rule applies when the tokens of a URL reach it as often as it
has tokens. Everything is built-in DataFrame operations.

Frequent tokens number at most (mean tokens per URL) / ``min_support``, so the index
has a proven bound and travels inside the plan.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.002
#: Confidence over the share of all bad URLs, and by how many standard deviations the bad URLs of a rule must exceed that share.
MIN_LIFT = 2.0
MIN_SIGMA = 3.0


@dataclass(frozen=True)
class PathRule:
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The table of the production query.
PATH_RULES = (
    PathRule("allow", "org", "/"),
    PathRule("block", "example.org", "/es/"),
    PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"),
    PathRule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Mined:
    """A set of tokens that implies the bad label."""

    tokens: tuple[str, ...]
    support: float
    confidence: float


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct typed tokens: ``h:`` host labels, ``p:`` words of the path, ``q:`` names in the query."""
    low = F.lower(F.coalesce(url, F.lit("")))
    query = F.regexp_extract(low, r"\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(
        F.concat(
            named("h:", F.split(host_of(url), r"\.")),
            named("p:", F.split(path_of(low), r"[^\p{L}\p{N}]+")),
            named("q:", F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))),
        )
    )


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_sigma: float = MIN_SIGMA) -> list[Mined]:
    """Rules from rows with a URL and a boolean label.

    Rows without a label or without tokens teach nothing; rows that repeat count each; without rows, bad ones or good ones there are no rules.
    ``support`` is the share of URLs with the tokens and the label.
    """
    items = labelled.filter(F.col(bad).isNotNull()).select(F.concat(tokens_of(F.col(url)), F.when(F.col(bad), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).filter(F.size("items") > 0)
    seen = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    share = seen["bad"] / max(seen["n"], 1)
    if not 0 < share < 1:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(1.0, share * min_lift)).fit(items)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    urls = F.col("support") / F.col("confidence") * seen["n"]  # that have the tokens
    # half a URL less, for small numbers
    found = found.filter((F.col("confidence") - share) * urls - 0.5 >= min_sigma * F.sqrt(urls * share * (1 - share)))
    found = found.select(F.sort_array("antecedent").alias("tokens"), "support", "confidence")
    rules = sorted((Mined(tuple(r["tokens"]), r["support"], r["confidence"]) for r in found.collect()), key=lambda r: (len(r.tokens), -r.confidence, r.tokens))
    kept: list[Mined] = []
    posting: dict[str, list[int]] = {}
    for r in rules:
        hits = Counter(i for t in r.tokens for i in posting.get(t, ()))
        if all(n < len(kept[i].tokens) for i, n in hits.items()):  # no kept rule lies within this one
            for t in r.tokens:
                posting.setdefault(t, []).append(len(kept))
            kept.append(r)
    return kept


def matched(tokens: Column, rules: list[Mined]) -> Column:
    """Whether all tokens of some rule are there, by the inverted index."""
    if not rules:
        return F.lit(False)
    posting: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for t in r.tokens:
            posting.setdefault(t, []).append(i)
    index = F.create_map(*[x for t, ids in sorted(posting.items()) for x in (F.lit(t), F.array(*map(F.lit, ids)))])
    need = F.array(*[F.lit(len(r.tokens)) for r in rules])
    none = F.array().cast("array<int>")
    hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), none)))
    return F.exists(
        F.transform(F.array_distinct(hits), lambda r: F.struct(r.alias("rule"), hits.alias("all"))),
        lambda x: F.size(F.filter(x["all"], lambda y: y == x["rule"])) == F.get(need, x["rule"]),
    )


def judge(pages: DataFrame, mined: list[Mined], path_rules: tuple[PathRule, ...] = PATH_RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict, row by row without a shuffle.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is judged
    by its (no) tokens: allowed. Repeated rows are judged alike, an empty table gives no rows; columns of ``pages`` named host, path, rule or
    verdict are replaced, others stay.
    """
    host, path = F.col("host"), F.col("path")
    tokens = "_tokens"
    while tokens in pages.columns:
        tokens += "_"
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(path_rules, key=lambda r: len(r.name)):  # longer ones go outside, so they win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.name).otherwise(rule)
        by_rule = F.when(fits, r.verdict).otherwise(by_rule)
    method = F.when(matched(F.col(tokens), mined), "block").otherwise("allow")
    return (
        pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), tokens: tokens_of(F.col(url))})
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(by_rule, method))
        .drop(tokens)
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages that show a labelled document (its number is the first one in the path): bad if toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS bigint)")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return pages.select("url", number.alias("doc_id")).filter("doc_id is not null").join(bad, "doc_id").select("url", "bad")
