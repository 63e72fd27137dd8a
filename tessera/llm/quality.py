"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions, so the filter runs in the scan's stage with no
shuffle and no user functions. Words are maximal runs of characters other than space
and the controls 09 to 0D (hex); lines are the parts between line feeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Frequent function words of the languages in use; a text in prose has some of them.
STOP_WORDS = (
    "the of and to in is that for it was on are as with at be this by from or an "
    "de la le et les des en un une est que pour dans qui sur pas au du par "
    "der die und das den von zu mit ist im nicht ein eine auf dem sich auch für "
    "el los las del por con para no se una al lo como es su"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes while ``low <= measure <= high``."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are of the text's words, or of its lines with a word.
RULES = (
    Rule("n_words", 50, 200_000),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("words_per_line", 2.0, None),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of the measures; a null text counts as having no words.

    Each step's columns feed the next one's lambdas, which keeps every array computed once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    both_cases = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    n = F.size("_words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "_placed",
                lambda x, k: same(x, F.get(F.col("_placed"), k - 1)) | same(x, F.get(F.col("_placed"), k + 1)),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.transform("_repeated", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_repeated"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    lines = F.size("_lines")
    out = (
        docs.withColumn("_words", F.array_remove(F.split(t, GAP), ""))
        .withColumns({"_hashes": hashes, "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
        .withColumn("_placed", placed)
        .withColumn("_repeated", F.when(F.col("_placed").isNotNull(), repeated))
        .withColumns(
            {
                "n_words": n.cast("bigint"),
                "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("bigint"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": (lines - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
                "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*both_cases))).cast("bigint"),
                "n_lines": lines.cast("bigint"),
            }
        )
    )
    some = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    words, n_lines = F.col("n_words"), F.col("n_lines")
    return out.drop("_words", "_hashes", "_lines", "_placed", "_repeated").withColumns(
        {
            "mean_word_chars": some(F.col("word_chars"), words),
            "symbol_ratio": some(F.col("n_symbols"), words),
            "stop_ratio": some(F.col("n_stop_words"), words),
            "dup_line_ratio": some(F.col("n_dup_lines"), n_lines),
            "words_per_line": some(words, n_lines),
        }
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for the whole table."""
    test = F.lit(True)
    for r in rules:
        if r.low is not None:
            test = test & (F.col(r.measure) >= r.low)
        if r.high is not None:
            test = test & (F.col(r.measure) <= r.high)
    return test


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base; repeated rows are judged alike;
    an empty table gives an empty result. Columns of ``docs`` named as a measure are replaced.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, text).withColumn("base_failed", base).withColumn("kept", ~base & compiled(rules))
