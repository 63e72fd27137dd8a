"""Tokens of texts: runs of letters and digits of the case-folded, composed text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.workspace import ship

ship()

_RUN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Built-in expression: exact for texts whose folding is lower-casing and sharp s (see ``exact``)."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokenize(text: str | None, stop_words: Iterable[str] = (), strip_accents: bool = False, min_length: int = 1, stemmer: Callable[[str], str] | None = None) -> list[str]:
    """The full rule: NFKC, case folding, accents taken off if asked, NFC; then filters and stemmer."""
    if min_length < 1:
        raise ValueError("min_length must be 1 or more")

    def fold(s: str) -> str:
        s = unicodedata.normalize("NFKC", s).casefold()
        if strip_accents:
            s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", s)

    stops = {fold(w) for w in stop_words}
    found = [t for t in _RUN.findall(fold(text or "")) if len(t) >= min_length and t not in stops]
    return [s for t in found if (s := stemmer(t))] if stemmer else found


def exact(text: Column, **options) -> Column:
    """``tokenize`` as a vectorised function, for folding that built-ins lack, options and stemmers."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenize(t, **options))

    return run(text)
