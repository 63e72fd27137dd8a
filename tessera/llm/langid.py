"""Language identification by compression.

Every language has a raw-content zstandard dictionary of sample text. A text is
written in the language whose dictionary compresses it best; a narrow margin to the second
best means that the choice is not to be trusted.

Texts are reduced to lower-case letters and single spaces and compressed in pieces, so that the
dictionary matters throughout a long text; all pieces count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.workspace import release_memory, ship

ship()

#: Sampled labelled rows per language, and bytes of normalised text that a dictionary holds.
SAMPLE_ROWS = 256
DICT_BYTES = 96 * 1024
PIECE = 4096
LEVEL = 6
#: Relative gain over the second best at which a choice counts as certain.
SURE = 0.08
#: Scores under this are rejected as too close.
MARGIN = 0.10
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numeric characters that are no digits, such as fractions and Roman numerals.
_NUMBERS = regex.compile(r"\p{N}+")


def normalised(text: str | None) -> str:
    """Lower-case letters and single spaces; empty if there is no letter."""
    t = _NOT_LETTERS.sub(" ", text or "")
    if not t.isascii() and _NUMBERS.search(t):
        t = _NOT_LETTERS.sub(" ", _NUMBERS.sub(" ", t))
    return t.strip().lower()


def training_rows(docs: DataFrame, labelled: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: about ``rows`` per language, chosen by a hash of the key.

    Two scans; the first one reads key and label only and sets each language's hash threshold.
    """
    usable = docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = docs.filter(labelled & F.col(lang).isNotNull()).groupBy(lang).count().collect()
    test = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    for r in counts:
        test = test | ((F.col(lang) == r[lang]) & (draw < min(1.0, rows / r["count"])))
    if not counts:
        return []
    found = usable.filter(test).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"), F.col(key).alias("key"))
    return [(r["lang"], r["text"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["draw"], str(r["key"])))]


def dictionaries(samples: list[tuple[str, str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content per language: sample texts one after another, each giving an equal part at most.

    A text longer than its part gives a piece of it from its middle.
    """
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        if piece := normalised(text).encode():
            by.setdefault(lang, []).append(piece)
    out = {}
    for lang, texts in by.items():
        part = max(1, size // min(len(texts), 64))
        cut = [t if len(t) <= part else t[(len(t) - part) // 2 : (len(t) + part) // 2] for t in texts]
        joined = b" ".join(cut)[:size]
        out[lang] = joined if len(joined) >= 8 else joined.ljust(8)
    return out


class Classifier:
    """Holds one compressor per language; made once per task."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        data = normalised(text).encode()
        if not data or not self.langs:
            return UNKNOWN, 0.0
        sizes = []
        for f in self.compress:
            sizes.append(sum(len(f(data[i : i + PIECE])) - 9 for i in range(0, len(data), PIECE)))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        if len(order) == 1:
            return self.langs[0], 1.0
        gain = (sizes[order[1]] - best) / max(1, sizes[order[1]])
        return self.langs[order[0]], min(1.0, max(0.0, gain / SURE))


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); only the text is looked at.

    Null texts and texts without a letter get ``und`` and 0, as everything does when no
    language was learned. A narrow margin shows as a low score; whoever rejects compares it with MARGIN, as the pipeline
    does. Work is per row: no shuffle, ties by the languages' order; texts of any length are read whole, repeated rows are judged
    alike, an empty table gives no rows. Columns of ``docs`` named lang_pred or score are replaced, others stay.
    """
    columns = docs.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("lang_pred", "score").schema.fields)
    kept = [c for c in columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(kept.index(text))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )
        release_memory()

    return docs.select(*kept).mapInArrow(run, f"{shape}, lang_pred string, score double")


def held_out(key: str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
