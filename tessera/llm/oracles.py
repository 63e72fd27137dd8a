"""DuckDB SQL of the queries that SQL can express.

The rules of op10 are spelled out here by hand and not made from the table in ``quality``, so
that one checks the other.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_STOPS = (
    "the of and to in is that for it was on are as with at be this by from or an "
    "de la le et les des en un une est que pour dans qui sur pas au du par "
    "der die und das den von zu mit ist im nicht ein eine auf dem sich auch für "
    "el los las del por con para no se una al lo como es su"
).split()
_LIST = ", ".join(f"'{w}'" for w in sorted({*_STOPS, *(w.capitalize() for w in _STOPS)}))

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, generate_series(1, len(ws) - 2) s(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, generate_series(0, 2) s(o) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: x IN ({_LIST}))) AS stops, len(ls) AS lines FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 50 AND 200000 AND word_chars / n_words::DOUBLE BETWEEN 2 AND 15 AND n_symbols / n_words::DOUBLE <= 0.1
  AND stops / n_words::DOUBLE >= 0.02 AND n_dup_lines / lines::DOUBLE <= 0.3 AND n_words / lines::DOUBLE >= 2 AS kept
FROM b
"""

ORACLES: dict[str, str] = {"op10_quality_rules": _QUALITY}
