"""The stages of the pipeline on odd and empty tables, and the whole run against its operators' brute force."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera import workspace
from tessera.llm import decontamination, mixing, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _key string"
ODD = [
    (1, "The cat sat on the mat and it was of the day. " * 30, "en", "a", 5, 1, "x"),
    (2, None, "en", None, None, None, None),
    (3, "", None, "b", 0, 1, None),
    (None, " \t\n", "en", "a", 3, 1, "y"),
    (4, "ß É ñ\n\nword", "de", "ä", 9, 1, "z"),
    (4, "ß É ñ\n\nword", "de", "ä", 9, 1, "z"),
    (None, None, None, None, None, None, None),
]


@pytest.mark.parametrize("at", range(5))
def test_stage_on_odd_and_empty_tables(spark, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    odd, empty = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    found = stage(spark, odd, sf)
    assert stage(spark, empty, sf).count() == 0
    if at < 4:
        assert found.columns == corpus_pipeline.COLUMNS, name
        assert {r.doc_id for r in found.collect()} <= {r[0] for r in ODD}
    else:
        assert found.count() == len(ODD)


def test_run(spark, sf):
    """Each stage's decisions, recomputed on what it was given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, steps = docs, []
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf).cache()
        steps.append(given)
    language, single, clean, mixed, ids = ([r.asDict() for r in s.collect()] for s in steps)
    text = {r.doc_id: r.text for r in docs.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(any(c.isalpha() for c in r["text"]) for r in language)
    prose = [d for d, t in text.items() if t and len(t.split()) >= 50 and lang[d]]
    assert sum(d in {r["doc_id"] for r in language} for d in prose) >= 0.95 * len(prose)
    assert len({r["text"] for r in single}) == len(single) and {r["text"] for r in single} <= {r["text"] for r in language}
    assert all(r["doc_id"] == min(x["doc_id"] for x in language if x["text"] == r["text"]) for r in single)
    bench = [(r.item_id, b" " + b" ".join(decontamination.words(r.text)) + b" ") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in single if any(w in b" " + b" ".join(decontamination.words(r["text"])) + b" " for _, w in bench)}
    kept = {r["doc_id"] for r in clean}
    assert not leaks & kept and len({r["doc_id"] for r in single} - kept - leaks) <= 0.02 * len(single) + 1
    size = {r["doc_id"]: len(r["text"].split()) for r in clean}
    source = {r["doc_id"]: r["source"] for r in clean}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    goal = mixing.targets(total.items())
    took = Counter()
    for r in mixed:
        took[source[r["doc_id"]]] += size[r["doc_id"]]
    for s, g in goal.items():
        assert abs(took[s] - g) <= max(n for d, n in size.items() if source[d] == s) + len(size)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    library = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    want = Counter()
    for r in mixed:
        found = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(found), zlib.crc32(np.array(found, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in ids) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, steps[-1].collect()))
    assert steps[-1].agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(r["n_tokens"] for r in ids)


def test_token_output_hands_few_rows_at_once(spark, tmp_path, monkeypatch):
    """Long texts reach a worker a few at a time, whatever the session's batch size, which is kept; files do not depend on the step."""
    got = spark.conf.get(tokens.AT_ONCE)
    docs = spark.range(3000).selectExpr("id doc_id", "concat_ws(' ', repeat('many long words ', 20), id) text").coalesce(1)
    whole, seen = tokens.gathered, tmp_path / "rows"

    def watched(batches, size):
        return whole((b for b in batches if [seen.open("a").write(f"{b.num_rows}\n")]), size)

    monkeypatch.setattr(tokens, "gathered", watched)
    for name, step in (("a", tokens.STEP), ("b", 1000)):
        tokens.write_tokens(docs, str(tmp_path / name), step=step)
    assert max(map(int, seen.read_text().split())) <= tokens.ROWS and spark.conf.get(tokens.AT_ONCE) == got
    a, b = (sorted(map(tuple, tokens.read_tokens(spark, str(tmp_path / n), digest=True).collect())) for n in "ab")
    assert a == b and len(a) == 3000


def test_stages_leave_no_spent_tables(spark, sf):
    """Of what a stage writes on the way, only what its result reads is there when it returns."""
    folder = Path(workspace.root(spark)) / "tessera"
    there = lambda: {p.name for p in folder.glob("*")}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage, left in ((corpus_pipeline.near_duplicates, ["kept"]), (corpus_pipeline.mixture, ["mix-cuts", "mix-ranks"])):
        before = there()
        found = stage(spark, docs, sf)
        assert sorted(n.rsplit("-", 1)[0] for n in there() - before) == left
        assert found.count()
