"""Operators against brute force, round trips, held-out labels and odd inputs."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontamination, html_text, langid, mixing, passages, quality, queries, rangecoder, sharding, simhash, tokens, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "The cat sat on the mat and it was of the day. " * 30, "en", "a", 5),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (None, " \t\n", "en", "a", 3),
    (4, "ß É ñ\n\nword", "de", "ä", 9),
    (4, "ß É ñ\n\nword", "de", "ä", 9),
    (5, "x " * 40_000, "en", "a", 80_000),
    (6, "The cat sat on the mat and it was of the day. " * 30, "en", "c", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- 1: token ids


@pytest.mark.parametrize("n", [0, 1, 127, 129, 3000, 70_001])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "same"])
def test_codec_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"uniform": rng.integers(0, 50_257, n), "skewed": rng.zipf(1.2, n) % 50_257, "same": np.full(n, 7)}[kind]
    block = rangecoder.pack([5, None], [n, 0], ids, 50_257)
    keys, counts, back = rangecoder.unpack(block)
    assert keys == [5, None] and counts.tolist() == [n, 0] and (back == ids).all()


def test_codec_detects_damage():
    block = bytearray(rangecoder.pack([1], [50], np.arange(50), 100))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        rangecoder.unpack(bytes(block))


def test_codec_compresses_repetition():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 300), 400)
    assert len(rangecoder.pack([0], [len(ids)], ids, 50_257)) < len(ids) * 2 / 4


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_encoder_equals_library(library):
    """All strings of up to four pieces of twelve kinds, through the untouched library."""
    e = tokens.encoder(tokens.tokenizer_path())
    kinds = ["a", "é", " ", "\n", "\u00a0", "1", ",", "'s", "²", "日", "\x1c", "<|endoftext|>"]
    texts = ["".join(c) for n in range(5) for c in itertools.product(kinds, repeat=n)]
    texts += ["it's 's don't’s x1y2 ²³ é́a 12ab", "a \u00a0 \u00a0", "end ", "日本 語x ab1c d'll", "a\x01b c\x01 d", "<|end of|> <|endoftext", "ÀÉ1 ßx.y ǅa"]
    ids, n = e.batch(pa.array(texts))
    at = np.cumsum(n) - n
    for t, a, k, want in zip(texts, at, n, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a : a + k].tolist() == want.ids, repr(t)
        assert np.frombuffer(e.ids(t), "<u4").tolist() == want.ids, repr(t)
    assert [len(x) for x in e.batch(pa.array([], pa.string()))] == [0, 0] and e.batch(pa.array([None, ""]))[1].tolist() == [0, 0]


def test_token_query_against_library(spark, sf, library):
    """The registered query, recomputed with the library and zlib."""
    rows = sorted(docs_of(spark, sf).select("doc_id", "text").collect())
    at, want = 0, []
    for r, found in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        ids = [*found.ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op1_token_output(spark, sf).collect())) == want


def test_token_files_round_trip(spark, sf, odd, tmp_path):
    e = tokens.encoder(tokens.tokenizer_path())
    for i, df in enumerate((docs_of(spark, sf), odd)):
        where = str(tmp_path / str(i))
        tokens.write_tokens(df, where, block=20_000)
        got = tokens.read_tokens(spark, where).orderBy("start").collect()
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [g.doc_id for g in got] == [r.doc_id for r in rows]
        at = 0
        for g in got:
            assert g.start == at and g.n_tokens == len(g.ids)
            at += g.n_tokens
        want = Counter((r.doc_id, zlib.crc32(e.ids(r.text or "") + np.array([2], "<u4").tobytes())) for r in rows)
        digest = tokens.read_tokens(spark, where, digest=True)
        assert Counter((g.doc_id, g.ids_crc32) for g in digest.collect()) == want


def test_token_files_empty(spark, empty, tmp_path):
    tokens.write_tokens(empty, str(tmp_path / "e"))
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


# -- 2: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class="ad">Buy, now, or, never.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph, with<br>a break, and &eacute;.<p>Second paragraph, <b>bold</b> text here.
<form><p>Sign up, please, now.</p></form><ul><li>one, item</li><li>two</li></ul><aside>Aside text, of no use.</aside></article>
<section id="comments"><article class="comment"><p>Nice, really, nice, post, I, think, so.</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_article_text():
    assert html_text.extract(PAGE) == "Title & more\n\nFirst paragraph, with a break, and é.\n\nSecond paragraph, bold text here.\n\none, item\n\ntwo"


def test_page_without_article():
    page = '<body><div id=menu><a href=1>a</a></div><div class=wrap><div class="story-body"><p>' + "Some words, and more of them. " * 5 + "</p><p>Tail, short.</p></div></div><div class=sidebar><p>Other words, not these.</p></div>"
    assert html_text.extract(page) == ("Some words, and more of them. " * 5).strip() + "\n\nTail, short."


def test_names_of_parts():
    page = '<body class="page has-sidebar"><div class="sidebarLeft"><p>no, no, no</p></div><div class="content"><p>Yes, this is the text we want.</p></div></body>'
    assert html_text.extract(page) == "Yes, this is the text we want."
    assert html_text.extract('<div class="sidebar"><p>Only text, here.</p></div>') == "Only text, here."


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep words, here</p>"
    pages = [None, "", "plain text only", "<p>cut <b", "<p>a &am", "</p></div>", deep, "<nav><a>x</a>", "<script>never closed"]
    df = spark.createDataFrame([(i, p, "n", 3) for i, p in enumerate(pages)], "page_id int, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert [got[i].text for i in range(9)] == ["", "", "plain text only", "cut", "a &am", "", "deep words, here", "", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.limit(0)).count() == 0


def test_pages_of_the_data(spark, sf):
    for r in html_text.main_text(spark.read.parquet(f"{sf}/pages.parquet")).limit(30).collect():
        assert r.text and "track(" not in r.text and "©" not in r.text and "<p>" not in r.text


# -- 3: mixing


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert got["a"] == 20 and math.isclose(sum(got.values()), 240) and got["b"] <= 200 and got[None] <= 100
    assert mixing.targets([]) == {}
    assert mixing.targets([("z", 0)]) == {"z": 0}


def test_mix(spark, sf, odd, empty):
    df = docs_of(spark, sf)
    got = mixing.mix(df, mixing.word_count(F.col("text"))).toPandas()
    again = mixing.mix(df.repartition(5), mixing.word_count(F.col("text"))).toPandas()
    assert sorted(got[["doc_id", "taken"]].values.tolist()) == sorted(again[["doc_id", "taken"]].values.tolist())
    assert (got.taken <= 2 * got["size"]).all() and len(got) == df.count()
    source = {r.doc_id: r.source for r in df.collect()}
    got["source"] = got.doc_id.map(source)
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
        assert (g.source_size == g["size"].sum()).all()
    assert mixing.mix(odd, mixing.word_count(F.col("text"))).count() == len(ODD)
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0
    assert mixing.mixed(odd, mixing.word_count(F.col("text"))).columns == odd.columns


def test_mix_probabilities(spark):
    """Over many sources with the same documents, each is taken as often as its size asks for: whole copies and unequal chances."""
    sizes = [5, 20, 20, 45, 70, 90, 100, 150, 200, 300]
    n = 900
    rows = [(100 * s + k, "w " * w, f"s{s:04}") for s in range(n) for k, w in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for share in (0.5, 1.4):
        got = mixing.mix(df, mixing.word_count(F.col("text")), share=share, weights=(1.0,)).toPandas()
        assert (got.groupby(got.doc_id // 100).taken.sum() - share * 1000).abs().max() <= 150
        lo, hi = 0.0, 100.0
        for _ in range(60):  # the rate, by bisection
            rate = (lo + hi) / 2
            lo, hi = (rate, hi) if sum(min(2, rate * min(w, 100) / 100) * w for w in sizes) < share * 1000 else (lo, rate)
        mean = got.groupby(got.doc_id % 100).copies.mean()
        for k, w in enumerate(sizes):
            want = min(2, rate * min(w, 100) / 100)
            assert mean[k] == pytest.approx(want, abs=0.1) and got[got.doc_id % 100 == k].copies.between(math.floor(want), math.floor(want) + 1).all(), (share, w)


def test_mix_keeps_columns(spark, odd, empty):
    clash = odd.selectExpr("*", "7 copies", "8 size", "9 target", "1 source_size", "2 taken", "3 _n", "4 _s", "5 carried", "6 n")
    out = mixing.mixed(clash, mixing.word_count(F.col("text")))
    assert out.columns == clash.columns and {(r.copies, r["size"], r._n, r.carried) for r in out.collect()} == {(7, 8, 3, 5)}
    assert mixing.mixed(empty, mixing.word_count(F.col("text"))).count() == 0


# -- 5: URLs


def brute_rule(host, path):
    table = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    fit = [r for r in table if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None), table


def brute_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_url_rules(spark):
    found = [None, "", "nothing", "http://", "http://A.Example.ORG/en/1x?q#f", "x://example.org", "http://example.org/es/", "http://myexample.org/es/", "ftp://a.com/fr/y", "https://com/de/", "h://a.com?b=/fr/", "http://É.org/ü", "a\nb://c.org/x\ny", "http://a.b/c://d.org/"]
    df = spark.createDataFrame([(i, u, "other") for i, u in enumerate(found)], "page_id int, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, []).collect()}
    for i, u in enumerate(found):
        host, path = brute_url(u)
        rule, table = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, table.get(rule, "allow")), u


def test_url_mining(spark):
    rows = [(f"https://{'bad' if i % 3 == 0 else 'good'}.example.net/{'x' if i % 2 else 'y'}/{i}", i % 3 == 0 and i % 2 == 1) for i in range(300)]
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {m.tokens: round(m.confidence, 6) for m in mined} == {("h:bad",): 0.5, ("p:x",): round(1 / 3, 6)}  # against 1 / 6 of all
    got = urls.judge(spark.createDataFrame([(u,) for u, _ in rows] + [(None,)], "url string"), mined).collect()
    assert [r.verdict == "block" for r in got] == ["bad" in u or "/x/" in u for u, _ in rows] + [False]
    pair = [urls.Mined(("h:bad", "p:x"), 0.1, 1.0)]
    assert [r.verdict == "block" for r in urls.judge(spark.createDataFrame([(u,) for u, _ in rows], "url string"), pair).collect()] == [b for _, b in rows]
    assert urls.mine(spark.createDataFrame([], "url string, bad boolean")) == []
    clash = spark.createDataFrame([("https://bad.example.net/x", 1, 2)], "url string, _tokens int, verdict int")
    assert [(r.verdict, r._tokens) for r in urls.judge(clash, mined).collect()] == [("block", 1)]


def brute_tokens(url):
    import re

    host, path = brute_url(url)
    query = url.split("?", 1)[1].split("#")[0].lower() if "?" in (url or "") else ""
    parts = [("h:", host.split(".")), ("p:", re.split(r"[^\w]+|_", brute_url(url.lower())[1] if url else "")), ("q:", [x.split("=")[0] for x in query.split("&")])]
    return {k + x for k, xs in parts for x in xs if x and not re.fullmatch(r"[0-9]+", x)}


def brute_mined(rows):
    """Rules of one and two tokens by counting."""
    n, share = len(rows), sum(b for _, b in rows) / len(rows)
    counts, hits = Counter(), Counter()
    for u, b in rows:
        for size in (1, 2):
            for t in itertools.combinations(sorted(brute_tokens(u)), size):
                counts[t] += 1
                hits[t] += b
    strong = lambda c, k: k >= urls.MIN_SUPPORT * n and k / c >= share * urls.MIN_LIFT and k - share * c - 0.5 >= urls.MIN_SIGMA * math.sqrt(c * share * (1 - share))
    good = {t for t in counts if strong(counts[t], hits[t])}
    return {t for t in good if len(t) == 1 or not any((x,) in good for x in t)}


def test_mined_rules_against_brute_force(spark):
    """Labels of the sample URLs with a planted rule, and as they are: rules and verdicts, recomputed."""
    d = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    rows = [(r.url, r.bad) for r in urls.labelled_pages(pages, spark.read.parquet(f"{d}/labels.parquet")).collect()]
    planted = [(u, b or "spam-farm" in u or ("q:ref" in brute_tokens(u) and "h:net" in brute_tokens(u))) for u, b in rows]
    mined = urls.mine(spark.createDataFrame(planted, "url string, bad boolean"))
    assert {("h:spam-farm",), ("h:net", "q:ref")} <= {m.tokens for m in mined}
    assert {m.tokens for m in mined if len(m.tokens) <= 2} == brute_mined(planted)
    assert {m.tokens for m in urls.mine(spark.createDataFrame(rows, "url string, bad boolean")) if len(m.tokens) <= 2} == brute_mined(rows)
    for rules, found in ((mined, urls.judge(pages, mined)), ([], queries.op5_url_filter(spark, d)) if not brute_mined(rows) else (mined, urls.judge(pages, mined))):
        got = {r.page_id: r.verdict for r in found.collect()}
        for r in pages.collect():
            rule, table = brute_rule(*brute_url(r.url))
            method = "block" if any(set(m.tokens) <= brute_tokens(r.url) for m in rules) else "allow"
            assert got[r.page_id] == table.get(rule, method), r.url


# -- 6: benchmark


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 70)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontamination.common(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_contamination(spark, sf, odd, empty):
    docs, items = docs_of(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = [(r.item_id, decontamination.words(r.text)) for r in items.collect()]
    planted = [(10_000 + k, "filler words go here and there " * 9 + b" ".join(w).decode().upper() + ". and on it goes " * 12, "en", "s", 1) for k, (_, w) in enumerate(bench[:20])]
    changed = []
    for k, (_, w) in enumerate(b for b in bench if len(b[1]) > 30):
        v = list(w)
        for at in range(4, len(v) - 8, 9):
            v[at] = b"swapped"
        changed.append((20_000 + k, "some other text before it " * 8 + b" ".join(v).decode() + " and after it " * 8, "en", "s", 1))
    both = docs.unionByName(spark.createDataFrame(planted + changed, SCHEMA))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(both, items).collect()}
    want = set()
    for r in both.collect():
        text = b" " + b" ".join(decontamination.words(r.text)) + b" "
        want |= {(r.doc_id, i) for i, w in bench if len(w) >= 5 and b" " + b" ".join(w) + b" " in text}
    assert want <= got and len(want) >= 20
    assert {d for d, _, *_ in changed} <= {d for d, _ in got}
    assert len({d for d, _ in got if d < 10_000} - {d for d, _ in want}) == 0  # clean documents are left alone
    left = decontamination.decontaminated(both, items)
    assert left.count() == both.count() - len({d for d, _ in got})
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0
    assert decontamination.decontaminated(odd, items).count() == len(ODD)


def test_paraphrases_at_all_offsets(spark, sf):
    """Items with the answer and 0.56 to 0.7 of the words kept, at every place of a passage."""
    bench = decontamination.load_benchmark(spark.read.parquet(f"{sf}/benchmark.parquet"))
    encoded = decontamination.encode(docs_of(spark, sf), bench)
    model = decontamination.fit(encoded, bench)
    hosts = [h for h in (np.frombuffer(r.ids, "<u4") for r in encoded.select("ids").collect()) if 150 < len(h) < 1000]
    rng = np.random.default_rng(7)
    n = found = 0
    for k, (item, part) in enumerate(model.parts):
        for at in range(64, 64 + decontamination.HOP):
            kept, host = part.copy(), hosts[int(rng.integers(len(hosts)))]
            free = rng.permutation(np.flatnonzero(~np.isin(part, model.answers[k])))
            kept[free[: int(len(part) * (1 - rng.choice([0.56, 0.6, 0.65, 0.7])))]] = 0
            n += 1
            found += item in decontamination.matches([np.r_[host[:at], kept, host[at:]].astype(np.uint32)], model)[0]
    assert found >= 0.99 * n


def test_matches_against_all_subsequences(spark, sf):
    """The verdicts of the search against common subsequences of every item with every region of every document."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = decontamination.load_benchmark(items)
    encoded = decontamination.encode(docs_of(spark, sf), bench)
    model = decontamination.fit(encoded, bench)
    rows = [(r.key, np.frombuffer(r.ids, "<u4").astype(np.int64)) for r in encoded.collect()]
    got = decontamination.matches([ids.astype(np.uint32) for _, ids in rows], model)
    want = []
    for _, ids in rows:
        found = set()
        for k, (item, part) in enumerate(model.parts):
            m = len(part)
            if item in found or np.isin(part, ids).sum() < decontamination.PARAPHRASE * m:
                continue
            for at in range(0, len(ids), decontamination.HOP):
                region = ids[max(0, at - m) : at + decontamination.PASSAGE + m]
                answer = np.isin(model.answers[k], region).sum() >= decontamination.ANSWER * len(model.answers[k])
                if np.isin(part, region).sum() >= (decontamination.PARAPHRASE if answer else decontamination.NEAR) * m:
                    share = decontamination.common(part, region) / m
                    if share >= decontamination.NEAR or (answer and share >= decontamination.PARAPHRASE):
                        found.add(item)
                        break
        want.append(found)
    pairs = {(i, x) for i, f in enumerate(want) for x in f}
    mine = {(i, x) for i, f in enumerate(got) for x in f}
    assert mine <= pairs and len(mine) >= 0.95 * len(pairs) and len(pairs) >= 3


def test_short_items_and_many_documents_at_once(spark):
    docs = [(1, "one two three"), (2, "x One, two... y"), (3, "two one"), (4, None), (5, "one"), (6, "three words here " * 500), (7, "")]
    items = [(1, "One two"), (2, "three words here"), (3, ""), (4, None), (None, "one"), (5, "one two three four five six seven eight")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 2)}
    clash = df.selectExpr("*", "1 key", "'x' ids", "2 _none")
    left = decontamination.decontaminated(clash, bench)
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]


# -- 7: SimHash


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))
    up = ids[:]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    return [find(i) for i in ids]


def test_anchor_covering():
    """Any two fingerprints within four bits meet at a home of one of them."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    at = {}
    for name, v in (("x", x), ("y", y)):
        anchor, row, home = simhash.anchors(v)
        for a, r, h in zip(anchor.tolist(), row.tolist(), home.tolist()):
            at.setdefault((name, r), {})[a] = h
    for i in range(len(x)):
        assert any(h or at["y", i].get(a, False) for a, h in at["x", i].items() if a in at["y", i])
        assert sum(at["x", i].values()) == 3


def check_simhash(spark, df, monkeypatch=None):
    got = simhash.near_duplicates(df).collect()
    rows = [(r.doc_id, brute_simhash(r.text)) for r in df.collect()]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for i, p in rows)
    root = brute_components([p for _, p in rows])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, least.get(r)) for (i, _), r in zip(rows, root))
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_simhash(spark, sf, odd, empty):
    check_simhash(spark, docs_of(spark, sf))
    check_simhash(spark, odd)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd,step", [(1 << 14, 1 << 21), (4, 8), (3, 1)])
def test_simhash_crowds(spark, monkeypatch, crowd, step):
    """Chunks and blocks of any size give the same components."""
    rng = np.random.default_rng(crowd)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(40)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "STEP", step)
    member = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    root = brute_components(prints)
    mine = [member.get(x, x) for x in signed]
    assert len(set(zip(mine, root))) == len(set(mine)) == len(set(root))


def test_components_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (5000, 5000)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_deduplicated(spark, odd, empty):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5)]
    one, two = "some words of the first text " * 8, "quite another text with its own words " * 8
    df = spark.createDataFrame([(1, one, 77), (4, one, 88), (4, two, 99), (4, two, 99)], "doc_id bigint, text string, _row bigint")
    assert sorted(map(tuple, simhash.deduplicated(df).collect())) == [(1, one, 77), (4, two, 99)]
    assert simhash.deduplicated(empty).count() == 0


# -- 8: shards


def test_shards(spark, sf, odd, empty):
    df = docs_of(spark, sf)
    got = sharding.shard(df).toPandas()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(got) == len(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    order = got.sort_values(["shard", "slot"])
    goal, at, ends = got["size"].sum() / 16, order["size"].cumsum().to_numpy(), order.groupby("shard")["size"].sum().cumsum().to_numpy()
    for k, e in enumerate(ends[:-1], 1):  # no cut is farther from its goal than the row under it or the slack
        row = order["size"].to_numpy()[np.searchsorted(at, k * goal, side="right")]
        assert abs(e - k * goal) <= max(row / 2, sharding.SLACK * goal) + 1
    groups = got.groupby("text_crc32").agg(n=("size", "sum"), s=("shard", "nunique"))
    assert (groups[groups.n <= 2 * sharding.SLACK * goal].s == 1).all()
    assert len(sums) == 16 and set(got.law) == {"bytes"}
    other = sharding.shard(df.repartition(3), partitions=3).toPandas()
    assert sorted(zip(got.doc_id, got.shard)) == sorted(zip(other.doc_id, other.shard))
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


def test_equal_texts_share_a_shard(spark):
    df = spark.createDataFrame([(i, f"text {i % 300} " + "pad " * 20) for i in range(3000)], "doc_id bigint, text string")
    got = sharding.shard(df, slack=0.2).toPandas()
    assert (got.assign(g=got.doc_id % 300).groupby("g")["shard"].nunique() == 1).all()


def test_one_text_is_split(spark):
    got = sharding.shard(spark.createDataFrame([(i, "same") for i in range(1600)], "doc_id bigint, text string")).toPandas()
    assert (got.groupby("shard").size().between(90, 110)).all() and got["shard"].nunique() == 16


# -- 9: languages


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    content = langid.dictionaries(langid.training_rows(df, ~langid.held_out()))
    got = langid.identify(df.select("doc_id", "lang", "text", langid.held_out().alias("held_out")), content).filter("held_out").select("lang", "lang_pred").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert abs(len(got) / df.count() - 1 / 3) < 0.05


def test_language_odd(spark, odd, empty):
    content = langid.dictionaries(langid.training_rows(odd, F.lit(True)))
    got = langid.identify(odd.withColumn("score", F.lit("x")), content).collect()
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has and 0 <= r.score <= 1
    model = langid.Classifier(content)
    assert {model.predict(t) for t in ("²", "½ Ⅷ", "①", "12 _", "\u0301", None)} == {("und", 0.0)} and model.predict("Ⅷ b")[0] != "und"
    assert langid.identify(empty, content).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.training_rows(empty, F.lit(True)) == []
    assert zlib.crc32(b"5") % 3 == 1 or not odd.filter("doc_id = 5").select(langid.held_out().alias("h")).first().h


# -- 10: quality


def brute_quality(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(wins)
    cover = {i + k for i, x in enumerate(wins) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_quality(spark, sf, odd, empty):
    for df in (docs_of(spark, sf), odd.withColumn("n_words", F.lit("x"))):
        got = quality.judge(df).collect()
        want = Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(empty).count() == 0


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.1"
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.1


# -- registration


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == sorted(set(int(n[2:].split("_")[0]) for n in queries.QUERIES))


# -- 4: repeated passages


def test_compact_windows():
    """Every stretch of the length lies in the reach of exactly the nodes that are its minima."""
    rng = np.random.default_rng(2)
    for h in (rng.integers(1, 50, 300).astype(np.uint64), rng.integers(1, 1 << 60, 300).astype(np.uint64), np.full(200, 9, np.uint64), np.arange(1, 21, dtype=np.uint64)):  # zeros part texts
        c, left, right = passages.windows(h, 20)
        want = {(a, a + int(k)) for a in range(len(h) - 19) for k in np.flatnonzero(h[a : a + 20] == h[a : a + 20].min())}
        got = {(a, int(x)) for x, y, z in zip(c, left, right) for a in range(x - y, x + z - 19)}
        assert got == want
    assert [len(x) for x in passages.windows(np.arange(1, 20, dtype=np.uint64), 20)] == [0, 0, 0]


def test_stretch_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    h[200:260] = h[20:80]
    s = passages._Stretches(h)
    at = np.arange(300)
    key = s.of(at, at + 46)
    assert sorted((i, j) for i in range(300) for j in range(i) if key[i] == key[j]) == [(200 + k, 20 + k) for k in range(15)]


def brute_passages(rows, n=50):
    """Words of each document that lie in n equal words of an earlier one, and its pairs with the first that has them."""
    owner, words, cover, pairs = {}, {}, {}, set()
    for d, t in sorted(rows):
        words[d] = (t or "").encode().lower().split()
        cover[d] = np.zeros(len(words[d]), bool)
        for i in range(len(words[d]) - n + 1):
            first = owner.setdefault(b" ".join(words[d][i : i + n]), d)
            if first != d:
                cover[d][i : i + n] = True
                pairs.add((d, first))
    return pairs, cover, words


def check_passages(spark, df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    pairs, cover, words = brute_passages(rows)
    got = passages.repeated_passages(df).collect()
    links = [r for r in got if r.doc_id != r.other_id]
    up = {}

    def root(d):
        while d in up:
            d = up[d]
        return d

    for r in links:  # a document may reach the first one over a copy of its own surroundings
        if root(r.doc_id) != root(r.other_id):
            up[root(r.doc_id)] = root(r.other_id)
    assert all(root(a) == root(b) for a, b in pairs)
    found = {d: np.zeros(len(w), bool) for d, w in words.items()}
    for r in links:
        found[r.doc_id][r.start : r.end] = True
        assert r.end - r.start >= (50 if r.similarity == 1 else 49) and r.end <= len(words[r.doc_id])
        if r.similarity == 1:
            assert words[r.doc_id][r.start : r.end] == words[r.other_id][r.other_start : r.other_start + r.end - r.start]
    assert all((found[d] >= cover[d]).all() for d in cover)
    owners = {r.class_id: r for r in got if r.doc_id == r.other_id}
    for r in links:  # every class has a row of its first document that holds what its members share
        o = owners[r.class_id]
        assert o.doc_id == r.other_id and o.start <= r.other_start < o.end
    return got


def test_passages_against_brute_force(spark):
    """All exact passages of the sample data: every pair with the first document, every word."""
    assert len(check_passages(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) > 100


def test_passages_partial_owner(spark, monkeypatch):
    """Earlier documents that hold 40 to 49 words of a passage do not hide the later copies, in frequent groups either."""
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for k in range(10):
        a = words(60)
        rows += [(10 * k, " ".join(words(30) + a[: 40 + k] + words(30)))] + [(10 * k + i, " ".join(words(30) + a + words(30))) for i in (1, 2, 3)]
    common = words(12)
    rows += [(1000 + k, " ".join(words(60) + common + words(60))) for k in range(40)]
    check_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    hot = passages.frequent(spark.createDataFrame(rows, "doc bigint, text string").selectExpr("doc", "cast(text as binary) text"))
    assert len(hot)
    monkeypatch.setattr(passages, "FREQUENT", 2)
    check_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_near_copies_are_found(spark):
    """Passages of 50 to 150 words with 2 % of their words changed, among other text."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, want = [], {}
    for n in (50, 60, 80, 150):
        for _ in range(60):
            a = words(n)
            b = list(a)
            for at in rng.choice(np.arange(5, n - 5), max(1, round(n * 0.02)), replace=False):
                b[at] = "changed"
            d = len(rows)
            rows += [(d, " ".join(words(80) + a + words(80))), (d + 1, " ".join(words(100) + b + words(50)))]
            want[d + 1, d] = n
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {p for p in got if p[0] != p[1]} <= set(want)
    for n in (50, 60, 80, 150):
        assert sum(p in got for p, m in want.items() if m == n) >= 54, n


def test_whole_near_copies(spark):
    """Every pair at the threshold has a row: lone pairs, groups of copies that differ two by two, three runs of 13 and 14, and a common line beside them."""
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, rows, want = words(22), [], set()

    def add(passage):
        rows.append((len(rows), " ".join(words(40) + line + words(30) + passage + words(60))))
        return len(rows) - 1

    for _ in range(60):  # lone pairs: 46 places, five of them unequal
        a = words(50)
        b = list(a)
        b[int(rng.integers(10, 40))] = "changed"
        want.add((add(b), add(a)))
    for _ in range(10):  # six copies, each with another word changed: two of them differ in two words
        a = words(60)
        mine = [add([f"other{at}" if k == at else w for k, w in enumerate(a)]) for at in (10, 17, 26, 34, 42, 50)]
        want |= {(x, y) for x in mine for y in mine if x < y}
    for _ in range(5):
        a = words(54)  # 50 places, 40 of them equal, in runs of 13, 14 and 13
        b = list(a)
        b[17] = b[36] = "changed"
        want.add((add(a), add(b)))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), whole=True).collect()
    found = {(r.other_id, r.doc_id) for r in got if r.doc_id != r.other_id}
    assert found == {(min(p), max(p)) for p in want}
    assert all(r.similarity >= passages.SIMILAR for r in got)


def test_common_lines_make_no_candidates(spark):
    """Owners of a common line or of a repeated word meet only if what is around has enough shingles in common; those of one exact passage are of one class."""
    rng = np.random.default_rng(23)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, passage, rows, want = words(20), words(70), [], set()

    def add(*parts):
        rows.append((len(rows), " ".join(sum(parts, []))))
        return len(rows) - 1

    for _ in range(60):
        add(words(50), line, words(50))
    for _ in range(30):  # the common line and a second one of 30 words whose middle differs
        a, b = words(15), words(15)
        want.add((add(words(30), line, a, ["one"], b, words(40)), add(words(30), line, a, ["other"], b, words(40))))
    for _ in range(25):
        add(words(30), ["the"] * 22, words(30))
    same = {add(words(40), passage, words(40)) for _ in range(40)}
    df = spark.createDataFrame(rows, "doc bigint, text string").selectExpr("doc", "cast(text as binary) text")
    assert {(r.other, r.doc) for r in passages._seeded(df).collect()} - {(x, y) for x in same for y in same} == want
    got = passages.repeated_passages(df.withColumnRenamed("doc", "doc_id"), whole=True).collect()
    links = {(r.other_id, r.doc_id) for r in got if r.doc_id != r.other_id}
    assert want <= links and all({x, y} <= same for x, y in links - want)
    (one,) = {r.class_id for r in got if r.doc_id == r.other_id == min(same)}
    assert {r.doc_id for r in got if r.class_id == one} == same


def test_values_in_common(monkeypatch):
    """Pairs of rows with EQUAL values in common, counted as often as both have them, in one step or many."""
    rng = np.random.default_rng(24)
    size = rng.integers(20, 120, 90)
    values = rng.integers(0, 90, size.sum()) ** 2 // 60
    parts, group, label = np.split(values, np.cumsum(size)[:-1]), np.arange(90) // 30, rng.integers(0, 12, 90)
    common = lambda i, j: sum(min((parts[i] == v).sum(), (parts[j] == v).sum()) for v in np.unique(parts[i]))
    enough = {(i, j) for j in range(90) for i in range(j) if common(i, j) >= passages.EQUAL}
    pairs = lambda code: {(c >> 32, c & 0xFFFFFFFF) for c in code.tolist()}
    assert 100 < len(enough) < 3900
    for step in (passages.CODES, 500):
        monkeypatch.setattr(passages, "CODES", step)
        assert pairs(passages.enough_in_common(group, size, values)[0]) == {(i, j) for i, j in enough if group[i] == group[j]}
        assert pairs(passages.enough_in_group(size, values, label)) == {(i, j) for i, j in enough if label[i] != label[j]}


def test_large_groups_are_not_held(monkeypatch):
    """A value that very many nodes have takes memory for a few blocks of them, and still every two with enough around them meet."""
    for name, x in {"BLOCK": 256, "HELD": 1000, "VALUES": 1 << 16}.items():
        monkeypatch.setattr(passages, name, x, raising=False)
    rng = np.random.default_rng(25)
    n, around = 8000, passages.AROUND
    near = rng.permutation(n)[:600].reshape(-1, 2)  # two with 40 shingles in common, all others with the line's 20
    line, more = rng.integers(0, 1 << 32, 20, np.uint32), rng.integers(0, 1 << 32, (300, 20), np.uint32)
    pair = np.full(n, -1)
    pair[near] = np.arange(300)[:, None]

    def contexts(k, docs, few=False):
        shingles = rng.integers(0, 1 << 32, (len(docs), 2 * around + 1), np.uint32)
        shingles[:, around : around + 20] = line
        shingles[pair[docs] >= 0, 10:30] = more[pair[docs][pair[docs] >= 0]]
        data = [(x >> 16).astype(np.uint16).tobytes() if few else x.tobytes() for x in shingles]
        same = lambda x: [x] * len(docs)
        cols = (same(k), docs.tolist(), same(500), same(0), same(5), same(14), same(few), same(around), data)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.int32(), pa.binary()))], names=["k", "doc", "c", "reach", "left", "right", "few", "behind", "data"])

    def batches():
        first = pa.Table.from_batches([contexts(-5, near[0], True), contexts(3, np.arange(100))])
        last = pa.Table.from_batches([contexts(3, np.arange(7900, n)), contexts(8, near[1], True), contexts(9, np.r_[near[2], np.arange(20)])])
        yield from first.combine_chunks().to_batches()
        for lo in range(100, 7900, 300):
            yield contexts(3, np.arange(lo, lo + 300))
        yield from last.combine_chunks().to_batches()

    tracemalloc.start()
    got = [r for b in passages._meet(batches()) for r in zip(*(b.column(x).to_pylist() for x in ("doc", "other")))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = {(max(p), min(p)) for p in near.tolist()}
    assert set(got) == pairs and len(got) >= len(pairs) + 3
    assert peak < 30e6, peak


def test_query_links_all_near_copies(spark, tmp_path):
    """The query links every two of six copies that differ from each other in two words."""
    rng = np.random.default_rng(22)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, want = [], set()
    for _ in range(10):
        a = words(60)
        mine = range(len(rows), len(rows) + 6)
        rows += [(d, " ".join(words(40) + [f"other{at}" if k == at else w for k, w in enumerate(a)] + words(60))) for d, at in zip(mine, (10, 17, 26, 34, 42, 50))]
        want |= {(x, y) for x in mine for y in mine if x < y}
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_substring_dedup(spark, str(tmp_path)).filter("doc_id <> other_id").collect()
    assert {(r.other_id, r.doc_id) for r in got} == want


def test_repeated_passages(spark, odd, empty):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, other = words(80), words(40)
    near = passage.split()
    near[30] = "changed"
    rows = [(1, words(100) + " " + passage + " " + words(30)), (2, passage.upper().replace("W", "w") + " " + words(200)), (3, words(60) + " " + " ".join(near)), (4, words(300)), (5, words(50) + " " + other), (6, other + " " + words(70)), (None, passage)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    links = {(r.doc_id, r.other_id) for r in got}
    assert {(1, 1), (2, 1), (3, 1)} <= links <= {(a, b) for a in (1, 2, 3) for b in (1, 2)}
    two = next(r for r in got if (r.doc_id, r.other_id) == (2, 1))
    assert (two.start, two.end, two.other_start) == (0, 80, 100) and two.similarity == 1
    clash = odd.selectExpr("*", "'x' class_id", "1 start", "'y' key", "2 k", "0 place")
    assert {(r.doc_id, r.other_id, r.start, r.end) for r in passages.repeated_passages(clash).collect()} == {(6, 1, 0, 360), (1, 1, 0, 360)}
    assert passages.repeated_passages(empty).count() == 0


def test_one_changed_word_at_every_place():
    for n in (50, 55, 60, 70, 80):
        for at in range(n):
            same = np.zeros(n - 4 + 40, bool)
            same[20 : n + 16] = True
            same[20 + max(0, at - 4) : 20 + min(n - 4, at + 1)] = False
            (found,) = passages.stretches(same)
            assert found[1] - found[0] >= passages.LENGTH and found[2] >= passages.SIMILAR, (n, at)
    assert passages.stretches(np.arange(300) % 10 < 7) == []


def test_two_passages_at_one_shift(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, n = [], 12
    for k in range(n):
        head, foot = words(60), words(60)
        rows += [(2 * k + i, " ".join(head + words(1500) + foot)) for i in (0, 1)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("doc_id <> other_id").collect()
    assert sorted((r.doc_id, r.other_id, r.start, r.end) for r in got) == sorted((2 * k + 1, 2 * k, s, s + 60) for k in range(n) for s in (0, 1560))


def test_inserted_and_deleted_words(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    for n in (60, 75, 90):
        for at in range(1, n, 4):
            a, extra = words(n), words(1)
            x, y = (passages.shingles(" ".join(w).encode()) for w in (words(30) + a + words(30), words(30) + a[:at] + extra + a[at:] + words(30)))
            for p, q in ((x, y), (y, x)):
                (found,) = passages.aligned(p, q, -passages.BAND, passages.BAND)
                assert found[-1] >= passages.SIMILAR and min(found[1] - found[0], found[3] - found[2]) >= passages.LENGTH - 1
    rows = []
    for k in range(8):
        a = words(60)
        rows += [(2 * k, " ".join(words(200) + a + words(200))), (2 * k + 1, " ".join(words(150) + a[:30] + words(1) + a[30:] + words(150)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("doc_id <> other_id and similarity < 1").collect()
    assert sorted((r.doc_id, r.other_id, r.start, r.end, r.other_start) for r in got) == [(2 * k + 1, 2 * k, 150, 211, 200) for k in range(8)]
