"""Operators against brute force and published small results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import geo, tokens, vectors
from tessera.operators import audio, bow, evaluate, media, recommend, spatial, text, vector
from tessera.sources import corpora
from tessera.sources import media as media_files


def test_distances(spark):
    pts = corpora.places(spark, 300).withColumn("key", F.col("id"))
    p = (-12.0464, -77.0428)
    rows = pts.collect()

    def hav(r):
        a, b = map(math.radians, (p[0], r.lat))
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(r.lon - p[1]) / 2) ** 2
        return 2 * geo.RADIUS_M * math.asin(math.sqrt(h))

    found = [r.id for r in spatial.in_circle(pts, p, 5000).collect()]
    assert found == [r.id for r in sorted(rows, key=hav) if hav(r) <= 5000]
    assert [r.id for r in spatial.nearest(pts, p, 10, "id").collect()] == [r.id for r in sorted(rows, key=lambda r: (hav(r), r.id))[:10]]
    batch = spatial.nearest_batch(pts, [(1, *p), (2, rows[0].lat, rows[0].lon)], 3, "id").collect()
    assert [r.key for r in sorted(batch, key=lambda r: r["rank"]) if r.query == 1] == [r.id for r in sorted(rows, key=hav)[:3]]


def test_circles_over_pole_and_date_line(spark):
    df = spark.createDataFrame([(1, 89.9, 10.0), (2, 89.9, -170.0), (3, 0.0, 179.95), (4, 0.0, -179.95)], "id int, lat double, lon double")
    assert {r.id for r in spatial.in_circle(df, (89.95, 0.0), 30_000).collect()} == {1, 2}
    assert {r.id for r in spatial.in_circle(df, (0.0, 179.99), 20_000).collect()} == {3, 4}


def test_polygon(spark):
    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (2, 2)]
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 1.0), (3, 3.0, 3.5), (4, 0.0, 2.0), (5, 2.0, 2.0), (6, 5.0, 5.0), (7, 0.0, 0.0), (8, 3.0, 0.5)], "id int, lat double, lon double")
    small = {r.id for r in spatial.in_polygon(df, ring).collect()}
    many = [(2 + 2 * math.cos(t / 100 * 2 * math.pi), 2 + 2 * math.sin(t / 100 * 2 * math.pi)) for t in range(100)]
    assert small == {1, 3, 4, 5, 7}
    assert {r.id for r in spatial.in_polygon(df, many).collect()} == {1, 2, 3, 4, 5, 8}
    assert geo.area([(0, 0), (0, 2), (2, 2), (2, 0)]) == 4 and geo.perimeter([(0, 0), (0, 1), (1, 1)]) > 300_000
    with pytest.raises(EngineError):
        geo.check_point(float("nan"), 0)


def test_tokens(spark):
    assert tokens.tokenize("Ａ_b Straße ÁÉ 12x") == ["a", "b", "strasse", "áé", "12x"]
    assert tokens.tokenize("Él corrió ya", ["él"], True, 3, lambda s: s[:4]) == ["corr"]
    df = spark.createDataFrame([("Straße A_b ñ 3d!",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.tokens(F.col("t"))).collect()] == [["strasse", "a", "b", "ñ", "3d"], []] == [r[0] for r in df.select(tokens.exact(F.col("t"))).collect()]


def test_text_scores(spark):
    docs = [(1, "base base dato vectorial"), (2, "base dato relacional"), (3, "indice vectorial"), (4, "")]
    df = spark.createDataFrame(docs, "id int, t string")
    n, avgdl, freq = text.statistics(df, "t", ["base"])
    assert (n, avgdl, freq) == (4, 9 / 4, {"base": 2}) and text.tfidf_idf(4, 2) == math.log10(2)

    def bm(d, q):
        w, s = d.split(), 0.0
        for x in q.split():
            f = sum(x in e.split() for _, e in docs)
            tf = w.count(x)
            s += math.log(1 + (4 - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) if tf else 0
        return s

    for q in ("base vectorial", "base base", "indice dato"):
        want = {i: pytest.approx(bm(d, q)) for i, d in docs if bm(d, q) > 0}
        assert {r.id: r._score for r in text.bm25(df, "t", q).collect()} == want
        batch = text.batch_bm25(df, "id", "t", spark.createDataFrame([(0, q)], "q int, w string"), "q", "w")
        assert {r.key: r.score for r in batch.collect()} == want
    assert text.sparse_cosine({"a": 1}, {}) == 0


def test_similar_text_ties(spark):
    """Copies whose terms are added up in any order tie exactly, so that the smaller keys come first."""
    rng = random.Random(3)
    words = [f"w{x}" for x in range(400)]
    copy = " ".join(rng.choice(words) for _ in range(300))
    shuffled = lambda: " ".join(rng.sample(copy.split(), 300))
    rows = [(k, copy if k < 3 else shuffled()) for k in range(300)] + [(1000 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "id int, descripcion string").repartition(7, "descripcion")
    got = recommend.similar_text(docs, 3, 10).collect()
    assert [r.id for r in got] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and len({r.score for r in got}) == 1


def test_text_index(spark, tmp_path):
    df = corpora.texts(spark, 80)
    i = text.TextIndex.build(df, "id", "texto", str(tmp_path / "i"), "v1")
    assert text.TextIndex.load(spark, str(tmp_path / "i"), "v2") is None and text.TextIndex.load(spark, str(tmp_path / "none"), "v1") is None
    q = "tema1palabra3 comun5 comun5"
    for model in ("bm25", "tf_idf"):
        plain = {r.id: r._score for r in text.match(df, "id", "texto", q, model).collect()}
        assert {r.key: pytest.approx(r.score) for r in i.search(spark, q, model).collect()} == plain
    assert i.lookup(spark, "comun5").count() == df.filter(F.array_contains(tokens.tokens(F.col("texto")), "comun5")).count()


def test_vectors(spark):
    df = corpora.clustered_vectors(spark, 300)
    rows = df.collect()
    x = np.array([r.embedding for r in rows])
    q = x[7] + 0.01
    value = {"euclidean": 1 / (1 + np.linalg.norm(x - q, axis=1)), "cosine": x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "dot": x @ q}
    for m, s in value.items():
        got = vector.top_k(df, "embedding", q.tolist(), 10, "id", m).collect()
        assert [r.id for r in got] == np.argsort(-s, kind="stable")[:10].tolist() and got[0]._score == pytest.approx(s.max())
        queries = spark.createDataFrame([(0, q.tolist())], "q int, v array<double>")
        assert [r.key for r in vector.batch_top_k(df, "embedding", "id", queries, "q", "v", 10, m).orderBy("rank").collect()] == [r.id for r in got]
    assert vectors.literal("1, 2") == [1.0, 2.0]
    for bad in ("", "[]", "x", [float("inf")]):
        with pytest.raises(EngineError):
            vectors.literal(bad)


def test_inverted_file(spark, tmp_path):
    df = corpora.clustered_vectors(spark, 400)
    index = vector.InvertedFile.build(df, "embedding", "id", "cosine").save(str(tmp_path / "ivf"))
    hits = 0
    for r in df.filter("id % 40 = 0").collect():
        exact = {x.id for x in vector.top_k(df, "embedding", r.embedding, 10, "id", "cosine").collect()}
        hits += len(exact & {x.id for x in index.top_k(r.embedding, 10).collect()})
    assert hits >= 0.9 * 100
    assert index.top_k(r.embedding, 350, probes=1).count() == 350


def test_media(spark, tmp_path):
    for name in ("disc", "square", "stripes"):
        for i in range(3):
            np.save(tmp_path / f"{name}{i}.npy", corpora.shape_image(name, seed=i))
    (tmp_path / "broken.npy").write_bytes(b"nope")
    files = media_files.files(spark, str(tmp_path))
    d = media.describe_files(files)
    assert d.filter("error is not null").count() == 1
    good = d.filter("error is null").withColumn("object", F.col("path")).cache()
    assert {len(r.descriptor) for r in good.limit(5).collect()} == {128}
    model = bow.train(good, "object", "descriptor", "image", 12)
    model.save(spark, str(tmp_path / "m.json"))
    again = bow.BowModel.load(spark, str(tmp_path / "m.json"))
    encoded = {r.path.rsplit("/", 1)[-1]: r.embedding for r in media.encode_files(files, {"image": again}).filter("embedding is not null").collect()}
    assert len(encoded) == 9 and all(abs(sum(x * x for x in v) - 1) < 1e-4 for v in encoded.values())
    e = np.array([encoded[f"disc{i}.npy"] for i in range(2)] + [encoded["stripes0.npy"]])
    assert e[0] @ e[1] > e[0] @ e[2]
    with pytest.raises(EngineError):
        bow.BowModel.load(spark, str(tmp_path / "m.json"), "opencv")
    assert media_files.kind_of(b"RIFF....WAVE") == "audio" and media_files.kind_of(b"", "x.PNG") == "image"
    pgm = media_files.read_image(b"P5 # c\n3 2\n255\n" + bytes([0, 128, 255, 1, 2, 3]))
    assert pgm.shape == (2, 3) and pgm[0, 2] == 1.0
    a = media_files.save_upload(str(tmp_path / "up"), "../x y.png", b"1", "image/png")
    assert a == media_files.save_upload(str(tmp_path / "up"), "../x y.png", b"1") and a != media_files.save_upload(str(tmp_path / "up"), "x y.png", b"2")


def test_audio(spark, tmp_path):
    rng = np.random.default_rng(1)
    songs = []
    for i in range(3):
        notes = rng.uniform(200, 2000, 22)
        songs.append(np.concatenate([np.sin(2 * np.pi * f * np.arange(audio.RATE) / audio.RATE) * 0.4 for f in notes]))
        (tmp_path / f"s{i}.wav").write_bytes(media.wav_bytes(songs[i], audio.RATE))
    (tmp_path / "quiet.wav").write_bytes(media.wav_bytes(np.zeros(audio.RATE * 25), audio.RATE))
    made = audio.corpus(media_files.files(spark, str(tmp_path), "*.wav")).cache()
    assert made.filter("error is not null").count() == 1
    good = made.filter("error is null")
    mean, std = audio.scale_of(good)
    seg = audio.normalised(good, mean, std).filter("active").withColumn("track", F.regexp_extract("path", r"s(\d)\.wav", 1).cast("int")).select("track", F.col("second").cast("int").alias("second"), "v").cache()
    start = {int(r.path[-5]): r.start for r in good.select("path", "start").distinct().collect()}
    cut = songs[1][(start[1] + 5) * audio.RATE : (start[1] + 13) * audio.RATE].copy()
    cut[2 * audio.RATE : 3 * audio.RATE] = 0
    r = audio.recognise(cut, mean, std, lambda q: audio.candidates(seg, q), spark)
    assert r["status"] == "ok" and r["silent_seconds"] == 1 and r["matches"][0]["track"] == 1 and r["matches"][0]["reference_start"] == 5
    assert audio.recognise(np.zeros(audio.RATE * 3), mean, std, None, spark)["status"] == "silent_or_too_short"
    hits = spark.createDataFrame([(s, 11, 8 + s, 0.98) for s in range(4)] + [(s, 12, 4, 0.97) for s in range(4)], "q_second int, track int, second int, score double")
    best = audio.align(hits, 4).collect()
    assert (best[0].track, best[0].reference_start, best[0].matched_seconds) == (11, 8, 4)
    assert audio.align(spark.createDataFrame([(s, 11, 8, 0.9) for s in range(4)], hits.schema), 4).count() == 0
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "query string, track int")
    m = evaluate.song_metrics(spark.createDataFrame([("a", 1, 1), ("b", 9, 1), ("b", 2, 2)], "query string, track int, rank int"), truth).first()
    assert (m.top1, m.recall, m.mrr) == (0.5, 1.0, 0.75)


def scores(spark, **sources):
    return spark.createDataFrame([(s, i, float(x)) for s, rows in sources.items() for i, x in rows] or [], "source string, id int, score double")


def test_fusion(spark):
    nan, inf = float("nan"), float("inf")
    norm = lambda rows: {r.id: r.score for r in recommend.normalised(scores(spark, a=rows)).collect()}
    assert norm([(1, 10), (2, 5), (3, 0)]) == {1: 1, 2: 0.5, 3: 0} and norm([(1, 3), (2, 3)]) == {1: 1, 2: 1}
    assert norm([(1, 2), (1, 8), (2, nan), (3, 4), (4, inf)]) == {1: 1, 3: 0}
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(recommend.fuse(scores(spark, texto=[(1, 9), (2, 4), (3, 2)], visual=[(3, 6), (4, 1)]), product=1)) == [3, 2, 4]
    assert ids(recommend.fuse(scores(spark, a=[(1, 1), (2, 0)], b=[(2, 1), (1, 0)]), {"a": 3, "b": 1}, 0)) == [1, 2]
    assert ids(recommend.fuse(scores(spark, a=[(1, 1)], b=[(2, 1)], c=[(3, 1)]), {"b": 0, "c": -2}, 0)) == [1]
    assert ids(recommend.fuse(scores(spark, a=[(5, 1), (4, 1), (3, 1)], b=[(3, 1), (2, 0)]), product=0, k=2)) == [3, 4]
    assert ids(recommend.fuse(scores(spark))) == []


def test_sources_and_learning(spark):
    s = corpora.store(spark)
    co = recommend.copurchase(s["compras"], 1).collect()
    buys = {}
    for r in s["compras"].collect():
        buys.setdefault(r.usuario_id, set()).add(r.producto_id)
    own = [u for u in buys if 1 in buys[u]]
    assert {r.producto_id: r.evidence for r in co} == {i: sum(i in buys[u] for u in own) for i in set().union(*[buys[u] for u in own]) - {1}}
    near = recommend.stores_with_stock(s["tiendas"], s["stock"], 3, (-12.0464, -77.0428), 60_000)
    assert {r.id for r in near.collect()} == {r.tienda_id for r in s["stock"].collect() if r.producto_id == 3 and r.cantidad > 0} and 0 <= recommend.availability(near) <= 1
    gathered, errors = recommend.gather({"meta": lambda: recommend.metadata(s["productos"], 1), "visual": lambda: recommend.visual(s["productos"], 1), "texto": lambda: recommend.similar_text(s["productos"], 1), "bad": lambda: recommend.metadata(s["productos"], -1)})
    assert set(errors) == {"bad"} and recommend.fuse(gathered, product=1).count() == 10
    cases = spark.createDataFrame([(c, src, i, sc, i == 2, c % 2) for c in range(6) for src, i, sc in (("good", 2, 1.0), ("good", 1, 0.0), ("bad", 1, 1.0), ("bad", 2, 0.0))], "case_id int, source string, id int, score double, relevant boolean, fold int")
    grid = recommend.weight_grid(["good", "bad"], (0, 1, 2))
    assert grid[0] == {"good": 0.5, "bad": 0.5}
    weights, p = recommend.learn_weights(cases, grid, 1)
    assert weights["good"] > weights["bad"] and p == 1.0
    assert [f["test"] for f in recommend.cross_validate(cases, grid, 1)] == [1.0, 1.0]
    assert all(x["preset"] == 1 for x in recommend.nested_presets(cases, [{"bad": 1.0}, {"good": 1.0}], 1))
    assert recommend.user_folds(s["compras"], "usuario_id", 3).filter("fold not between 0 and 2").count() == 0


def test_metrics(spark):
    m = evaluate.metrics([2], {2}, 10, 30)
    assert (m["precision"], m["recall"], m["hit"], m["ndcg"], m["mrr"], m["precision_3"], m["random"]) == (0.1, 1, 1, 1, 1, 1 / 3, 1 / 29)
    m = evaluate.metrics([3, 4, 5, 2], {1, 2}, 10, 12)
    assert (m["precision"], m["ceiling"], m["mrr"], m["precision_3"]) == (0.1, 0.2, 0.25, 0)
    with pytest.raises(EngineError):
        evaluate.metrics([1, 1], {1})
    ranked = spark.createDataFrame([(0, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (1, 2, 4)], "case_id int, id int, rank int")
    rel = spark.createDataFrame([(0, 2), (1, 1), (1, 2), (2, 9)], "case_id int, id int")
    got = {r.case_id: r for r in evaluate.ranking_metrics(ranked, rel).collect()}
    assert got[1].mrr == 0.25 and got[1].ceiling == 0.2 and got[2].hit == 0 and got[0].ndcg == 1
    attrs = spark.createDataFrame([(1, "a", "r"), (2, "a", "g"), (3, "b", "r")], "id int, shape string, colour string")
    near = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query int, key int, rank int")
    a = evaluate.attribute_precision(near, attrs, ["shape", "colour"]).first()
    assert (a.precision_shape, a.precision_colour, a.precision_all) == (0.5, 0.5, 0.0)
