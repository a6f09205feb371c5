from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.config import PRESETS, GeoConfig, PlaceConfig, RetrievalConfig, load_ini, load_json, save_ini, save_json
from waymark.encoders import HashingEncoder, encode
from waymark.operators import dedup, geo, knn, lookup, metrics, places, rerank, reshape, sampling
from waymark.plans import analysis, retrieval
from waymark.sources import images

REFS = [(i, f"/r/@{100 + 50 * i}.0@{200 + 50 * i}.0@ref_image_{i}@.jpg") for i in range(5)]
QUERIES = [(0, "/q/@120.0@220.0@query_image_0@.jpg"), (1, "/q/@180.0@280.0@query_image_1@.jpg")]


def points(spark, rows, name):
    df = images.with_coordinates(spark.createDataFrame(rows, f"{name} long, path string"))
    return df.withColumnsRenamed({"utm_east": "e", "utm_north": "n"})


def test_nearest_references(spark):
    q, d = points(spark, QUERIES, "query_id"), points(spark, REFS, "db_id")
    got = {(r.query_id, r.rank): (r.db_id, round(r.distance, 6)) for r in geo.nearest(q, d, 3).collect()}
    assert got == {(0, 1): (0, 28.284271), (0, 2): (1, 42.426407), (0, 3): (2, 113.137085), (1, 1): (2, 28.284271), (1, 2): (1, 42.426407), (1, 3): (3, 98.994949)}
    assert {(r.query_id, r.rank): (r.db_id, round(r.distance, 6)) for r in geo.nearest_by_rings(q, d, 3).collect()} == got
    wide = analysis.nearest_references(q.withColumnRenamed("path", "query_image_path"), d, 3)
    assert reshape.available(wide.columns) == 3 and wide.count() == 2
    assert {(r.query_id, r.rank): round(r.physical, 6) for r in analysis.physical_distances(wide).collect()} == {k: v[1] for k, v in got.items()}


@pytest.mark.parametrize(("radius", "want"), [(25.0, []), (30.0, [(0, 0), (1, 2)])])
def test_radius(spark, radius, want):
    q, d = points(spark, QUERIES, "query_id"), points(spark, REFS, "db_id")
    assert sorted((r.query_id, r.db_id) for r in geo.within_radius(q, d, radius).collect()) == want


def test_radius_is_inclusive(spark):
    q, d = spark.createDataFrame([(0, 0.0, 0.0)], "query_id long, e double, n double"), spark.createDataFrame([(0, 25.0, 0.0), (1, -15.0, 20.0), (2, 25.1, 0.0)], "db_id long, e double, n double")
    assert sorted(r.db_id for r in geo.within_radius(q, d, 25.0).collect()) == [0, 1]


def test_recall(spark):
    q = spark.range(2).withColumnRenamed("id", "query_id")
    p = spark.createDataFrame([(0, 1, 3), (0, 2, 1), (1, 1, 0), (1, 2, 2)], "query_id long, rank int, db_id long")
    t = spark.createDataFrame([(0, 1)], "query_id long, db_id long")
    assert {r.k: r.recall for r in metrics.recall_at(q, p, t, (1, 2)).collect()} == {1: 0.0, 2: 50.0}


def test_rank_metrics(spark):
    s = [[0.9, 0.1, 0.5], [0.2, 0.8, 0.3]]
    scores = spark.createDataFrame([(i, j, s[i][j]) for i in range(2) for j in range(3)], "img_id long, txt_id long, score double")
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "img_id long, txt_id long")
    r = metrics.matching_eval(scores, scores, pairs, median=True).first()
    assert (r.txt_r1, r.txt_r5, r.txt_r10, r.img_r5, r.img_mdR) == (50, 100, 100, 100, 2)
    assert r.img_r1 == pytest.approx(100 / 3)


def test_places(spark):
    c = PlaceConfig(min_images_per_class=1)
    rows = places.classified(spark.createDataFrame([(0, 396523.4, 4983807.9, 134.0), (1, -3.0, 5.0, 0.0)], "image_id long, e double, n double, heading double"), c).orderBy("image_id").collect()
    assert tuple(rows[0].class_id) == (396520, 4983800, 120) and tuple(rows[0].group_id) == (2, 0, 0)
    assert rows[1].class_id.ce == -10 and rows[1].group_id.ge == 4
    assert c.cache_name() == "places_M10_N5_alpha30_L2_mipc1"


def test_dedup(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "image_id long, embedding array<float>")
    for f in (dedup.exact, dedup.windowed, dedup.near):
        assert sorted(r.image_id for r in f(df).collect()) == [0, 1, 2]
    assert dedup.duplicates(df).first().ids == [0, 3]


def test_search_ways_agree(spark):
    rng = np.random.default_rng(5)
    q = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(7)], "query_id long, embedding array<float>")
    d = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(200)] + [(200, None)], "db_id long, embedding array<float>").repartition(5)
    for metric in ("cosine", "dot_product", "euclidean", "manhattan"):
        a, b = ({(r.query_id, r.rank): (r.db_id, round(r.similarity, 6)) for r in knn.search(q, d, metric, 9, way=w).collect()} for w in ("columns", "blocks"))
        assert a == b and len(a) == 63
    assert knn.search(q, d, "euclidean", 3, threshold=0.5).count() == 0
    assert knn.nearest(q, d.limit(2), 5).groupBy("query_id").count().where("count > 2").count() == 0


def test_retrieve_keeps_long_texts(spark):
    q = spark.createDataFrame([(0, "@1@2@a.jpg", "short", [1.0, 0.0]), (1, "b.jpg", "x" * 400, [0.0, 1.0])], "query_id long, image_path string, description string, embedding array<float>")
    d = spark.createDataFrame([(0, "@5@6@r.jpg", [1.0, 0.0]), (1, "@7@8@s.jpg", [0.0, 1.0])], "db_id long, path string, embedding array<float>")
    r = {x.query_id: x for x in retrieval.retrieve(q, d, RetrievalConfig(), 2).collect()}
    assert (r[0].utm_east, r[0].reference_1_utm_east, r[0].failed, r[0].n_matches) == (1.0, 5.0, False, 2)
    assert (r[1].utm_east, r[1].reference_1_path, r[1].failed, r[1].n_matches) == (None, None, True, 0)
    s = retrieval.statistics(retrieval.retrieve(q, d, RetrievalConfig(), 2)).first()
    assert tuple(s) == (2, 1, 1, 2)
    t = retrieval.retrieve(q, d, RetrievalConfig(on_long_text="truncate"), 2)
    assert t.where("failed").count() == 0


def test_lookup(spark):
    d = spark.createDataFrame([("a", "second", 2), ("a", "first", 1)], "image_path string, description string, pos int")
    i = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.path: r.description for r in lookup.describe(i, d, ["pos"]).collect()} == {"a": "first", "b": ""}
    with pytest.raises(Exception, match="no description of b"):
        lookup.describe(i, d, ["pos"], missing=None).collect()
    w = lookup.answer_weights(spark.createDataFrame([(1, ["yes", "yes", "no", "yes"])], "q int, a array<string>"), "q", "a")
    assert {r.answer: r.weight for r in w.collect()} == {"yes": 0.75, "no": 0.25}
    part = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, pos int")
    merged = lookup.merge_keep_first([part((1, "a", 5), (1, "b", 4)), part((1, "c", 0), (2, "d", 0))], "k")
    assert {(r.k, r.v) for r in merged.collect()} == {(1, "b"), (2, "d")}


def test_numbered_is_dense(spark):
    df = spark.range(1000).select(F.format_string("p%05d", (F.col("id") * 7919) % 1000).alias("path")).repartition(7)
    rows = images.numbered(df).orderBy("path").collect()
    assert [r.image_id for r in rows] == list(range(1000))


def test_meters(spark):
    m = spark.createDataFrame([("x", i, float(v), 1) for i, v in enumerate([1, 4, 2, 9])], "meter string, step long, value double, n long")
    r = metrics.smoothed(m, 4).orderBy(F.desc("step")).first()
    assert (r.median, r.avg, r.max, r.latest, r.global_avg) == (2, 4, 9, 9, 4)


def test_rerank(spark):
    s = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.1)], "i long, j long, similarity double")
    out = rerank.rerank(s, "i", "j", 2, lambda _: F.when(F.col("j") == 1, 1.0).otherwise(0.0))
    assert {r.j: round(r.score, 6) for r in out.collect()} == {0: 0.9, 1: 1.8}
    full = rerank.dense(out, spark.range(1).toDF("i"), spark.range(3).toDF("j"), "i", "j")
    assert {r.j: r.score for r in full.where("j = 2").collect()} == {2: -100.0}


def test_reshape(spark):
    wide = spark.createDataFrame(
        [("/path/to/query1.jpg", 100.0, 200.0, "/path/to/ref1.jpg", 15.2, 100.1, 200.1, "/path/to/ref3.jpg", 25.8, 100.2, 200.2)],
        "query_image_path string, utm_east double, utm_north double, reference_1_path string, reference_1_distance double, reference_1_utm_east double, reference_1_utm_north double, "
        "reference_2_path string, reference_2_distance double, reference_2_utm_east double, reference_2_utm_north double",
    )
    got = {r["rank"]: round(r.physical, 6) for r in analysis.physical_distances(wide, "query_image_path").collect()}
    assert got == {1: 0.141421, 2: 0.282843}
    assert reshape.has_reference(wide).count() == 1
    out, counts = reshape.replaced_paths(wide, "/path", "/p")
    assert out.first().reference_2_path == "/p/to/ref3.jpg" and out.first().utm_east == 100.0
    assert {r.column: r.changed for r in counts.collect()} == {"query_image_path": 1, "reference_1_path": 1, "reference_2_path": 1}


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("g"), "id")
    a, b = (sorted(sampling.one_of_each(df.repartition(n), "g", "id", 3).collect()) for n in (1, 6))
    assert a == b
    w = spark.createDataFrame([(q, i, float(i)) for q in range(2000) for i in range(3)], "q long, i long, w double")
    share = {r.i: r["count"] for r in sampling.weighted_one(w, "q", "i", "w", 1).groupBy("i").count().collect()}
    assert 0 not in share and share[2] / 2000 == pytest.approx(2 / 3, abs=0.05)


def test_encode_policies(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "id long, t string")
    assert {r.id: r.embedding is None for r in encode(df, "t", HashingEncoder).collect()} == {0: False, 1: True}
    assert encode(df, "t", HashingEncoder, on_error="drop").count() == 1
    assert {r.id: sum(map(abs, r.embedding)) > 0 for r in encode(df, "t", HashingEncoder, on_error="zero").collect()} == {0: True, 1: False}
    with pytest.raises(Exception):  # noqa: B017
        encode(df, "t", HashingEncoder, on_error="raise").collect()


def test_configs(tmp_path):
    assert set(PRESETS) == {"default", "vpr", "fast", "high_accuracy", "blip", "blip_large"} and PRESETS["blip"].max_chars == 2000
    save_json(PRESETS["vpr"], str(tmp_path / "c.json"))
    assert load_json(str(tmp_path / "c.json")) == PRESETS["vpr"]
    c = GeoConfig(reference_path="/r", top_k=7, debug=True)
    save_ini(c, str(tmp_path / "c.ini"))
    assert load_ini(str(tmp_path / "c.ini")) == c
    with pytest.raises(ValueError, match="unknown similarity metric"):
        RetrievalConfig(similarity_metric="x")


def test_search_takes_blocks_beyond_the_bound(spark, monkeypatch):
    """A large database is never joined row by row; vectors of great norm keep their true neighbours."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16)) * 1e-3 + 1e4
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "db_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, [float(x) for x in base[i] + 1e-4]) for i in range(0, 300, 50)], "query_id long, embedding array<double>")
    want = {(i, int(j)) for i in range(0, 300, 50) for j in np.lexsort((np.arange(300), ((base - (base[i] + 1e-4)) ** 2).sum(axis=1)))[:5]}
    small = knn.nearest(q, d, 5)
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 100)
    large = knn.nearest(q, d, 5)
    plan = large._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "MapInPandas" in plan
    assert {(r.query_id, r.db_id) for r in large.collect()} == {(r.query_id, r.db_id) for r in small.collect()} == want


def test_rings_with_few_and_far_points(spark):
    d = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "db_id long, e double, n double")
    q = spark.createDataFrame([(0, 0.0, 0.0), (1, 90000.0, 5.0)], "query_id long, e double, n double")
    got = sorted((r.query_id, r.rank, r.db_id) for r in geo.nearest_by_rings(q, d, 5).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 2), (1, 2, 1), (1, 3, 0)]


def test_bleu_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    from waymark.operators import captions

    rng = random.Random(3)
    words = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14)))
    cands = {i: words() for i in range(40)} | {99: "no reference here"}
    refs = {(i, k): words() for i in range(40) for k in range(1, 4)}
    hit, total, own, wanted = Counter(), Counter(), 0, 0
    for i, t in cands.items():
        if i == 99:
            continue
        w, others = t.split(), [refs[i, k].split() for k in range(1, 4)]
        own, wanted = own + len(w), wanted + min((abs(len(o) - len(w)), len(o)) for o in others)[1]
        for n in range(1, 5):
            grams = lambda x: Counter(tuple(x[p : p + n]) for p in range(len(x) - n + 1))  # noqa: E731, B023
            g, rs = grams(w), [grams(o) for o in others]
            total[n] += sum(g.values())
            hit[n] += sum(min(c, max(r[x] for r in rs)) for x, c in g.items())
    want = {n: min(1.0, math.exp(1 - wanted / own)) * math.prod(hit[k] / total[k] for k in range(1, n + 1)) ** (1 / n) for n in range(1, 5)}
    c = spark.createDataFrame(list(cands.items()), "id long, text string")
    r = spark.createDataFrame([(i, k, t) for (i, k), t in refs.items()], "id long, ref long, text string")
    got = {x.n: x.bleu for x in captions.bleu(c, r).collect()}
    assert got == pytest.approx(want)
    assert {x.n: x.bleu for x in captions.bleu(c.limit(0), r).collect()} == dict.fromkeys(range(1, 5), 0.0)


def test_yaml_configs(tmp_path):
    pytest.importorskip("yaml")
    from waymark.config import load_yaml, save_yaml

    save_yaml(PRESETS["blip_large"], str(tmp_path / "c.yaml"))
    assert load_yaml(str(tmp_path / "c.yaml")) == PRESETS["blip_large"]
