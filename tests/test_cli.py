from __future__ import annotations

import json

import pytest

from waymark import cli
from waymark.config import PRESETS, resolve
from waymark.encoders import HashingEncoder
from waymark.plans.retrieval import Retriever


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda name: spark)
    return lambda *args: cli.main([str(a) for a in args])


def test_analyze(spark, run, tmp_path, capsys):
    for i in range(5):
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / f"@{100 + 50 * i}.0@{200 + 50 * i}.0@ref_image_{i}@.jpg").write_bytes(b"x")
    (tmp_path / "q").mkdir()
    for i, (e, n) in enumerate(((120, 220), (180, 280))):
        (tmp_path / "q" / f"@{e}.0@{n}.0@query_image_{i}@.jpg").write_bytes(b"x")
    (tmp_path / "q" / "invalid_filename.jpg").write_bytes(b"x")
    run("analyze", "--reference", tmp_path / "r", "--query", tmp_path / "q", "--output", tmp_path / "out", "--top-k", 3)
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("utm_east").collect()
    assert len(rows) == 2 and "ref_image_0" in rows[0].reference_1_path and float(rows[0].reference_3_distance) == pytest.approx(113.137085)
    run("statistics", tmp_path / "out")
    run("analyze", "--reference", tmp_path / "r", "--query", tmp_path / "q", "--debug", "--debug-n", 1)
    assert "28.28" in capsys.readouterr().out
    run("replace-paths", tmp_path / "out", str(tmp_path), "/moved", "--output", tmp_path / "moved")
    assert spark.read.option("header", True).csv(str(tmp_path / "moved")).first().reference_1_path.startswith("/moved/r/")
    run("rebase-paths", tmp_path / "out", "/x/", "--output", tmp_path / "based", "--change_references")
    assert spark.read.option("header", True).csv(str(tmp_path / "based")).first().query_image_path.startswith("/x/@")


def test_partition_and_requests(spark, run, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(12):
        (tmp_path / "d" / f"@{396520 + i % 3}.0@4983800.0@10@S@1@2@p{i}@@{120 + i}@@@@201311@@.jpg").write_bytes(b"x")
    run("partition", tmp_path / "d", tmp_path / "out", "--min_images_per_class", 2)
    classes = spark.read.parquet(str(tmp_path / "out" / "places_M10_N5_alpha30_L2_mipc2" / "classes")).collect()
    assert len(classes) == 1 and tuple(classes[0].class_id) == (396520, 4983800, 120) and classes[0].n_images == 12
    run("requests", tmp_path / "d", tmp_path / "req", "--bucket", "b", "--prompt", "describe", "--start_image", 2, "--max_image", 3)
    assert spark.read.text(str(tmp_path / "req")).count() == 3


def test_text_and_predictions(spark, run, tmp_path):
    (tmp_path / "t.txt").write_text("a, b\n\nc, d, e\n")
    run("text-to-csv", tmp_path / "t.txt", tmp_path / "t")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "t")).fillna("").collect()) == [("a", "b", ""), ("c", "d", "e")]
    line = {"request": {"contents": [{"parts": [{"file_data": {"file_uri": "gs://b/a.jpg"}}]}]}, "response": {"candidates": [{"content": {"parts": [{"text": "red, blue"}]}}]}}
    (tmp_path / "p.jsonl").write_text(json.dumps(line))
    run("predictions", tmp_path / "p.jsonl", tmp_path / "p", "--uri_prefix", "gs://b/")
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "p")).first()) == ("a.jpg", "red, blue")


def test_retrieve_and_evaluate(spark, run, tmp_path, capsys):
    q = spark.createDataFrame([(0, "@0@0@q.jpg", "a place", [1.0, 0.0], 0.0, 0.0)], "query_id long, image_path string, description string, embedding array<float>, e double, n double")
    d = spark.createDataFrame([(0, "@5@6@r.jpg", [0.9, 0.1], 10.0, 0.0), (1, "@7@8@s.jpg", [0.0, 1.0], 500.0, 0.0)], "db_id long, path string, embedding array<float>, e double, n double")
    q.write.parquet(str(tmp_path / "q"))
    d.write.parquet(str(tmp_path / "d"))
    run("retrieve", "--queries", tmp_path / "q", "--database", tmp_path / "d", "--output", tmp_path / "o", "--preset", "vpr", "--top_k", 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().reference_1_path == "@5@6@r.jpg"
    run("evaluate", "--queries", tmp_path / "q", "--database", tmp_path / "d", "--output", tmp_path / "rep", "--recall_values", 1, 5)
    assert "100.0" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "rep")).first().correct[0]


def test_retriever(spark, tmp_path):
    (tmp_path / "i").mkdir()
    for i, c in enumerate(("red", "green", "red")):
        (tmp_path / "i" / f"{i}.jpg").write_bytes(c.encode() * 40)
    r = Retriever(spark, HashingEncoder, PRESETS["default"])
    with pytest.raises(ValueError, match="build or load"):
        r.save_database(str(tmp_path / "x"))
    assert r.build_image_database(str(tmp_path / "i")).count() == 2
    r.save_database(str(tmp_path / "db"))
    r.load_database(str(tmp_path / "db"))
    assert r.check_integrity().first().duplicate_features == 0
    found = r.search(spark.createDataFrame([(0, "a red house")], "query_id long, description string"), 2)
    assert sorted(x["rank"] for x in found.collect()) == [1, 2]


def test_resolve(tmp_path):
    assert resolve("fast", default_top_k=9).default_top_k == 9 and resolve("fast").similarity_metric == "dot_product"
    (tmp_path / "c.json").write_text('{"default_top_k": 3}')
    assert resolve(None, str(tmp_path / "c.json")).default_top_k == 3
    with pytest.raises(ValueError, match="unknown preset"):
        resolve("nothing")
