from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from waymark.sources import annotations, images, sinks, tables


def make(folder, *names):
    for n in names:
        p = folder / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")


def test_scans(spark, tmp_path):
    make(tmp_path / "d", "b.jpg", "sub/a.JPG", "c.png", "no.txt", "e.webp")
    d = str(tmp_path / "d")
    names = lambda df: sorted(r.path.removeprefix(d + "/") for r in df.collect())
    assert names(images.scan(spark, d)) == ["b.jpg", "c.png", "sub/a.JPG"]
    assert names(images.scan(spark, d, images.ALL)) == ["b.jpg", "c.png", "e.webp", "sub/a.JPG"]
    assert names(images.scan(spark, d, (".jpg",), case_sensitive=True)) == ["b.jpg"]
    assert names(images.scan(spark, d, recursive=False)) == ["b.jpg", "c.png"]
    assert [r.path for r in images.relative(images.scan(spark, d, (".png",)), d).collect()] == ["c.png"]
    with pytest.raises(FileNotFoundError):
        images.scan(spark, d, (".gif",))
    with pytest.raises(FileNotFoundError):
        images.scan(spark, str(tmp_path / "none"))


def test_manifest_keeps_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("z.jpg\na.jpg\n\nm.jpg\n")
    rows = images.manifest(spark, str(tmp_path / "l.txt"), "/data").orderBy("image_id").collect()
    assert [r.path for r in rows] == ["/data/z.jpg", "/data/a.jpg", "/data/m.jpg"]


def test_descriptions(spark, tmp_path):
    (tmp_path / "d.csv").write_text('image_path,description\na.jpg,plain\nb.jpg, "quoted, with comma"\nc.jpg,one,too many\nC:\\x\\d.jpg,windows\n')
    got = {r.image_path: r.description for r in tables.descriptions(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {"a.jpg": "plain", "b.jpg": "quoted, with comma", "C:\\x\\d.jpg": "windows"}
    rooted = tables.descriptions(spark, str(tmp_path / "d.csv"), "/img")
    assert "/img/a.jpg" in {r.image_path for r in rooted.collect()}
    byhand = {r.image_path: r.description for r in tables.descriptions_by_hand(spark, str(tmp_path / "d.csv")).collect()}
    assert byhand["c.jpg"] == "one,too many" and byhand["b.jpg"] == "quoted, with comma"


def test_lines_and_results(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a, b,,c \n\n  \nd\n")
    assert [r.fields for r in tables.split_lines(spark, str(tmp_path / "t.txt")).collect()] == [["a", "b", "", "c"], ["d"]]
    df = spark.createDataFrame([("q.jpg", 1.0, "r.jpg", 2.5)], "query_image_path string, utm_east double, reference_1_path string, reference_1_distance double")
    sinks.csv(df, str(tmp_path / "out"), single=True)
    back = tables.results(spark, str(tmp_path / "out"))
    assert back.dtypes == df.dtypes and back.collect() == df.collect()
    with pytest.raises(ValueError, match="missing columns"):
        tables.require_columns(df, ["nothing"])


def test_requests_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([("gs://b/p/f/a.jpg",)], "uri string")
    sinks.requests(df, str(tmp_path / "req"), "uri", 'say "x"')
    line = json.loads(spark.read.text(str(tmp_path / "req")).first().value)
    assert line["request"]["contents"][0]["parts"][0]["file_data"] == {"file_uri": "gs://b/p/f/a.jpg", "mime_type": "image/jpeg"}
    assert line["request"]["contents"][0]["parts"][1]["text"] == 'say "x"'
    answered = line | {"response": {"candidates": [{"content": {"parts": [{"text": "red house, palm tree"}]}}]}}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x) for x in (answered, line, line | {"response": {"candidates": []}})))
    got = tables.predictions(spark, str(tmp_path / "p.jsonl"), "gs://b/p/").collect()
    assert [tuple(r) for r in got] == [("f/a.jpg", "red house, palm tree")]


def test_annotations(spark, tmp_path):
    write = lambda n, x: (tmp_path / n).write_text(json.dumps(x)) and str(tmp_path / n)
    t = write("t.json", [{"image": "b.jpg", "caption": "A dog.", "image_id": "k2"}, {"image": "a.jpg", "caption": "B cat", "image_id": "k1"}, {"image": "b.jpg", "caption": "C", "image_id": "k2"}])
    rows = sorted((r.img_id, r.caption) for r in annotations.caption_train(spark, t, "/i", "a picture of ").collect())
    assert rows == [(0, "a picture of a dog"), (0, "a picture of c"), (1, "a picture of b cat")]
    e = write("e.json", [{"image": "x_000012.jpg", "caption": ["One.", "Two"]}, {"image": "y_000007.jpg", "caption": ["Three"]}])
    imgs, texts = annotations.retrieval_eval(spark, e, "/i")
    assert sorted((r.txt_id, r.img_id, r.caption) for r in texts.collect()) == [(0, 0, "one"), (1, 0, "two"), (2, 1, "three")]
    assert {r.img_id: r.image for r in imgs.collect()} == {0: "/i/x_000012.jpg", 1: "/i/y_000007.jpg"}
    assert sorted(r.img_id for r in annotations.caption_eval(spark, e, "/i").collect()) == [7, 12]
    n = write("n.json", [{"images": ["l.png", "r.png"], "sentence": "Left is Red.", "label": "True"}])
    assert tuple(annotations.nlvr(spark, n, "/n").first()) == ("/n/l.png", "/n/r.png", "left is red", 1)
    v = write("v.json", [{"dataset": "vqa", "image": "q.jpg", "question": "What?", "question_id": 1, "answer": ["yes", "no"]}, {"dataset": "vg", "image": "g.jpg", "question": "Who?", "question_id": 2, "answer": "me"}])
    got = {r.question_id: (r.image, r.answer) for r in annotations.vqa(spark, v, roots={"vqa": "/a", "vg": "/b"}).collect()}
    assert got[2] == ("/b/g.jpg", "me") and got[1][0] == "/a/q.jpg" and json.loads(got[1][1]) == ["yes", "no"]
    p = [write(f"p{i}.json", [{"image": f"{i}.jpg", "caption": "c"}]) for i in range(3)]
    assert sorted(r.image for r in annotations.pretrain(spark, p[:1], p[1:], epoch=3).collect()) == ["0.jpg", "2.jpg"]
    (tmp_path / "w.jsonl").write_text('{"clip_name": "v1", "caption": "c"}\n')
    assert annotations.video(spark, str(tmp_path / "w.jsonl"), "/v").first().video == "/v/v1.mp4"


def test_cached_and_versioned(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert calls == [1]
    from datetime import datetime

    assert sinks.versioned("/x/out", datetime(2024, 1, 2, 3, 4, 5)) == "/x/out_20240102_030405"


def test_reports(spark):
    df = spark.createDataFrame([("q", ["a", "b"], ["c"])], "q string, p array<string>, t array<string>")
    got = df.select(sinks.report(F.col("q"), F.col("p"), F.col("t")).alias("v")).first().v
    assert got == "Query path:\nq\n\nPredictions paths:\na\nb\n\nPositives paths:\nc\n"
    res = spark.createDataFrame([("x", 2, "b", 0.5), ("x", 1, "a", 0.9)], "query string, rank int, path string, similarity double")
    assert [r["path"] for r in json.loads(sinks.search_json(res).first().value)["results"]] == ["a", "b"]


def test_backup(spark, tmp_path):
    from datetime import UTC, datetime

    (tmp_path / "a.csv").write_text("x\n1\n")
    at = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
    to = sinks.backup(spark, str(tmp_path / "a.csv"), at)
    assert to.endswith("a.csv.backup_20240506_070809") and (tmp_path / "a.csv.backup_20240506_070809").read_text() == "x\n1\n"
    with pytest.raises(FileExistsError):
        sinks.backup(spark, str(tmp_path / "a.csv"), at)


def test_polling_and_retries():
    from waymark.sources import jobs

    states, naps = iter(["RUNNING", "RUNNING", "DONE"]), []
    assert jobs.poll(lambda: next(states), {"DONE", "FAILED"}, sleep=naps.append) == "DONE" and naps == [30.0, 30.0]
    with pytest.raises(TimeoutError):
        jobs.poll(lambda: "RUNNING", {"DONE"}, limit=60, sleep=naps.append)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return 7

    assert jobs.retried(flaky, sleep=naps.append) == 7 and len(calls) == 3
    with pytest.raises(OSError):
        jobs.retried(lambda: (_ for _ in ()).throw(OSError("down")), times=2, sleep=naps.append)
    with pytest.raises(KeyError):
        jobs.retried(lambda: {}["x"], sleep=naps.append)


def test_json_arrays(spark, tmp_path):
    df = spark.range(30).select("id", F.concat(F.lit("c"), "id").alias("caption"))
    sinks.json_arrays(df.repartition(7).orderBy("id"), str(tmp_path / "a"))
    back = spark.read.schema("id long, caption string").option("multiLine", True).json(str(tmp_path / "a"))
    assert sorted(back.collect()) == sorted(df.collect())
    sinks.json_arrays(df.limit(0), str(tmp_path / "none"))
    assert spark.read.schema("id long, caption string").option("multiLine", True).json(str(tmp_path / "none")).count() == 0


def test_manifest_of_many_files(spark, tmp_path):
    spark.range(1000).orderBy("id").select(F.when(F.col("id") % 4 == 3, "").otherwise(F.concat("id", F.lit(".jpg"))).alias("value")).repartitionByRange(5, F.col("value")).sortWithinPartitions("value").write.text(str(tmp_path / "m"))
    lines = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines()]
    got = {r.image_id: r.path for r in images.manifest(spark, str(tmp_path / "m"), "/d").collect()}
    assert got == {i: f"/d/{x}" for i, x in enumerate(lines) if x}
