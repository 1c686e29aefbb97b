import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from radiolake import config
from radiolake.operators import reports
from radiolake.sources import coco, logs
from radiolake.streaming import limiter, promotion


@pytest.fixture()
def documents(tmp_path):
    one = {"images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 50}], "annotations": [{"id": 1, "image_id": 1, "category_id_1": 1, "category_id_2": 6, "category_id_3": 1, "bbox": [5, 5, 10, 10]}, {"id": 9, "image_id": 77, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 1, "name": "Caries"}]}
    two = {"images": [{"id": 1, "file_name": "b.png", "width": 200, "height": 60}], "annotations": [{"id": 1, "image_id": 1, "category_id_1": 0, "category_id_2": 7, "bbox": [1, 1, 2, 2]}], "categories": []}
    for folder, doc in (("one/train triple.json", json.dumps(one)), ("two/val.json", json.dumps(two)), ("two/broken.json", '{"images": [')):
        p = tmp_path / "data" / folder
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(doc)
    return str(tmp_path / "data")


def test_documents_to_tables_and_back(spark, documents, tmp_path):
    d = coco.read_documents(spark, documents)
    assert d.count() == 2
    assert {(r["file"], r["images"], r["annotations"], r["names"]) for r in coco.summary(d, documents).collect()} == {("one/train triple.json", 1, 2, "Caries"), ("two/val.json", 1, 1, "")}
    assert coco.best(d, "train").endswith("train triple.json") and coco.best(d, "nothing").endswith("train triple.json")
    images, annotations, categories = coco.load(spark, documents, "train", combine=True, cache=str(tmp_path / "cache"))
    assert [r[0] for r in images.orderBy("id").select("id").collect()] == [1, 2]
    assert sorted(tuple(r) for r in annotations.select("id", "image_id", "category_id_3").collect()) == [(1, 1, 1), (1, 2, None)]
    assert [tuple(r) for r in categories.collect()] == [(1, "Caries")]
    again = coco.load(spark, "/nowhere", "train", cache=str(tmp_path / "cache"))
    assert again[0].count() == 2
    doc = {r["source_file"]: json.loads(r["json"]) for r in coco.document(*again).collect()}
    assert len(doc) == 2 and all(len(x["images"]) == 1 and x["categories"] for x in doc.values())
    with pytest.raises(ValueError):
        coco.best(d.where("false"), "train")
    only = coco.load(spark, documents, "val")
    assert only[0].count() == 1


def test_paths_of_images(spark):
    images = spark.createDataFrame([(1, "a.png", "d/x.json"), (2, "b.png", "d/x.json"), (3, "c.png", "e/x.json"), (4, "z.png", "e/x.json")], "id long, file_name string, source_file string")
    files = spark.createDataFrame([("d/a.png",), ("d/xrays/b.png",), ("q/c.png",), ("p/c.png",)], "path string")
    assert {r["id"]: r["local_path"] for r in coco.resolved(images, files).collect()} == {1: "d/a.png", 2: "d/xrays/b.png", 3: "q/c.png", 4: None}


LINES = ['{"image_id": 1, "status": "unverified"}', "", "{broken", '{"image_id": 2, "status": "generation_failed"}', '{"image_id": 2, "status": "unverified"}', '{"image_id": 3, "status": "generation_failed"}']


def test_logs(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(LINES))
    log = logs.read_traces(spark, str(tmp_path / "t.json"))
    assert log.count() == 4 and {r[0] for r in logs.completed(log).collect()} == {1, 2}
    (tmp_path / "a.json").write_text("[" + ", ".join(x for x in LINES if x.endswith("}")) + "]")
    assert logs.read_traces(spark, str(tmp_path / "a.json")).count() == 4
    logs.append_lines(log, str(tmp_path / "out"))
    logs.append_lines(log, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 8
    (tmp_path / "r.csv").write_text("  epoch,  a/b\n 1, 0.5\n 2, 0.25\n")
    assert logs.last_epoch(logs.training_log(spark, str(tmp_path / "r.csv"))).first().asDict() == {"epoch": 2.0, "a/b": 0.25}
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    assert tuple(logs.image_listing(spark, str(tmp_path)).select("kind", "width", "height").first()) == ("png", 7, 9)


def test_promotion_stream(spark, tmp_path):
    log, done, check = tmp_path / "log", str(tmp_path / "verified"), str(tmp_path / "check")
    log.mkdir()
    (log / "a.jsonl").write_text("\n".join(LINES))
    run = lambda: promotion.promote(spark, str(log), done, check, F.col("image_id") != 1).awaitTermination(120)
    run()
    assert [r[0] for r in spark.read.json(done).select("image_id").collect()] == [2]
    (log / "b.jsonl").write_text('{"image_id": 2, "status": "unverified"}\n{"image_id": 5, "status": "unverified"}\n')
    run()
    assert sorted(r[0] for r in spark.read.json(done).select("image_id").collect()) == [2, 5]


def test_limiter_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 12)
    rows = [("p", "gen", t), ("p", "gen", t + dt.timedelta(seconds=2)), ("p", "gen", t + dt.timedelta(seconds=10)), ("p", "gen", t + dt.timedelta(seconds=20)), ("p", "ver", t + dt.timedelta(seconds=30)), ("p", "ver", t + dt.timedelta(seconds=90)), ("q", "gen", t), ("p", "gen", t + dt.timedelta(days=1))]
    source = tmp_path / "calls"
    spark.createDataFrame(rows, "provider string, role string, ts timestamp").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("provider string, role string, ts timestamp").parquet(str(source))
    q = limiter.limited(stream, 5, 2, 60, 4, 3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["provider"], r["ts"]): r["reason"] for r in spark.table("limited").collect()}
    want = ["", "cooldown", "", "rolling limit", "", "daily cap", "", ""]
    assert [got[(p, ts)] for p, _, ts in rows] == want


def test_reports(spark, tmp_path):
    rows = {"base": {"format_adherence": 0.98, "exact_match_ci_95": [0.1, 0.2], "ece": None}}
    assert "| base | 0.980 |" in reports.summary_table(rows) and r"\begin{tabular}" in reports.summary_table(rows, "latex")
    with pytest.raises(ValueError):
        reports.summary_table(rows, "none")
    reports.write_report(rows, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r/metrics.json").read_text()) == rows
    labels = spark.createDataFrame([(1, 5, 2, 0.5, 0.5, 0.1, 0.1), (1, 4, 1, 0.25, 0.5, 0.1, 0.1)], "image_id int, id int, label_class int, cx double, cy double, nw double, nh double")
    assert reports.label_lines(labels).first()["text"] == "1 0.250000 0.500000 0.100000 0.100000\n2 0.500000 0.500000 0.100000 0.100000"
    note = reports.dataset_note(spark, "/d")
    assert "0: '11'" in note and "31: '48'" in note
    reports.run_note(str(tmp_path / "n"), "one", seed=1)
    assert json.loads((tmp_path / "n/one.json").read_text())["seed"] == 1
    reports.failure_log(spark.createDataFrame([("a", 1)], "category string, n int"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    marks = spark.createDataFrame([("a", 2), ("z", 1)], "tag string, at int")
    assert reports.latest(marks, "tag", "at").first()["tag"] == "a"
    assert reports.jsonable(spark.createDataFrame([(["b", "a"],)], "x array<string>")).first()[0] == '{"x":["a","b"]}'


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"seed": 1, "data": {"split": "val"}}')
    (tmp_path / "b.json").write_text('{"data": {"folds": 3}}')
    c = config.load(str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert (c.seed, c.data.split, c.data.folds, c.training.reward_weights.accuracy) == (1, "val", 3, 1.0)
    (tmp_path / "c.json").write_text('{"nothing": 1}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))
    (tmp_path / ".env").write_text("# no\nRADIOLAKE_TEST='x'\n")
    assert config.load_env(str(tmp_path / ".env")) == {"RADIOLAKE_TEST": "x"}


def test_documents_in_shards(spark):
    images = spark.createDataFrame([(i, f"{i}.png", 1, 1, "f.json") for i in range(25)], "id long, file_name string, width int, height int, source_file string")
    annotations = spark.createDataFrame([(i, i % 25, 0, 0, 0, [1.0], "f.json") for i in range(60)], "id long, image_id long, category_id_1 int, category_id_2 int, category_id_3 int, bbox array<double>, source_file string")
    docs = [json.loads(r["json"]) for r in coco.document(images, annotations, spark.createDataFrame([(1, "a")], "id int, name string"), most=10).collect()]
    assert sorted(len(d["images"]) for d in docs) == [5, 10, 10] and sum(len(d["annotations"]) for d in docs) == 60
    assert all({a["image_id"] for a in d["annotations"]} <= {i["id"] for i in d["images"]} for d in docs)


def test_results_are_kept_once(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "k long, v int, at int"
    assert logs.read_results(spark, path, schema, "k", "at").count() == 0
    for rows in ([(1, 1, 1), (2, 1, 1)], [(1, 2, 2)], [(2, 1, 1)]):
        logs.append_results(spark.createDataFrame(rows, schema), path)
    assert sorted(tuple(r) for r in logs.read_results(spark, path, schema, "k", "at").select("k", "v").collect()) == [(1, 2), (2, 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf = sparkContext = Context()

    from radiolake import runtime

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
    assert runtime.path_exists(spark, "/tmp") and not runtime.path_exists(spark, "/tmp/no/such/folder")
