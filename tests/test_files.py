"""Readers, writers and column functions on small files and rows."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide import schema
from annotide.functions import boxes, geometry, polygons, text
from annotide.operators import joins, labels, ordering, statistics, tables
from annotide.plans import pipelines
from annotide.sources import documents, label_files
from annotide.streaming import sensor


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture
def label_dir(tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.4\n\n12 0.1 0.1 0.1 0.1 \n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("3 0.1 0.1 0.5 0.1 0.5 0.5")
    return str(tmp_path)


def test_label_files_keep_line_numbers(spark, label_dir):
    rows = label_files.label_rows(spark, label_dir)
    got = {(r["image"], r["obj"], r["cls"], tuple(r["coords"])) for r in rows.collect()}
    assert got == {("a", 0, 0, (0.5, 0.5, 0.2, 0.4)), ("a", 2, 12, (0.1, 0.1, 0.1, 0.1)), ("c", 0, 3, (0.1, 0.1, 0.5, 0.1, 0.5, 0.5))}
    listing = label_files.files(spark, label_dir, "*.txt")
    assert {r["stem"] for r in listing.collect()} == {"a", "b", "c"}
    full = label_files.with_empty(rows, listing)
    assert full.where("image = 'b' and cls is null").count() == 1
    box = {r["image"]: (r["cx"], r["cy"], r["w"], r["h"]) for r in label_files.with_boxes(rows.where("obj = 0")).collect()}
    assert box["c"] == pytest.approx((0.3, 0.3, 0.4, 0.4)) and box["a"] == pytest.approx((0.5, 0.5, 0.2, 0.4))


def test_attributes_and_confidence(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2 0 3 0.5 0.5 0.2 0.2 0.9\n4 0 0.5 0.5 0.2 0.2 0.4")
    rows = label_files.label_rows(spark, str(tmp_path), attributes=True, confidence=True, binary=True).orderBy("obj").collect()
    assert [(r["cls"], r["atts"], r["coords"], r["conf"]) for r in rows] == [(1, [0, 1], [0.5, 0.5, 0.2, 0.2], 0.9), (4, [], [0.5, 0.5, 0.2, 0.2], 0.4)]


def test_written_labels_read_back(spark, label_dir, tmp_path):
    rows = label_files.label_rows(spark, label_dir)
    got = {r["image"]: r["value"] for r in label_files.label_text(rows).collect()}
    assert got["a"] == "0 0.5 0.5 0.2 0.4\n12 0.1 0.1 0.1 0.1"
    withatts = rows.withColumn("atts", F.array(F.lit(1), F.lit(0)))
    assert {r["value"] for r in label_files.label_text(withatts.where("image = 'c'"), True).collect()} == {"3 2 1 0 0.1 0.1 0.5 0.1 0.5 0.5"}
    label_files.write_labels(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "image=a").is_dir()


def test_lists_and_classes(spark, tmp_path):
    (tmp_path / "train.txt").write_text("/data/x/img_1.jpg\nimg.2.png\n")
    assert [r["stem"] for r in label_files.list_of(spark, str(tmp_path / "train.txt")).collect()] == ["img_1", "img.2"]
    (tmp_path / "class.txt").write_text("car\nbus\n")
    assert [tuple(r) for r in label_files.class_list(spark, str(tmp_path / "class.txt")).collect()] == [(0, "car"), (1, "bus")]
    (tmp_path / "ids.txt").write_text("a b 0001\n0002\n")
    assert [r["token"] for r in label_files.last_tokens(spark, str(tmp_path / "ids.txt"), ".xml").collect()] == ["0001.xml", "0002.xml"]
    (tmp_path / "attribute.yaml").write_text("attributes:\n  dirty: [none, some]\n  torn: [none, much]\n")
    assert label_files.attribute_levels(spark, str(tmp_path / "attribute.yaml")).count() == 4
    (tmp_path / "data.yaml").write_text("names: [car, bus]\n")
    assert {r["name"] for r in label_files.dataset_names(spark, str(tmp_path)).collect()} >= {"car", "bus"}


def test_faulty_files_and_tasks(spark, label_dir):
    lines, listing = label_files.lines(spark, label_dir), label_files.files(spark, label_dir, "*.txt").withColumnRenamed("stem", "file")
    assert {r["file"] for r in labels.faulty_files(lines, listing).collect()} == {"b", "c"}
    assert {tuple(r) for r in labels.task_of(lines).collect()} == {("a", "det"), ("c", "seg")}
    assert {r["file"] for r in pipelines.checked(lines, listing).collect()} == {"a"}


def test_coco_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(0, 7, "a.jpg", 4, 3), (0, 8, "b.jpg", 4, 3)], "part int, id long, file_name string, height int, width int")
    annos = spark.createDataFrame([(0, 1, 7, 2, [0.0, 0.0, 1.0, 1.0])], "part int, id long, image_id long, category_id long, bbox array<double>")
    cats = spark.createDataFrame([(2, "x", "")], schema.CATEGORIES)
    (tmp_path / "c.json").write_text(documents.coco_text(images, annos, ["part"], cats).first()["json"])
    i, a, c = documents.coco(spark, str(tmp_path))
    assert {r["file_name"] for r in i.collect()} == {"a.jpg", "b.jpg"} and a.first()["bbox"] == [0.0, 0.0, 1.0, 1.0] and c.first()["name"] == "x"
    boxes_ = spark.createDataFrame([(7, 0, 2, 1.9, 1.2, 5.7, 3.0), (7, 1, 2, 0.0, 0.0, 2.0, 2.0)], "image_id long, obj int, cls int, x1 double, y1 double, x2 double, y2 double")
    rows = documents.coco_annotations(boxes_, base=1).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2] and rows[0]["bbox"] == [1.0, 1.0, 4.0, 2.0] and rows[0]["segmentation"][0][4:6] == [5.0, 3.0]
    kept = tables.without_images(i.select("id"), a.select("image_id"), spark.createDataFrame([(7,)], "id long"))
    assert [t.count() for t in kept] == [1, 0]


def test_shape_documents(spark, tmp_path):
    doc = {"imagePath": "a.jpg", "imageHeight": 10, "imageWidth": 20, "shapes": [{"label": "car", "shape_type": "polygon", "points": [[1, 2], [3, 2], [3, 4]], "attributes": {"k": "v", "gone": "1"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = documents.shapes(spark, str(tmp_path))
    r = rows.first()
    assert (r["label"], r["coords"], r["attributes"]["k"], r["width"]) == ("car", [1.0, 2.0, 3.0, 2.0, 3.0, 4.0], "v", 20)
    nested = documents.json_documents(spark, str(tmp_path), documents.SHAPES).select("file", F.col("d.shapes").alias("shapes"))
    assert value(spark, F.lit(1)) == 1
    out = nested.select(labels.without_key(F.col("shapes"), "gone").alias("a"), labels.with_values(F.col("shapes"), "k", {"v": "w"}).alias("b"), labels.translated(F.col("shapes"), {"car": "auto"}, {"k": "kk"}, {"v": "vv"}).alias("c")).first()
    assert out["a"][0]["attributes"] == {"k": "v"} and out["b"][0]["attributes"]["k"] == "w"
    assert out["c"][0]["label"] == "auto" and out["c"][0]["attributes"]["kk"] == "vv"
    assert {(r["attribute"], r["value"]) for r in labels.attribute_values(nested).collect()} == {("k", "v"), ("gone", "1")}
    again = spark.createDataFrame([("a.jpg", 20, 10, 0, "car", "polygon", [[1.0, 2.0]], {"k": "v"}), ("b.jpg", 20, 10, 0, None, None, None, None)], "image string, width int, height int, obj int, label string, shape_type string, points array<array<double>>, attributes map<string,string>")
    made = {r["image"]: json.loads(r["json"]) for r in documents.shape_documents(again).collect()}
    assert made["a.jpg"]["shapes"][0]["attributes"] == {"k": "v"} and made["b.jpg"]["shapes"] == []


def test_xml(spark, tmp_path):
    (tmp_path / "v.xml").write_text(
        "<annotation><filename>v.jpg</filename><size><width>20</width><height>10</height></size>"
        "<object><name>car</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
        "<object><name>bus</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    )
    rows = documents.voc(spark, str(tmp_path))
    assert [(r["name"], r["x2"], r["width"]) for r in rows.collect()] == [("car", 3.0, 20)]
    text_ = documents.voc_documents(rows.withColumn("image", F.lit("v.jpg"))).first()["xml"]
    assert "<xmax>3.0</xmax>" in text_ and "<width>20</width>" in text_
    other = tmp_path / "rs"
    other.mkdir()
    (other / "r.xml").write_text("<annotation><objects><object><possibleresult><name>ship</name></possibleresult><points><point>1.7,2.2</point><point>3.9,4</point></points></object></objects></annotation>")
    r = documents.remote_sensing(spark, str(other)).first()
    assert (r["name"], r["coords"]) == ("ship", [1.0, 2.0, 3.0, 4.0])


def test_block_yaml_and_table_formats(spark, tmp_path):
    faces = tmp_path / "f"
    faces.mkdir()
    (faces / "f.txt").write_text("x/1.jpg\n2\n1 2 3 4 0 0\n5 6 7 8 0 0\ny/2.jpg\n0\n0 0 0 0 0 0\nz/3.jpg\n1\n9 9 9 9 0 0\n")
    assert [(r["image"], r["obj"], r["x"]) for r in documents.face_blocks(spark, str(faces)).collect()] == [("x/1.jpg", 0, 1.0), ("x/1.jpg", 1, 5.0), ("z/3.jpg", 0, 9.0)]
    lights = tmp_path / "l"
    lights.mkdir()
    (lights / "l.yaml").write_text("- path: a.png\n  boxes:\n  - {label: Red, x_min: 1, x_max: 3, y_min: 2, y_max: 4}\n- path: b.png\n  boxes: []\n")
    rows = documents.yaml_boxes(spark, str(lights)).withColumn("cls", text.four_lights(F.col("label"))).collect()
    assert [(r["image"], r["x2"], r["cls"]) for r in rows] == [("a.png", 3.0, 2)]
    (tmp_path / "g.csv").write_text("00001.ppm;774;411;815;446;11\n")
    assert documents.semicolon_boxes(spark, str(tmp_path / "g.csv")).first()["cat_id"] == 11
    (tmp_path / "v.csv").write_text("10,1,2,3,4,5,0,1,x\n11,1,2,3,4,5,0,1,x\n")
    assert documents.video_truth(spark, str(tmp_path / "v.csv"), 10).count() == 1
    clouds = tmp_path / "p"
    clouds.mkdir()
    (clouds / "t.pcd").write_text("# x\nVERSION 1\nDATA ascii\n1 2 3 img1 1 0 0 0 1 0 0 0 1\n4 5 6 img2 1 0 0 0 1 0 0 0 1\n")
    assert [(r["x"], r["index"], len(r["r"])) for r in documents.trajectory(spark, str(clouds)).orderBy("line_no").collect()] == [(1.0, "img1", 9), (4.0, "img2", 9)]
    logs = tmp_path / "log"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"| defect{k} | {v} | 1 |\n" for k, v in [(1, 10.0), (2, 20.0), (3, 30.5), (1, 40.0), (2, 50.0), (3, 60.0)]))
    assert [(r["epoch"], r["miou"]) for r in documents.training_log(spark, str(logs)).orderBy("epoch").collect()] == [(0, 20.17), (1, 50.0)]


def test_binary_formats(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    r = documents.arrays(spark, str(tmp_path)).first()
    assert (r["shape"], r["values"]) == ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "hello")
    r = documents.zip_entries(spark, str(tmp_path)).first()
    assert (r["archive"], r["name"], bytes(r["content"])) == ("z", "d/a.txt", b"hello")
    assert "names:\n- car" in documents.dataset_yaml("/d", "t", "v", ["car"])


def test_box_functions(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(spark, boxes.iou(lit(0, 0, 2, 2), lit(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, boxes.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0
    back = boxes.corners_to_centre(boxes.centre_to_corners(lit(0.5, 0.4, 0.2, 0.1), 640, 480), 640, 480)
    assert [value(spark, c) for c in back] == pytest.approx([0.5, 0.4, 0.2, 0.1])
    assert not value(spark, boxes.overlaps(lit(0, 0, 1, 1), lit(1, 0, 2, 1))) and value(spark, boxes.overlaps(lit(0, 0, 1, 1), lit(1, 0, 2, 1), True))
    inside = boxes.relative(lit(0, 0, 10, 10), lit(5, 5, 9, 9))
    assert [value(spark, c) for c in inside] == [0.5, 0.5, 1.0, 1.0]


def test_polygon_functions(spark):
    square = F.array(*[F.lit(v) for v in (0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0)])
    assert value(spark, polygons.area(square)) == 4.0 and value(spark, polygons.box_area(square)) == 4.0
    assert value(spark, polygons.centre_box(F.array(F.lit(1.0)))) == [0.0] * 4
    assert value(spark, polygons.area(polygons.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), 360))) == pytest.approx(math.pi, abs=1e-3)
    cut = value(spark, polygons.clipped(square, F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(1.0)))
    assert sorted(zip(cut[::2], cut[1::2], strict=True)) == [(1.0, 0.0), (1.0, 1.0), (2.0, 0.0), (2.0, 1.0)]
    assert value(spark, polygons.clipped(square, F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(6.0))) == []


def test_text_functions(spark):
    s = F.lit
    assert value(spark, text.stem(s("/a/b/c.d.jpg"))) == "c.d" and value(spark, text.suffix(s("c.d.jpg"))) == ".jpg"
    assert value(spark, text.origin_of_copy(s("x_jpg.rf.123.jpg"))) == "x_jpg" and value(spark, text.with_folder(s("a.jpg"), s("f"))) == "a_f.jpg"
    assert tuple(value(spark, text.slice_parts(s("my_img_0_10_20_30")))) == ("my_img", 0, 10, 20, 30)
    assert value(spark, text.natural_key(s("a2b10"))) < value(spark, text.natural_key(s("a10b1")))
    assert value(spark, text.signed_degrees(s("30/15/36.0"), s("S"))) == pytest.approx(-30.26)
    assert value(spark, text.listed(s("['a', 'b']"))) == ["a", "b"] and value(spark, text.numbers_in_brackets(s("[1 2.5  3]"))) == [1.0, 2.5, 3.0]
    assert value(spark, text.binary_vector(s(5), 4)) == [0.0, 1.0, 0.0, 1.0] and value(spark, text.parity_route(s("DJI_0007_R.jpg"))) == "thermal"
    assert value(spark, text.thermal_name(s("DJI_0006_T.jpg"))) == "DJI_0007_R.jpg"


def test_geometry(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(spark, geometry.cosine(a, b)) == 0 and value(spark, geometry.distance(a, b)) == pytest.approx(5**0.5)
    assert value(spark, geometry.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, geometry.luminance(F.lit(255), F.lit(255), F.lit(255))) == pytest.approx(1.0)
    u, v = geometry.panorama_pixel(F.lit(1.0), F.lit(0.0), F.lit(0.0), 360, 180)
    assert (value(spark, u), value(spark, v)) == (180, 90)
    turned = geometry.rotated(F.lit(1.0), F.lit(0.0), F.lit(0.0), 0, 0, math.pi / 2)
    assert [value(spark, c) for c in turned] == pytest.approx([0, 1, 0], abs=1e-12)
    edges = geometry.box_edges(tuple(F.lit(0.0) for _ in "xyz"), tuple(F.lit(1.0) for _ in "xyz"), 3)
    assert value(spark, F.size(edges)) == 36


def test_label_rewrites(spark):
    df = spark.createDataFrame([("a", 0, 3, [0, 2, 1], 0.9), ("a", 1, 0, [0, 0, 0], 0.2), ("b", 0, 6, [], 0.8)], "image string, obj int, cls int, atts array<int>, conf double")
    assert [r["cls"] for r in labels.shift_class(df, -1, keep=[0]).orderBy("image", "obj").collect()] == [2, 0, 5]
    assert labels.remap_by_names(df, ["x", "y", "z", "w"], ["w", "x"]).orderBy("image", "obj").first()["cls"] == 0
    merged = labels.merge_attributes(df.where("cls = 3"), {1: 0}, [2]).first()["atts"]
    assert merged == [2]
    assert labels.set_level(df, 1, 2, 1).first()["atts"] == [0, 1, 1] and labels.zero_attributes(df, 6, 4).where("cls = 6").first()["atts"] == [0] * 4
    flagged = spark.createDataFrame([("b",)], "image string")
    assert labels.insert_attributes(df, 2, flagged, "image").where("image = 'b'").first()["atts"] == [0, 0]
    assert value(spark, labels.level_names(F.array(F.lit(1), F.lit(0)), [["no", "yes"], ["low", "high"]])) == ["yes", "low"]
    assert tuple(value(spark, labels.truthy(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1), F.lit("c"), F.lit(0))))) == ("a, b", 2)
    frames = spark.createDataFrame([("x", 5), ("x", 7), ("y", 1)], "file string, frame int")
    assert {tuple(r) for r in labels.rebased_frames(frames).collect()} == {("x", 0), ("x", 2), ("y", 1)}
    assert labels.near_point(spark.createDataFrame([(0.0, 0.0, 0.5), (2.0, 0.0, 0.0)], "x double, y double, z double"), (0, 0, 0), 1).count() == 1


def test_order_and_joins(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert {r["place"] == r["k"] for r in ordering.numbered(df, "k").collect()} == {True}
    assert ordering.numbered(df.limit(0), "k").count() == 0
    three = {r["split"]: r["count"] for r in ordering.three_way_split(df, "k", 0.8, 0.1).groupBy("split").count().collect()}
    assert three == {"train": 82, "test": 10, "val": 11}
    assert ordering.interval_of(0.9) == 10 and ordering.interval_of(0.9, exact=False) == 11
    assert ordering.without_places(df, "k", [0, 5]).count() == 101 and ordering.sample_distinct(df, ["k"], [F.col("k")], 10).count() == 10
    a = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0)], "ax double, ay double")
    b = spark.createDataFrame([(0.5, 0.5), (3.0, 0.0), (10.0, 9.2)], "bx double, by double")
    assert joins.within_radius(a, b, 1.0).count() == 2
    points = spark.createDataFrame([(1, 1, 5.0, "far"), (1, 1, 2.0, "near")], "u int, v int, d double, name string")
    assert joins.nearest_per_pixel(points, ["u", "v"], "d", ["name"]).first()["name"] == "near"
    assert tables.overflowing([df.limit(3), df], "k", 50).count() == 1
    once = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "k int, m int")
    assert sorted(r["k"] for r in joins.once_per_match(once, F.col("m"), F.col("k")).collect()) == [1, 3]


def test_pipelines(spark):
    rows = spark.createDataFrame([("a", 0, 1, [1, 0], 0.5, 0.5, 0.2, 0.2), ("a", 1, 2, [0, 0], 0.1, 0.1, 0.1, 0.1), ("b", 0, 1, [0, 0], 0.2, 0.3, 0.1, 0.4)], "image string, obj int, cls int, atts array<int>, cx double, cy double, w double, h double")
    images = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "image string, width int, height int")
    out = pipelines.label_stats(rows, images)
    assert {tuple(r) for r in out["categories"].collect()} == {(1, 2), (2, 1)} and tuple(out["images_with_attributes"].first()) == (2, 1, 1)
    assert sum(r["n"] for r in out["shape_rates"].collect()) == 3
    parts = [spark.createDataFrame([("x1", 0, "x", 1.0), ("x2", 0, "x", 2.0), ("y", 9, "y", 1.0)], "image string, cls int, origin string, mean double")] * 2
    assert sorted(r["image"] for r in pipelines.curated(parts, {0: 5}, [9], "origin", "mean").collect()) == ["0_x1", "1_x1"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:05", 2.0), (1, "2024-01-01 00:00:05", 2.0), (2, "2024-01-01 01:10:00", 4.0)], "user_id long, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = sensor.appended(sensor.scaled(sensor.once(stream, "ts", ["user_id", "ts"], "1 hour"), F.col("value"), 0.5), str(tmp_path / "log"), str(tmp_path / "state"), "user_id")
    query.awaitTermination()
    assert sorted((r["user_id"], r["scaled"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, 1.0), (2, 2.0)]
    windows = sensor.tumbling(stream, "ts", "1 hour", ["user_id"], "value", late="1 minute").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "w")).start()
    windows.awaitTermination()
    assert [(r["user_id"], r["n"]) for r in spark.table("w").collect()] == [(1, 2)]
    line = value(spark, sensor.parsed_log(F.lit("2024-01-01 10:00:00 3.5")))
    assert line["value"] == 3.5 and line["ts"].hour == 10
    assert value(spark, sensor.parsed_log(F.lit("broken")))["value"] is None
    assert sensor.polled(spark, 4).isStreaming


def test_statistics_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    assert [r["n"] for r in statistics.binned(df, F.col("v"), [0.0, 0.5, 1.0]).orderBy("bin").collect()] == [2, 1]
    assert statistics.auto_histogram(df.limit(0), F.col("v")).count() == 0
    zero = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 1.0)], "i string, j string, v double")
    assert {r["v"] for r in statistics.by_diagonal(zero).collect()} == {None}
