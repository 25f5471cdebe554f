"""File readers on tiny files: S1 S2 S3 S4 S5 S6 S8 S9 S10 J2 P1."""

import json

from gridspark.operators.tables import manifest_join
from gridspark.sources import readers as R


def test_annotations(spark, tmp_path):
    grid = [[0] * 9 for _ in range(9)]
    grid[0][0], grid[0][1], grid[8][8] = 5, [1, 7], [0, 3]
    lattice = [[float(j), float(i)] for i in range(4) for j in range(4)]
    doc = {"images": [{"path": "x/a.jpeg", "corners_16": lattice, "grid": grid}, {"path": "x/b.jpeg", "corners_16": lattice, "grid": grid}]}
    (tmp_path / "gt.json").write_text(json.dumps(doc, indent=2))
    rows = R.read_annotations(spark, str(tmp_path / "gt.json")).orderBy("path").collect()
    assert [r["path"] for r in rows] == ["x/a.jpeg", "x/b.jpeg"]
    cells = rows[0]["cells"]
    assert len(cells) == 81 and cells[0] == [5] and cells[1] == [1, 7] and cells[2] == [0] and cells[80] == [0, 3]
    assert [(p["x"], p["y"]) for p in rows[0]["outer"]] == [(0, 0), (3, 0), (3, 3), (0, 3)]


def test_label_files(spark, tmp_path):
    rows = "\n".join(" ".join(str((i + j) % 10) for j in range(9)) for i in range(9))
    (tmp_path / "image1.dat").write_text("phone one\n3264x2448: 24 JPG\n" + rows + "\n")
    (tmp_path / "image2.dat").write_text("phone two\r\n640x480:24 PNG\r\n1 2 3\r\nx 2 3 4 5 6 7 8 9\r\n1 2 3 4 5 6 7 8 9\r\n")
    (tmp_path / "image3.dat").write_text("\n")
    (tmp_path / "note.txt").write_text("no")
    got = {r["stem"]: r for r in R.read_label_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["image1", "image2", "image3"]
    one, two, three = (got[f"image{i}"] for i in (1, 2, 3))
    assert (one.phone, one.resolution, one.depth, one.filetype) == ("phone one", "3264x2448", "24", "JPG")
    assert one.grid[2] == [2, 3, 4, 5, 6, 7, 8, 9, 0] and len(one.grid) == 9
    assert two.resolution == "640x480" and two.filetype == "PNG"
    assert two.grid[0] == [1, 2, 3, 4, 5, 6, 7, 8, 9] and two.grid[1:] == [[0] * 9] * 8
    assert three.phone == "" and three.grid == [[0] * 9] * 9


def test_manifest_join(spark, tmp_path):
    (tmp_path / "m.desc").write_text("images/image1.jpg\n\n  \nimages/image2.jpg\n")
    manifest = R.read_manifest(spark, str(tmp_path / "m.desc"))
    assert sorted(tuple(r) for r in manifest.collect()) == [("image1.jpg", "image1"), ("image2.jpg", "image2")]
    images = spark.createDataFrame([("image1", 10), ("image2", 20)], "stem string, size int")
    labels = spark.createDataFrame([("image2", "p")], "stem string, phone string")
    assert [r["stem"] for r in manifest_join(manifest, images, labels).collect()] == ["image2"]


def test_outlines(spark, tmp_path):
    (tmp_path / "o.csv").write_text(
        "filepath,p1_x,p1_y,p2_x,p2_y,p3_x,p3_y,p4_x,p4_y\n"
        "./d/a.jpg,0,0,1,0,1,1,0,1\n./d/b.jpg,0,0,x,0,1,1,0,1\n./d/a.jpg,5,5,6,5,6,6,5.5,6\n./d/c.jpg,1,2\n"
    )
    got = {r["name"]: r["outline"] for r in R.read_outlines(spark, str(tmp_path / "o.csv")).collect()}
    assert list(got) == ["a.jpg"] and (got["a.jpg"][0]["x"], got["a.jpg"][3]["x"]) == (5.0, 5.5)


def test_scans(spark, tmp_path):
    for name in ("b.JPG", "a.jpeg", "c.webp", "d.txt", "e.png"):
        (tmp_path / name).write_bytes(b"xyz")
    got = R.scan_images(spark, str(tmp_path))
    assert sorted(r["name"] for r in got.collect()) == ["a.jpeg", "b.JPG", "c.webp", "e.png"]
    assert "content" not in got.columns
    root = tmp_path / "fonts"
    for sample, name in (("Sample001", "img001-00001.png"), ("Sample002", "img002-00001.png"), ("Sample010", "img010-00042.png"), ("Sample003", "bad.png")):
        (root / sample).mkdir(parents=True, exist_ok=True)
        (root / sample / name).write_bytes(b"x")
    rows = sorted((r["digit"], r["group_id"]) for r in R.scan_labelled_dirs(spark, str(root)).collect())
    assert rows == [(1, 1), (9, 42)]


def test_experiments_and_history(spark, tmp_path):
    doc = {"protocol": {"epochs": 20}, "results": [
        {"name": "a", "depth": 3, "channels": [32, 64], "dropout": 0.3, "parameters": 7, "real_filled_acc": 0.5},
        {"name": "b", "depth": 4, "channels": [16], "dropout": 0.3, "parameters": 9, "real_filled_acc": 0.6},
    ]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    rows = R.read_experiments(spark, str(tmp_path / "r.json")).orderBy("name").collect()
    assert [(r["name"], r["channels"][0], r["real_filled_acc"]) for r in rows] == [("a", 32, 0.5), ("b", 16, 0.6)]
    hist = {"best_epoch": 2, "history": {"train_loss": [1.0, 0.5], "train_acc": [0.1, 0.2], "val_loss": [1.1, 0.6], "val_acc": [0.3, 0.4], "lr": [0.01, 0.005]}}
    (tmp_path / "h.json").write_text(json.dumps(hist, indent=1))
    epochs = R.history_long(spark, str(tmp_path / "h.json")).orderBy("epoch").collect()
    assert [(r["run"], r["epoch"], r["val_acc"], r["lr"]) for r in epochs] == [("h", 1, 0.3, 0.01), ("h", 2, 0.4, 0.005)]


def test_quarantine(spark):
    good, bad = R.split_valid(spark.createDataFrame([(1, [[0] * 9] * 9), (2, [[0] * 9] * 8)], "id int, grid array<array<int>>"))
    assert [r["id"] for r in good.collect()] == [1]
    assert [(r["id"], r["error"]) for r in bad.collect()] == [(2, "Grid must have exactly 9 rows")]
