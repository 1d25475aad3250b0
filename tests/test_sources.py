"""Sources on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.sources import files


def test_manifests(spark, tmp_path):
    image = lambda i: {"image_id": i, "path": f"{i}.png"}
    good = {"document_id": "doc-1", "images": [image("a"), image("b")], "ordered_image_ids": ["b", "a"]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    m = files.manifests(spark, str(tmp_path / "good.json"))
    assert m.first()["lang"] == "zh-CN"
    assert [r["image_id"] for r in files.ordered_images(m).orderBy("image_ord").collect()] == ["b", "a"]
    for order, fault in (([], "EMPTY_ORDER"), (["a", "a"], "DUPLICATE_ORDER"), (["z"], "UNKNOWN_IMAGE")):
        (tmp_path / "bad.json").write_text(json.dumps(good | {"ordered_image_ids": order}))
        assert files.manifests(spark, str(tmp_path / "bad.json")).first()["fault"] == fault
    (tmp_path / "odd.json").write_text(json.dumps(good | {"more": 1}))
    with pytest.raises(Exception, match="unknown keys"):
        files.manifests(spark, str(tmp_path / "odd.json")).collect()


def test_event_frames(spark):
    body = "id: 1\nevent: a\ndata: x\ndata: y\n\n: note\n\ndata: z\n\n"
    got = files.event_frames(spark.createDataFrame([("s", body)], "stream string, body string")).orderBy("frame").collect()
    assert [(r["id"], r["event"], r["data"]) for r in got] == [("1", "a", "x\ny"), (None, None, "z")]


def test_text_functions(spark):
    row = spark.createDataFrame([("KV cache size: 1,000 tokens\nKV cache size: 17,788 tokens", "a　b\x1c c", "x ```` y")], "log string, t string, c string")
    got = row.select(T.last_capacity(F.col("log")), T.stripped(F.col("t")), T.fence(F.col("c")), T.last_capacity(F.lit("none"))).first()
    assert tuple(got) == (17788, "abc", "`````", None)
    w, h = T.target_size(F.lit(4032), F.lit(3024), 1280)
    assert tuple(row.select(w, h, T.sample_size(F.lit(4032), F.lit(3024), 1280), T.image_tokens(F.lit(1), F.lit(60), F.lit(80), 2)).first()) == (1280, 960, 2, 1200)
    with pytest.raises(Exception, match="divisible"):
        row.select(T.image_tokens(F.lit(1), F.lit(61), F.lit(81), 2)).collect()


def test_imported_text(spark):
    images = spark.createDataFrame([("d", "a", "h1")], "document_id string, image_id string, sha256 string")
    earlier = spark.createDataFrame([("d", "a", "h1", "text", True, 1)], "document_id string, image_id string, sha256 string, content string, complete boolean, attempts int")
    assert files.imported_ocr(images, earlier).first()["content"] == "text"
    with pytest.raises(Exception, match="another image"):
        files.imported_ocr(images, earlier.withColumn("sha256", F.lit("h2"))).collect()
