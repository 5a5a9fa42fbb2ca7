"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import io as IO


def test_raw_snapshots_keep_unreadable_files(spark, tmp_path):
    for item, source, text in (("1", "douban", '{"a":1}'), ("1", "tmdb", "{bad"), ("2", "douban", "")):
        (tmp_path / item).mkdir(exist_ok=True)
        (tmp_path / item / f"{source}.json").write_text(text)
    got = sorted((r.item_id, r.source, r.valid) for r in IO.read_raw_snapshots(spark, str(tmp_path)).collect())
    assert ("1", "douban", True) in got and ("1", "tmdb", False) in got


def test_staging_id_must_be_the_file_s(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps({"id": "7"}))
    (tmp_path / "8.json").write_text(json.dumps({"id": "9"}))
    assert [r.id for r in IO.read_staging(spark, str(tmp_path)).collect()] == ["7"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"items": [{"bookId": "1", "title": "a"}, {"bookId": "2", "title": "b"}]}))
    assert [(r.position, r.bookId) for r in IO.read_manifest(spark, str(path), only=["2"]).collect()] == [(2, "2")]
    path.write_text(json.dumps({"items": []}))
    with pytest.raises(Exception, match="without items"):
        IO.read_manifest(spark, str(path)).collect()


def test_title_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n\n One \n")
    (tmp_path / "b.json").write_text(json.dumps({"titles": ["Two"]}))
    (tmp_path / "c.json").write_text(json.dumps(["Three"]))
    assert {r.title for r in IO.read_title_list(spark, str(tmp_path)).collect()} == {"One", "Two", "Three"}


def test_labelled_reviews_and_csv(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('1\tgood "film"\n0\tbad\n')
    assert [(r.label, r.text) for r in IO.read_labelled_reviews(spark, str(tmp_path / "r.tsv")).collect()] == [(1, 'good "film"'), (0, "bad")]
    IO.export_csv(spark.createDataFrame([("2", "draft"), ("1", "published")], "id string, status string"), str(tmp_path / "out"), ["id", "status"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert text.startswith("﻿id,status") and "1,published" in text and "draft" not in text


def test_snapshot_round_trip(spark, tmp_path):
    t = {"x": spark.range(3)}
    IO.snapshot_tables(t, str(tmp_path / "s"))
    assert IO.restore_tables(spark, str(tmp_path / "s"), t)["x"].count() == 3
    with pytest.raises(ValueError):
        IO.restore_tables(spark, str(tmp_path / "s"), {"x": spark.range(4)})


def test_catalog_reads_fixed_schemas(spark, tmp_path):
    spark.createDataFrame([("0101000001", "t")], "id string, title string").write.json(str(tmp_path / "works"))
    works = IO.read_catalog(spark, str(tmp_path), "json", ("works",))["works"]
    assert dict(works.dtypes)["year"] == "int" and works.first().id == "0101000001"


def test_json_columns_fall_back(spark):
    df = spark.createDataFrame([('["a"]',), ("",), ("{x",), (None,)], "c string")
    out = IO.parse_json_columns(df, {"c": ("array<string>", F.array())})
    assert [r.c for r in out.collect()] == [["a"], [], [], []]
