"""Folders of Arrow files, as written here and as laid down by hand."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.ipc
import pytest
from pyspark.sql import functions as F

from weftline.sources import arrow, files


def laid_down(folder, split, tables, kind="stream"):
    under = folder / split if split else folder
    under.mkdir(parents=True, exist_ok=True)
    names = [f"data-{k:05}-of-{len(tables):05}.arrow" for k in range(len(tables))]
    for name, t in zip(names, tables, strict=True):
        with pa.OSFile(str(under / name), "wb") as f, (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(f, t.schema) as out:
            out.write_table(t, max_chunksize=7)
    (under / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": split or None}))
    (under / "dataset_info.json").write_text("{}")


def made(a, z):
    return pa.table({"id": pa.array(range(a, z), pa.int64()), "text": [f"é{k}" if k % 3 else None for k in range(a, z)], "tags": pa.array([[k, None] for k in range(a, z)], pa.large_list(pa.int32())), "u": pa.array(range(a, z), pa.uint32()), "kind": pa.array(["x"] * (z - a)).dictionary_encode(), "m": [{"role": "user", "n": k} for k in range(a, z)]})


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_reading_splits(spark, tmp_path, kind):
    laid_down(tmp_path / "d", "train", [made(0, 20), made(20, 30)], kind)
    laid_down(tmp_path / "d", "test", [made(100, 103)], kind)
    (tmp_path / "d" / "dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    rows = arrow.read_arrow(spark, str(tmp_path / "d"))
    got = sorted((r.split, r.place, r.row_index, r.id, r.text, r.tags, r.u, r.kind, r.m.n) for r in rows.collect())
    want = [("test", 0, k, 100 + k) for k in range(3)] + [("train", 0, k, k) for k in range(20)] + [("train", 1, k, 20 + k) for k in range(10)]
    assert got == [(*w, f"é{w[3]}" if w[3] % 3 else None, [w[3], None], w[3], "x", w[3]) for w in want]
    assert arrow.read_arrow(spark, str(tmp_path / "d"), "test").count() == 3
    with pytest.raises(ValueError, match="no split"):
        arrow.read_arrow(spark, str(tmp_path / "d"), "other")
    data = files.load_data(spark, str(tmp_path / "d")).select("source", "row_index", F.variant_get("row", "$.id", "int").alias("id")).collect()
    by = {}
    for r in data:
        by.setdefault(r.source, []).append((r.row_index, r.id))
    assert sorted(r.row_index for r in data) == list(range(33))
    assert all([i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by.values()) and set(by) == {"train", "test"}


def test_what_is_written_is_read_again(spark, tmp_path):
    rows = [(k, None if k % 4 == 0 else f"t{k}", [1.5, None], {"a": k}, dt.date(2024, 1, 1 + k % 20), (k, ["x"])) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, v array<double>, m map<string,long>, d date, s struct<a:int,b:array<string>>").repartition(3)
    arrow.write_arrow(df, str(tmp_path / "out"))
    state = json.loads((tmp_path / "out" / "state.json").read_text())
    names = [f["filename"] for f in state["_data_files"]]
    assert names == [f"data-{k:05}-of-{len(names):05}.arrow" for k in range(len(names))] and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted([*names, "state.json", "dataset_info.json"])
    back = arrow.read_arrow(spark, str(tmp_path / "out")).drop("split", "place", "row_index")
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileExistsError):
        arrow.write_arrow(df, str(tmp_path / "out"))


def test_splits_are_added(spark, tmp_path):
    df = spark.range(5).select("id", F.lit("a").alias("t"))
    for split in ("train", "test"):
        arrow.write_arrow(df.where(F.col("id") < (5 if split == "train" else 0)), str(tmp_path / "out"), split)
    assert json.loads((tmp_path / "out" / "dataset_dict.json").read_text()) == {"splits": ["train", "test"]}
    rows = arrow.read_arrow(spark, str(tmp_path / "out"))
    assert sorted((r.split, r.id) for r in rows.collect()) == [("train", k) for k in range(5)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        arrow.write_arrow(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "state.json").exists()


def test_parquet_becomes_arrow(spark, tmp_path):
    spark.range(50).selectExpr("id", "CAST(id AS STRING) AS t").write.parquet(str(tmp_path / "p"))
    arrow.parquet_to_arrow(spark, str(tmp_path / "p"), str(tmp_path / "a"))
    assert sorted(r.id for r in arrow.read_arrow(spark, str(tmp_path / "a")).collect()) == list(range(50))


def test_no_folder_of_arrow_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert not arrow.is_arrow_folder(spark, str(tmp_path))
    with pytest.raises(ValueError, match="not a folder of Arrow files"):
        arrow.read_arrow(spark, str(tmp_path))
