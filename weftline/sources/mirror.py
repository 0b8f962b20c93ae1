"""Copies of folders: changed files only, each under a temporary name until it is whole, and checked afterwards."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.rows import changed
from weftline.sources.tables import written

#: The folder in a mirror that says what its files were copied from, and bytes of one read.
NOTES, STEP = "_mirrored", 4 << 20
FILES = "name string, length long, modified timestamp"


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, path.rstrip("/")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """name (from the folder on), length and modified of all files of a folder, empty ones too; files and folders whose
    names begin with _ or a dot are not of it."""
    fs, base = _opened(path)
    info = fs.get_file_info(base)
    if info.type != pa.fs.FileType.Directory:
        raise NotADirectoryError(path)
    found = fs.get_file_info(pa.fs.FileSelector(base, recursive=True))
    rows = [(f.path[len(base) + 1 :], f.size, f.mtime) for f in found if f.type == pa.fs.FileType.File]
    rows = [r for r in rows if not any(p.startswith(("_", ".")) for p in r[0].split("/"))]
    return spark.createDataFrame(rows, FILES)


def _digest(fs: pa.fs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with fs.open_input_stream(path) as f:
        while part := f.read(STEP):
            h.update(part)
    return h.hexdigest()


def mirror(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Makes target hold what source holds; returns name, length and copied of all its files.

    Files are copied whose length or time of change is not the one that the mirror's notes have, or that the mirror lacks or
    has with another length. Tasks copy them in pieces, each under a name of its own that replaces the old file when it is
    whole: a run that is interrupted leaves old files as they were. Then every copy is read again and compared by SHA-256 with
    what was read from the source; only what agrees is noted, and what doesn't is an error. Files that source lacks stay.

    Paths are of file systems that pyarrow writes to, and that driver and executors see alike; copying onto itself does nothing."""
    if _opened(source)[1] == _opened(target)[1]:
        return listed(spark, source).select("name", "length", F.lit(False).alias("copied"))
    fs, base = _opened(target)
    fs.create_dir(base, recursive=True)
    files = written(listed(spark, source))
    there = listed(spark, target).select("name", F.col("length").alias("has"))
    noted = fs.get_file_info(f"{base}/{NOTES}").type == pa.fs.FileType.Directory
    notes = spark.read.schema(f"{FILES}, sha256 string").parquet(f"{target.rstrip('/')}/{NOTES}") if noted else spark.createDataFrame([], f"{FILES}, sha256 string")
    notes = written(notes.join(there, "name").where(F.col("length") == F.col("has")).drop("has"))
    todo = written(changed(files, notes, ["name", "length", "modified"]))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, from_), (b, to) = _opened(source), _opened(target)
        for batch in batches:
            sums, said = [], []
            for name in batch["name"].to_pylist():
                try:
                    sums.append(_copied(a, f"{from_}/{name}", b, f"{to}/{name}"))
                    said.append(None)
                except OSError as e:
                    sums.append(None)
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string()), pa.array(said, pa.string())], names=[*batch.schema.names, "sha256", "error"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, to = _opened(target)
        for batch in batches:
            same = [s is not None and _digest(b, f"{to}/{n}") == s for n, s in zip(batch["name"].to_pylist(), batch["sha256"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], names=[*batch.schema.names, "same"])

    dealt = todo.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, todo.count())), "name")
    copied = written(dealt.mapInArrow(copy, f"{FILES}, sha256 string, error string"))
    checked = written(copied.mapInArrow(check, f"{FILES}, sha256 string, error string, same boolean"))
    kept = changed(notes, checked, ["name"]).unionByName(checked.where("same").select("name", "length", "modified", "sha256"))
    fresh = f"{base}/{NOTES}-{uuid.uuid4().hex}"
    kept.write.parquet(f"{target.rstrip('/')}/{fresh.rsplit('/', 1)[1]}")
    if noted:
        fs.delete_dir(f"{base}/{NOTES}")
    fs.move(fresh, f"{base}/{NOTES}")
    if bad := checked.where("NOT same").orderBy("name").limit(3).collect():
        raise OSError("mirror incomplete: " + "; ".join(f"{r.name}: {r.error or 'differs from what was read'}" for r in bad))
    return files.join(checked.select("name", F.lit(True).alias("copied")), "name", "left").select("name", "length", F.coalesce("copied", F.lit(False)).alias("copied"))


def _copied(a: pa.fs.FileSystem, from_: str, b: pa.fs.FileSystem, to: str) -> str:
    """Copies a file by way of a temporary name; the digest of what was read."""
    folder, _, name = to.rpartition("/")
    b.create_dir(folder, recursive=True)
    part, h = f"{folder}/.{name}.{uuid.uuid4().hex}", hashlib.sha256()
    try:
        with a.open_input_stream(from_) as f, b.open_output_stream(part) as out:
            while piece := f.read(STEP):
                h.update(piece)
                out.write(piece)
        b.move(part, to)
    except BaseException:
        if b.get_file_info(part).type == pa.fs.FileType.File:
            b.delete_file(part)
        raise
    return h.hexdigest()
