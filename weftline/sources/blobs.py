"""Arrays of any shape in few large files, found by id and read by range."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.identity import value_id
from weftline.operators.rows import with_row_idx

#: Bytes after which a task begins another file.
PART = 256 << 20


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, path.rstrip("/")


class Blobs:
    """A folder with parts, in which blobs lie one after the other, and an index of id, part, offset, length and shape.

    What it was built from is kept as an identity of all ids and versions (such as paths and their times), in their order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.base = _opened(folder)

    def built_from(self) -> str | None:
        info = self.fs.get_file_info(f"{self.base}/_identity")
        return self.fs.open_input_stream(f"{self.base}/_identity").read().decode() if info.type == pa.fs.FileType.File else None

    def index(self) -> DataFrame:
        """id, part, offset (the sum of the lengths before it in its part), length, shape."""
        return self.spark.read.parquet(f"{self.folder}/index")

    def build(self, df: DataFrame, version: str | None = None) -> bool:
        """Writes the blobs of df (id, data, and shape, an array of longs, if there is one); whether that was needed.

        It is not if the store was built from the same ids and versions (a column of df) in the same order of rows, whatever
        the partitions. Ids are unique; a null blob has length null and no bytes. Each task writes its parts and says where its
        blobs lie; parts of tasks that failed are in no index and are deleted in the end. The old store stays until then."""
        own = df.select("id", "data", (F.col("shape") if "shape" in df.columns else F.array(F.octet_length("data"))).cast("array<long>").alias("shape"), value_id(F.col("id"), F.col(version) if version else F.octet_length("data")).alias("v"))
        own = with_row_idx(own, "at")
        # sums of hashes of rows with their places: the same for any partitions, another for another order
        sums = (F.sum(F.xxhash64(*x).cast("decimal(38,0)")).cast("string") for x in (("v", "at"), ("at", "v")))
        identity = own.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("i")).first().i
        if identity == self.built_from():
            return False
        generation = uuid.uuid4().hex
        kind = df.schema["id"].dataType.simpleString()
        folder, name = self.folder, generation

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _opened(folder)
            fs.create_dir(f"{base}/parts", recursive=True)
            out, part, at = None, "", 0
            try:
                for b in batches:
                    rows: list[tuple] = []
                    for data in b["data"]:
                        if out is None or at >= PART:
                            if out is not None:
                                out.close()
                            part, at = f"{name}-{uuid.uuid4().hex}", 0
                            out = fs.open_output_stream(f"{base}/parts/{part}")
                        buf = data.as_buffer() if data.is_valid else None
                        rows.append((part, at, None if buf is None else buf.size))
                        if buf is not None:
                            out.write(buf)
                            at += buf.size
                    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                    yield pa.RecordBatch.from_arrays([b["id"], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), b["shape"]], names=["id", "part", "offset", "length", "shape"])
            finally:
                if out is not None:
                    out.close()

        made = own.select("id", "data", "shape").mapInArrow(write, f"id {kind}, part string, offset long, length long, shape array<long>")
        made.write.parquet(f"{self.folder}/index-{generation}")
        if self.fs.get_file_info(f"{self.base}/index").type == pa.fs.FileType.Directory:
            self.fs.delete_dir(f"{self.base}/index")
        self.fs.move(f"{self.base}/index-{generation}", f"{self.base}/index")
        with self.fs.open_output_stream(f"{self.base}/_identity") as f:
            f.write(identity.encode())
        used = {r.part for r in self.index().select("part").distinct().collect()}  # a name for each part of PART bytes
        for f in self.fs.get_file_info(pa.fs.FileSelector(f"{self.base}/parts", allow_not_found=True)):
            if f.base_name not in used:
                self.fs.delete_file(f.path)
        return True

    def fetch(self, ids: DataFrame) -> DataFrame:
        """id, data and shape of the ids (a column id) that the store has: each part is opened once by a task and read by
        range, in the order of offsets."""
        found = self.index().join(ids.select("id").distinct(), "id").repartition("part").sortWithinPartitions("part", "offset")
        kind, folder = found.schema["id"].dataType.simpleString(), self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _opened(folder)
            part, f = None, None
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    some, data = b.slice(k, 64), []
                    for name, at, n in zip(some["part"].to_pylist(), some["offset"].to_pylist(), some["length"].to_pylist(), strict=True):
                        if name != part:
                            part, f = name, fs.open_input_file(f"{base}/parts/{name}")
                        data.append(None if n is None else f.read_at(n, at))
                    yield pa.RecordBatch.from_arrays([some["id"], pa.array(data, pa.binary()), some["shape"]], names=["id", "data", "shape"])

        return found.mapInArrow(read, f"id {kind}, data binary, shape array<long>")
