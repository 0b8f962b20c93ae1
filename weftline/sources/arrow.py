"""Data sets kept as folders of Arrow files, read and written in parts, each file by its own task."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: What tells a folder of Arrow files: its splits, its files, and what its rows are.
SPLITS, STATE, INFO = "dataset_dict.json", "state.json", "dataset_info.json"
ROWS = 8192


@dataclass(frozen=True)
class Part:
    """A file of a split, and its place among the split's files."""

    split: str
    place: int
    path: str


class Folder:
    """A data set's folder in any file system that Spark's Hadoop client reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.fs.exists(self.jpath(f"{self.path}/{name}"))

    def read(self, name: str) -> dict:
        return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(self.fs.open(self.jpath(f"{self.path}/{name}")))))

    def parts(self) -> list[Part]:
        """The files in order: of the splits as the data set names them, or of one split without a name."""
        splits = self.read(SPLITS)["splits"] if self.has(SPLITS) else [""]
        out = []
        for split in splits:
            under = f"{split}/" if split else ""
            if not self.has(f"{under}{STATE}"):
                raise ValueError(f"{self.path}/{under}{STATE} is missing: not a folder of Arrow files")
            if (files := self.read(f"{under}{STATE}").get("_data_files")) is None:
                raise ValueError(f"{self.path}/{under}{STATE} names no files")
            out += [Part(split, k, f"{self.path}/{under}{f['filename']}") for k, f in enumerate(files)]
        return out


def is_arrow_folder(spark: SparkSession, path: str) -> bool:
    f = Folder(spark, path)
    return any(f.has(n) for n in (SPLITS, STATE, INFO))


def _opened(buf: pa.Buffer) -> pa.ipc.RecordBatchStreamReader | pa.ipc.RecordBatchFileReader:
    """A stream or file of record batches."""
    return pa.ipc.open_file(buf) if buf[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buf)


def _batches(data: pa.Buffer) -> Iterator[pa.RecordBatch]:
    reader = _opened(data)
    many = (reader.get_batch(k) for k in range(reader.num_record_batches)) if isinstance(reader, pa.ipc.RecordBatchFileReader) else reader
    for b in many:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type that Spark has for an Arrow one."""
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_large_list(kind) or pa.types.is_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(_plain(kind.key_type), _plain(kind.item_type))
    if pa.types.is_unsigned_integer(kind):  # Spark has signed ones only
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
    return {pa.large_string(): pa.string(), pa.large_binary(): pa.binary(), pa.float16(): pa.float32(), pa.null(): pa.string()}.get(kind, kind)


def read_arrow(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """split, place (of the file), row_index (of its rows, from 0) and the columns of a data set's Arrow files.

    split picks one of several; one that isn't there is an error. Spark reads each file as it lies, in its own task; the
    schema is that of the first file. A task holds one file, which is how such data sets are cut (half a GB)."""
    parts = Folder(spark, path).parts()
    named = [p for p in parts if split is None or p.split == split]
    if not named:
        raise ValueError(f"{path} has no split {split}" if parts else f"{path} has no Arrow files")
    raw = spark.read.format("binaryFile").load([p.path for p in named]).select("path", "content")
    first = spark.read.format("binaryFile").load(named[0].path).select("content")
    said = lambda bs: (pa.RecordBatch.from_pydict({"s": [_opened(c.as_buffer()).schema.serialize().to_pybytes()]}) for b in bs for c in b["content"])
    schema = pa.ipc.read_schema(pa.py_buffer(first.mapInArrow(said, "s binary").first().s))
    schema = pa.schema([pa.field(f.name, _plain(f.type)) for f in schema])
    known = {(p.split, p.path.rsplit("/", 1)[-1]): p.place for p in named}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                *_, under, name = where.split("/")
                own, at = under if (under, name) in known else "", 0
                place = known[own, name]
                for part in _batches(content.as_buffer()):
                    n = part.num_rows
                    columns = [part[f.name].cast(f.type) if f.name in part.schema.names else pa.nulls(n, f.type) for f in schema]
                    index = pa.array(range(at, at + n), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([own] * n), pa.array([place] * n, pa.int32()), index, *columns], names=["split", "place", "row_index", *schema.names])
                    at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(schema).fields)
    return raw.mapInArrow(run, f"split string, place int, row_index long, {fields}")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its number, the file's name and how many rows it has."""

    part: int
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Writes a task's batches as one Arrow stream under a name of its own; commit gives the files their names, in the order of
    the tasks, and then writes what describes the data set. An aborted write leaves nothing."""

    def __init__(self, path: str, split: str, schema: StructType):
        self.path, self.split, self.schema = path.rstrip("/"), split, schema
        self.under = f"{self.path}/{split}" if split else self.path

    def _at(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.under if "://" in self.under else f"file://{self.under}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = self._at()
        fs.create_dir(base, recursive=True)
        part, rows, name = TaskContext.get().partitionId(), 0, f"part-{uuid.uuid4().hex}"
        kind = to_arrow_schema(self.schema)
        with fs.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_stream(sink, kind) as out:
            for b in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind, strict=True)], schema=kind))
                rows += b.num_rows
        return Written(part, name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._at()
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        full = [m for m in done if m.rows] or done[:1]  # a data set without rows has one file for its schema
        for m in done:
            if m not in full:
                fs.delete_file(f"{base}/{m.name}")
        names = [f"data-{k:05}-of-{len(full):05}.arrow" for k in range(len(full))]
        for m, name in zip(full, names, strict=True):
            fs.move(f"{base}/{m.name}", f"{base}/{name}")

        def put(path: str, value: dict) -> None:
            with fs.open_output_stream(path) as out:
                out.write(json.dumps(value).encode())

        put(f"{base}/{INFO}", {})
        put(f"{base}/{STATE}", {"_data_files": [{"filename": n} for n in names], "_split": self.split or None})
        if self.split:
            root = base[: -len(self.split) - 1]
            known = fs.get_file_info(f"{root}/{SPLITS}").type == pa.fs.FileType.File
            splits = json.loads(fs.open_input_stream(f"{root}/{SPLITS}").read())["splits"] if known else []
            put(f"{root}/{SPLITS}", {"splits": [*splits, *([] if self.split in splits else [self.split])]})

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._at()
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{m.name}")


class ArrowFolder(DataSource):
    """The format of write_arrow."""

    @classmethod
    def name(cls) -> str:
        return "weftline_arrow"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("split", ""), schema)


def write_arrow(df: DataFrame, path: str, split: str = "") -> None:
    """df as a folder of Arrow files, or as a split of one: a file for each partition that has rows, written by its task.
    path: of a file system that pyarrow writes to (local, HDFS, S3 and the like). A folder of that name is an error."""
    spark = df.sparkSession
    if Folder(spark, f"{path}/{split}" if split else path).has(STATE):
        raise FileExistsError(f"{path}/{split}")
    spark.dataSource.register(ArrowFolder)
    df.write.format(ArrowFolder.name()).mode("append").option("split", split).save(path)


def parquet_to_arrow(spark: SparkSession, source: str, path: str) -> None:
    """A folder of Parquet files as one of Arrow files."""
    write_arrow(spark.read.parquet(source), path)
