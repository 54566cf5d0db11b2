"""Raw row-major float32 matrices as a data source, ``matrix``: byte ranges are read by many tasks, and a write is all or nothing.

A matrix is one headerless file, or a folder whose files in the order of their names, one after another, are the matrix.
Rows are (id, vec) with ids that count up from ``first_id``. Options: ``path``, ``width``, ``first_id`` (1) and ``task_rows``
(about 32 MB of them by default). Paths go through Arrow's file systems, so any that it knows by URI will do.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").option("width", 768).load(path)
    df.repartitionByRange(n, "id").sortWithinPartitions("id").write.format("matrix").option("width", 768).mode("append").save(path)

A writing task puts its rows in a hidden file of the folder. The commit checks that the ids of all tasks are one run without gaps,
repeats or overlaps, and gives the files names in the order of their ids; where it finds otherwise, or a task fails, the hidden
files go. Rows never pass through the driver, only each task's first id and count."""

from __future__ import annotations

import itertools
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

TASK_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
HIDDEN = ("_", ".")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a matrix, in order."""
    where, root = place(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = where.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(HIDDEN))


@dataclass
class Range(InputPartition):
    """Rows of one file: from ``row`` on ``rows`` of them, the first with the id ``first``."""

    file: str
    row: int
    rows: int
    first: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width, self.first = options["path"], int(options["width"]), int(options.get("first_id", 1))
        self.task_rows = int(options.get("task_rows", max(1, TASK_BYTES // (4 * self.width))))

    def partitions(self) -> list[Range]:
        out, first = [], self.first
        for file, size in files_of(self.path):
            if size % (4 * self.width):
                raise ValueError(f"{file} is not a whole number of rows of {self.width} floats")
            rows = size // (4 * self.width)
            out += [Range(file, a, min(self.task_rows, rows - a), first + a) for a in range(0, rows, self.task_rows)]
            first += rows
        return out or [Range("", 0, 0, self.first)]

    def read(self, part: Range):
        if not part.rows:
            return
        where, _ = place(self.path)
        step = max(1, BATCH_BYTES // (4 * self.width))
        with where.open_input_file(part.file) as f:
            for a in range(0, part.rows, step):
                n = min(step, part.rows - a)
                f.seek((part.row + a) * 4 * self.width)
                raw = f.read(n * 4 * self.width)
                if len(raw) != n * 4 * self.width:
                    raise ValueError(f"{part.file} became shorter while it was read")
                values = pa.array(np.frombuffer(raw, "<f4"))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
                ids = pa.array(np.arange(n, dtype=np.int64) + part.first + a)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, values)], names=["id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int
    rows: int


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("a matrix is never replaced: write to a new folder, in mode append")
        self.path, self.width = options["path"], int(options["width"])

    def write(self, batches) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        file, first, rows = posixpath.join(root, f"_writing-{uuid.uuid4().hex}"), 0, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vec = batch.column("id"), batch.column("vec")
            if ids.null_count or vec.null_count:
                raise ValueError("an id or a vector is null")
            ids = ids.to_numpy(zero_copy_only=False)
            values = vec.flatten()
            if values.null_count or set(np.diff(vec.offsets.to_numpy())) != {self.width}:
                raise ValueError(f"a vector has not {self.width} numbers")
            if out is None:
                first, out = int(ids[0]), where.open_output_stream(file)
            if not np.array_equal(ids, np.arange(len(ids)) + first + rows):
                raise ValueError("ids of a task have to count up one by one: repartitionByRange and sortWithinPartitions")
            out.write(np.ascontiguousarray(values.to_numpy(zero_copy_only=False), "<f4").tobytes())
            rows += len(ids)
        if out is not None:
            out.close()
        return Written(file, first, rows)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        before = files_of(self.path) if where.get_file_info(root).type == fs.FileType.Directory else []
        if before:
            self.abort(messages)
            raise ValueError(f"{self.path} holds a matrix already")
        for one, two in itertools.pairwise(parts):
            if one.first + one.rows != two.first:
                self.abort(messages)
                raise ValueError(f"ids are not one run: {one.first + one.rows} should follow, {two.first} does")
        for k, m in enumerate(parts):
            where.move(m.file, posixpath.join(root, f"part-{k:08d}"))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Hidden files of tasks that failed or ran twice go."""
        where, root = place(self.path)
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("_writing-"):
                where.delete_file(f.path)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def read_matrix(spark: SparkSession, path: str, width: int, first_id: int = 1, task_rows: int | None = None) -> DataFrame:
    """(id, vec) of a matrix. Every file has to be a whole number of rows."""
    for file, size in files_of(path):
        if size % (4 * width):
            raise ValueError(f"{file} is not a whole number of rows of {width} floats")
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("width", width).option("first_id", first_id)
    return (reader.option("task_rows", task_rows) if task_rows else reader).load(path)


def write_matrix(df: DataFrame, path: str, width: int, id: str = "id", vec: str = "vec", files: int | None = None) -> None:
    """The vectors of df in the order of their ids, which have to be one run of integers, as a folder of files; how many
    is left to adaptive execution unless it is given."""
    df.sparkSession.dataSource.register(MatrixSource)
    rows = df.select(df[id].cast("long").alias("id"), df[vec].cast("array<float>").alias("vec"))
    dealt = rows.repartitionByRange(files, "id") if files else rows.repartitionByRange("id")
    dealt.sortWithinPartitions("id").write.format("matrix").option("width", width).mode("append").save(path)
