"""Binary pair and run files, as a Python data source.

A pair file is little-endian ``int32 key, int32 value`` without a header; a run
file adds ``int32 metadata`` (0 put, 1 delete). What is left after the last whole
record is ignored. Splits lie on record bounds, batches are numpy views, and
``seq`` is a record's place, so the last of a key's records is the newest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PAIRS, RUN = "pairs", "run"
_FIELDS = {PAIRS: ("key", "value"), RUN: ("key", "value", "metadata")}
#: Bytes of a split, and records of a batch.
SPLIT = 64 << 20
BATCH = 1 << 20


def _at(path: str):
    """The file system that a path names, by its scheme, and the path within."""
    import pyarrow.fs as fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def files_of(path: str) -> list[tuple[str, int]]:
    """Files under ``path`` and their sizes, in order of their names."""
    import pyarrow.fs as fs

    where, inner = _at(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"Could not read from file {path}")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(inner))
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")


def _open(path: str):
    where, inner = _at(path)
    return where.open_input_file(inner)


class _Split(InputPartition):
    def __init__(self, path: str, offset: int, records: int, seq: int) -> None:
        self.path, self.offset, self.records, self.seq = path, offset, records, seq


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: str) -> None:
        self.path, self.width, self.layout = path, 4 * len(_FIELDS[layout]), layout

    def partitions(self) -> list[_Split]:
        out, seq, each = [], 0, SPLIT // self.width
        for path, size in files_of(self.path):
            n = size // self.width
            out += [_Split(path, k * self.width, min(each, n - k), seq + k) for k in range(0, n, each)]
            seq += n
        return out or [_Split("", 0, 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.records:
            return
        names = _FIELDS[self.layout]
        with _open(split.path) as f:
            for k in range(0, split.records, BATCH):
                n = min(BATCH, split.records - k)
                rows = np.frombuffer(f.read_at(n * self.width, split.offset + k * self.width), "<i4").reshape(n, len(names))
                seq = np.arange(split.seq + k, split.seq + k + n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seq), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(len(names)))], names=["seq", *names])


class _Message(WriterCommitMessage):
    def __init__(self, path: str, final: str) -> None:
        self.path, self.final = path, final


class _Writer(DataSourceArrowWriter):
    """A file per partition; the names follow the partitions, so files of a
    sorted table are in its order. Files get their names at the commit."""

    def __init__(self, path: str, layout: str) -> None:
        self.path, self.layout = path.rstrip("/"), layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, inner = _at(self.path)
        where.create_dir(inner, recursive=True)
        final = f"part-{context.partitionId():06d}.bin"
        own = f"_part-{context.partitionId():06d}-{context.taskAttemptId()}"
        with where.open_output_stream(f"{inner}/{own}") as f:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _FIELDS[self.layout]]
                f.write(np.stack(columns, 1).astype("<i4").tobytes())
        return _Message(own, final)

    def commit(self, messages: list) -> None:
        where, inner = _at(self.path)
        for m in messages:
            where.move(f"{inner}/{m.path}", f"{inner}/{m.final}")

    def abort(self, messages: list) -> None:
        where, inner = _at(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{inner}/{m.path}")


class RecordFiles(DataSource):
    """Options: ``path``, and ``layout``: ``pairs`` (default) or ``run``. Paths name
    what driver and executors both reach, on any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "tideline_records"

    def _layout(self) -> str:
        layout = self.options.get("layout", PAIRS)
        if layout not in _FIELDS:
            raise ValueError(f"layout must be one of {', '.join(_FIELDS)}: {layout}")
        return layout

    def schema(self) -> str:
        return "seq long, " + ", ".join(f"{c} int" for c in _FIELDS[self._layout()])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._layout())

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        missing = set(_FIELDS[self._layout()]) - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], self._layout())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``seq, key, value`` of a pair file, or of a folder of them by name."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("tideline_records").option("path", path).load()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``key, is_delete, value`` of a run file."""
    spark.dataSource.register(RecordFiles)
    rows = spark.read.format("tideline_records").option("path", path).option("layout", RUN).load()
    return rows.selectExpr("key", "metadata = 1 as is_delete", "if(metadata = 1, null, value) as value")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Write ``seq, key, value`` as a folder of pair files in order of seq."""
    pairs.sparkSession.dataSource.register(RecordFiles)
    ordered = pairs.orderBy("seq").selectExpr("cast(key as int) as key", "cast(value as int) as value")
    ordered.write.format("tideline_records").option("path", path).mode("append").save()


def write_run(records: DataFrame, path: str) -> None:
    """Write ``key, is_delete, value`` as a run: sorted by key, deletes as 0 with
    their mark."""
    records.sparkSession.dataSource.register(RecordFiles)
    ordered = records.orderBy("key").selectExpr("cast(key as int) as key", "if(is_delete, 0, cast(value as int)) as value", "cast(is_delete as int) as metadata")
    ordered.write.format("tideline_records").option("path", path).option("layout", RUN).mode("append").save()
