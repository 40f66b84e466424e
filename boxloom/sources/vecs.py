"""Vector files as a Spark data source: .fvecs, .ivecs and .bvecs.

A record is an int32 dimension and that many float32, int32 or uint8 values, little-endian.  A path is a file or a
folder of part files in name order; a row's id is its place in all of them.  Partitions are runs of records, read by
byte range.  Writing replaces nothing: each task writes a part of its own, and only parts of tasks that ended well
stay.  Rows are written in the order of the DataFrame's partitions.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Element types of the formats (fixed values).
TYPES = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "int")}
RECORDS = 65_536  # in a partition


def files_of(path: str, kind: str) -> list[tuple[str, int]]:
    store, inner = pafs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = [x for x in store.get_file_info(pafs.FileSelector(inner)) if x.path.endswith("." + kind)]
        return sorted((x.path, x.size) for x in found)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(inner, info.size)]


def dimension(path: str, kind: str) -> int:
    store, _ = pafs.FileSystem.from_uri(path)
    for inner, size in files_of(path, kind):
        if size:
            with store.open_input_file(inner) as f:
                return int(np.frombuffer(f.read(4), "<i4")[0])
    raise ValueError(f"no records in {path}")


@dataclass
class Run(InputPartition):
    path: str
    first: int
    count: int
    row: int


class VecsReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.width = np.dtype(TYPES[kind][0]).itemsize

    def partitions(self):
        self.d = dimension(self.path, self.kind)
        record, row, out = 4 + self.width * self.d, 0, []
        for inner, size in files_of(self.path, self.kind):
            if size % record:
                raise ValueError(f"{inner}: {size} bytes are no whole number of records of {record}")
            n = size // record
            out += [Run(inner, k, min(RECORDS, n - k), row + k) for k in range(0, n, RECORDS)]
            row += n
        return out

    def read(self, part: Run):
        store, _ = pafs.FileSystem.from_uri(self.path)
        d = dimension(self.path, self.kind)
        record = 4 + self.width * d
        with store.open_input_file(part.path) as f:
            f.seek(part.first * record)
            data = np.frombuffer(f.read(part.count * record), np.uint8).reshape(part.count, record)
        if (data[:, :4].copy().view("<i4")[:, 0] != d).any():
            raise ValueError(f"{part.path}: records of several dimensions")
        values = np.ascontiguousarray(data[:, 4:]).view(TYPES[self.kind][0])
        flat = pa.array(values.astype(np.int32 if self.kind == "bvecs" else values.dtype).ravel())
        offsets = pa.array(np.arange(part.count + 1, dtype=np.int32) * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.row, part.row + part.count)), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "x"])


@dataclass
class Part(WriterCommitMessage):
    path: str | None


class VecsWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, rows):
        store, inner = pafs.FileSystem.from_uri(self.path)
        store.create_dir(inner, recursive=True)
        name = f"{inner}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.kind}"
        dtype, n = np.dtype(TYPES[self.kind][0]), 0
        with store.open_output_stream(name, compression=None) as out:
            for row in rows:
                out.write(np.int32(len(row[0])).tobytes() + np.asarray(row[0]).astype(dtype).tobytes())
                n += 1
        if not n:
            store.delete_file(name)
        return Part(name if n else None)

    def commit(self, messages):
        store, inner = pafs.FileSystem.from_uri(self.path)
        kept = {os.path.basename(m.path) for m in messages if m and m.path}
        for x in store.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if os.path.basename(x.path).startswith("part-") and os.path.basename(x.path) not in kept:
                store.delete_file(x.path)

    def abort(self, messages):
        store, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class VecsSource(DataSource):
    kind = "fvecs"

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return f"vec_id long, x array<{TYPES[self.kind][1]}>"

    def reader(self, schema):
        return VecsReader(self.options["path"], self.kind)

    def writer(self, schema, overwrite):
        return VecsWriter(self.options["path"], self.kind)


class FvecsSource(VecsSource):
    kind = "fvecs"


class IvecsSource(VecsSource):
    kind = "ivecs"


class BvecsSource(VecsSource):
    kind = "bvecs"


def register(spark: SparkSession) -> None:
    for source in (FvecsSource, IvecsSource, BvecsSource):
        spark.dataSource.register(source)


def read(spark: SparkSession, path: str, kind: str, d: int | None = None, rows: int | None = None) -> DataFrame:
    """(vec_id, x); ``d`` and ``rows`` are checked if given, as for scales, codes and centroids."""
    register(spark)
    if d is not None and dimension(path, kind) != d:
        raise ValueError(f"{path} has dimension {dimension(path, kind)}, not {d}")
    out = spark.read.format(kind).load(path)
    if rows is not None and out.count() != rows:
        raise ValueError(f"{path} does not have {rows} rows")
    return out


def write(rows: DataFrame, path: str, kind: str, x: str = "x", key: str = "vec_id") -> None:
    """Writes the vectors in ascending order of the key."""
    register(rows.sparkSession)
    rows.repartitionByRange(key).sortWithinPartitions(key).select(x).write.format(kind).mode("append").save(path)


def read_centroids(spark: SparkSession, path: str, parts: int, ks: int, d: int) -> DataFrame:
    """(m, k, centroid) of a codebook file with parts * ks rows, padded to the widest subspace."""
    rows = read(spark, path, "fvecs", -(-d // parts), parts * ks)
    return rows.select(F.floor(F.col("vec_id") / ks).cast("int").alias("m"), (F.col("vec_id") % ks).cast("int").alias("k"), F.col("x").alias("centroid"))


def exists(path: str) -> bool:
    store, inner = pafs.FileSystem.from_uri(path)
    return store.get_file_info(inner).type != pafs.FileType.NotFound
