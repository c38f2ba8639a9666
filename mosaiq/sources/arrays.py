"""Array files (NPZ) as a Spark data source: tables of blocks of arrays, planned by file and array, and written with a commit.

A block is a run of consecutive elements in row order: file (below the root), name, dtype (NumPy's code with byte order), shape,
first (the run's first element) and values as doubles (null for kinds other than numbers and flags); on request data, the
elements' bytes, which are exact for every kind. An array without elements is one empty block.

Reading: files are packed into partitions of `partitionbytes`; a larger file is split by array. Filters on file and name reach
the planning, so arrays that are not asked for are not opened; `headers` reads no elements. A worker holds one block, whatever
the array's size; only arrays stored by columns are held whole. Pickled objects and records with fields are errors.

Writing: every attempt of a task writes new files in a folder of the job; the commit moves those of the attempts that count and
removes the folder, an abort only removes it. A file, an array or a block that is there twice, a gap, a block whose dtype or
shape differs from its array's, and values that an integer kind can't hold are errors. Null files or names are errors.
An empty table writes nothing. Equal tables give equal bytes.
"""

from __future__ import annotations

import dataclasses
import math
import posixpath
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from mosaiq.sources.readers import file_system

KINDS = {"file": "string", "name": "string", "dtype": "string", "shape": "array<bigint>", "first": "bigint", "values": "array<double>", "data": "binary"}
HEADER, BLOCK = ["file", "name", "dtype", "shape"], ["file", "name", "dtype", "shape", "first", "values"]
ARROW = {"file": pa.string(), "name": pa.string(), "dtype": pa.string(), "shape": pa.list_(pa.int64()), "first": pa.int64(), "values": pa.list_(pa.float64()), "data": pa.binary()}
ELEMENTS = 1 << 17
PARTITION_BYTES = 128 << 20
BATCH_ROWS = 1024


def ddl(columns: Iterable[str]) -> str:
    return ", ".join(f"{c} {KINDS[c]}" for c in columns)


@dataclasses.dataclass
class Part(InputPartition):
    """Files, and of one large file an array."""

    files: tuple[str, ...]
    name: str | None = None


def header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether stored by columns, and dtype; the stream then stands at the first element."""
    version = np.lib.format.read_magic(stream)
    known = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    if version not in known:
        raise ValueError(f"array format {version} is not read")
    shape, by_columns, dtype = known[version](stream)
    if dtype.hasobject or dtype.names or dtype.subdtype:
        raise ValueError(f"arrays of {dtype} are not read")
    return shape, by_columns, dtype


def pieces(stream, shape: tuple[int, ...], by_columns: bool, dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(first element, elements) in row order."""
    total = math.prod(shape)
    whole = None
    if by_columns and len(shape) > 1:
        whole = np.frombuffer(stream.read(total * dtype.itemsize), dtype).reshape(shape, order="F").ravel()
    for first in range(0, max(total, 1), ELEMENTS):
        n = min(ELEMENTS, total - first)
        block = whole[first : first + n] if whole is not None else np.frombuffer(stream.read(n * dtype.itemsize), dtype) if dtype.itemsize else np.zeros(n, dtype)
        if len(block) != n:
            raise ValueError("the array ends before its shape does")
        yield first, block


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            key = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if key not in ("file", "name"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[key] = self.wanted[key] & values if key in self.wanted else values

    def kept(self, key: str, value: str) -> bool:
        return key not in self.wanted or value in self.wanted[key]

    def members(self, archive: zipfile.ZipFile) -> list[str]:
        return [m[:-4] for m in archive.namelist() if m.endswith(".npy") and self.kept("name", m[:-4])]

    def partitions(self) -> list[Part]:
        system, root = file_system(self.path)
        out, files, filled = [], [], 0
        for name, size in listed(system, root):
            if not self.kept("file", name):
                continue
            if size > self.size:
                with system.open_input_file(f"{root}/{name}") as f, zipfile.ZipFile(f) as archive:
                    out += [Part((name,), member) for member in self.members(archive)]
                continue
            if files and filled + size > self.size:
                out.append(Part(tuple(files)))
                files, filled = [], 0
            files.append(name)
            filled += size
        return [*out, Part(tuple(files))] if files or not out else out

    def rows(self, part: Part) -> Iterator[dict]:
        system, root = file_system(self.path)
        for name in part.files:
            with system.open_input_file(f"{root}/{name}") as f, zipfile.ZipFile(f) as archive:
                for member in self.members(archive) if part.name is None else [part.name]:
                    with archive.open(member + ".npy") as stream:
                        shape, by_columns, dtype = header(stream)
                        row = {"file": name, "name": member, "dtype": dtype.str, "shape": list(shape)}
                        if not {"first", "values", "data"} & set(self.columns):
                            yield row | {"size": 0}
                            continue
                        for first, block in pieces(stream, shape, by_columns, dtype):
                            values = block.astype(np.float64) if dtype.kind in "biuf" else None
                            yield row | {"first": first, "values": values, "data": block.tobytes() if "data" in self.columns else None, "size": len(block)}

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self.rows(part):
            size += row["size"]
            rows.append(row)
            if size >= ELEMENTS or len(rows) == BATCH_ROWS:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.column(c, [r[c] for r in rows]) for c in self.columns], schema=pa.schema([(c, ARROW[c]) for c in self.columns]))

    def column(self, name: str, cells: list) -> pa.Array:
        if name != "values":
            return pa.array(cells, ARROW[name])
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in cells)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0), *(v for v in cells if v is not None)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([v is None for v in cells]))


def listed(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Array files below root with their sizes, by name; names and folders that begin with _ or . are left out."""
    found = [(posixpath.relpath(f.path, root), f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    return sorted((p, size) for p, size in found if p.endswith(".npz") and not any(x[0] in "_." for x in p.split("/")))


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """Names in the job's folder by the files they become."""

    files: dict[str, str]


class ArrayFile:
    """One file being written: arrays one after the other, blocks in order."""

    def __init__(self, stream, compressed: bool):
        self.archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED)
        self.kind, self.names, self.member = None, set(), None

    def add(self, name: str, dtype: str, shape: list[int], first: int, values: np.ndarray | None, data: bytes | None) -> None:
        if self.kind is None or self.kind[0] != name:
            self.end()
            if not name or name in self.names:
                raise ValueError(f"array {name} is there twice" if name else "an array has no name")
            self.start(name, dtype, shape)
        if self.kind != (name, dtype, tuple(shape)) or first != self.at:
            raise ValueError(f"array {name}: a block at {first} of {dtype} {shape} does not follow {self.at} elements of {self.kind[1]} {list(self.kind[2])}")
        block = self.bytes_of(name, np.dtype(dtype), values, data)
        self.at += len(block) // max(1, np.dtype(dtype).itemsize)
        self.member.write(block)

    def bytes_of(self, name: str, dtype: np.dtype, values: np.ndarray | None, data: bytes | None) -> bytes:
        if data is not None:
            return data
        if values is None or dtype.kind not in "biuf":
            raise ValueError(f"array {name} of {dtype} has a block without data")
        with np.errstate(invalid="ignore", over="ignore"):
            block = values.astype(dtype)
        if dtype.kind in "biu" and not np.array_equal(block.astype(np.float64), values):
            raise ValueError(f"array {name}: values that {dtype} can't hold")
        return block.tobytes()

    def start(self, name: str, dtype: str, shape: list[int]) -> None:
        if np.dtype(dtype).hasobject:
            raise ValueError("objects are not written")
        entry = zipfile.ZipInfo(name + ".npy")
        entry.compress_type = self.archive.compression
        self.member = self.archive.open(entry, "w", force_zip64=True)
        np.lib.format.write_array_header_2_0(self.member, {"descr": dtype, "fortran_order": False, "shape": tuple(shape)})
        self.kind, self.at = (name, dtype, tuple(shape)), 0
        self.names.add(name)

    def end(self) -> None:
        if self.member is not None:
            if self.at != math.prod(self.kind[2]) and np.dtype(self.kind[1]).itemsize:
                raise ValueError(f"array {self.kind[0]} has {self.at} elements, its shape is {list(self.kind[2])}")
            self.member.close()
            self.member = None

    def close(self) -> None:
        self.end()
        self.archive.close()


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compressed = options.get("compressed", "true") == "true"
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        files: dict[str, str] = {}
        name, stream, out = None, None, None
        try:
            for batch in iterator:
                get = {c: batch.column(c) for c in batch.schema.names}
                for k in range(batch.num_rows):
                    row = {c: v[k] for c, v in get.items()}
                    if row["file"].as_py() != name or out is None:
                        if out is not None:
                            out.close()
                            stream.close()
                        name = checked_name(row["file"].as_py())
                        if name in files:
                            raise ValueError(f"{name} is there twice: blocks must be sorted by file, name and first")
                        files[name] = f"{uuid.uuid4().hex}.npz"
                        system.create_dir(f"{root}/{self.job}", recursive=True)
                        stream = system.open_output_stream(f"{root}/{self.job}/{files[name]}")
                        out = ArrayFile(stream, self.compressed)
                    values = row["values"].values.to_numpy(zero_copy_only=False) if "values" in row and row["values"].is_valid else None
                    data = row["data"].as_py() if "data" in row else None
                    out.add(row["name"].as_py(), row["dtype"].as_py(), row["shape"].as_py(), row["first"].as_py(), values, data)
            if out is not None:
                out.close()
        finally:
            if stream is not None:
                stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.files]
        old = {n for n, _ in listed(system, root)}
        twice = {n for n in names if names.count(n) > 1} if len(names) != len(set(names)) else set()
        there = set() if self.overwrite else old & set(names)
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files written by more than one task: {sorted(twice)}" if twice else f"files that exist: {sorted(there)}")
        for m in messages:
            for name, temporary in (m.files if m else {}).items():
                system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                system.move(f"{root}/{self.job}/{temporary}", f"{root}/{name}")
        for name in old - set(names) if self.overwrite else ():
            system.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def checked_name(name: str | None) -> str:
    if not name or not name.endswith(".npz") or name.startswith("/") or any(x[:1] in ("", "_", ".") for x in name.split("/")):
        raise ValueError(f"{name} is no name of an array file")
    return name


class ArraySource(DataSource):
    """spark.read.format("arrays"); `read`, `headers` and `write` below register it."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return ddl(BLOCK)

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Adds the source and turns on the session's filter pushdown into sources written in Python, which is off by default."""
    spark.dataSource.register(ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, exact: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Blocks of the arrays below path; exact adds data."""
    register(spark)
    return spark.read.format("arrays").schema(ddl([*BLOCK, "data"] if exact else BLOCK)).option("partitionbytes", partition_bytes).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row an array, without reading elements."""
    register(spark)
    return spark.read.format("arrays").schema(ddl(HEADER)).load(path)


def pack(rows: DataFrame, file: str, order: list[str], arrays: dict[str, tuple[str, str]]) -> DataFrame:
    """Blocks of the arrays {name: (column, dtype)} with one entry a row, a file for each value of `file`, in the order of `order`.

    Columns are numbers, or arrays of numbers of one length in a file. Null cells are errors. Rows that `order` does not tell apart
    come in any order among themselves.
    """
    place = F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(file))
    kinds = dict(rows.dtypes)
    blocks = []
    for name, (column, dtype) in arrays.items():
        wide = kinds[column].startswith("array")
        known = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null")).cast(kinds[column])).otherwise(F.col(column))
        width = F.size(known).cast("bigint") if wide else F.lit(1).cast("bigint")
        shape = F.array("__n", width) if wide else F.array("__n")
        values = known.cast("array<double>") if wide else F.array(known.cast("double"))
        blocks.append(F.struct(F.lit(name).alias("name"), F.lit(np.dtype(dtype).str).alias("dtype"), shape.alias("shape"), (F.col("__place") * width).alias("first"), values.alias("values")))
    placed = rows.withColumn("__place", place.cast("bigint")).withColumn("__n", n)
    return placed.select(F.col(file).alias("file"), F.explode(F.array(*blocks)).alias("block")).select("file", "block.*")


def write(blocks: DataFrame, path: str, overwrite: bool = False, compressed: bool = True) -> None:
    """One file for each value of `file`, each by one task that streams its blocks; overwrite also removes array files that are not written anew."""
    register(blocks.sparkSession)
    names = [c for c in KINDS if c in blocks.columns]
    spread = blocks.select(*names).repartition("file").sortWithinPartitions("file", "name", "first")
    spread.write.format("arrays").mode("overwrite" if overwrite else "append").option("compressed", str(compressed).lower()).save(path)
