"""Archives of arrays (.npz) as a data source: spark.read.format("windows") and df.write.format("windows").

An archive is a zip of arrays whose first dimension is the window: X, and where present t0, log_energy and
meta_json (one text for the archive, or one a window). A partition is a stretch of rows of one archive; it reads only
the arrays that the schema asks for, and of each only its rows. Archives are opened through Arrow's file systems,
by path or URI, so they must be where every executor can open them.
"""

from __future__ import annotations

import ast
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

#: Rows of a partition, and of a batch of one.
ROWS, TOGETHER = 2048, 256
SCHEMA = "file string, row long, t0 double, log_energy float, meta_json string, shape array<int>, x array<float>"
#: Array of a column in the archive, fixed names.
MEMBERS = {"t0": "t0", "log_energy": "log_energy", "meta_json": "meta_json", "x": "X"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def archives(path: str) -> list[str]:
    """The .npz files at or below a path, in order of their names; of a folder without any, none."""
    files, inside = _open(path)
    info = files.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [inside]
    found = files.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz") and "/_" not in f.path[len(inside) :])


def _header(stream) -> tuple[tuple[int, ...], np.dtype, bool]:
    """(shape, type, whether columns come first) at the head of an array file; the stream then stands at its first number."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size = struct.unpack("<H", stream.read(2))[0] if magic[6] == 1 else struct.unpack("<I", stream.read(4))[0]
    said = ast.literal_eval(stream.read(size).decode("latin1" if magic[6] < 3 else "utf8"))
    kind = np.dtype(said["descr"])
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return tuple(said["shape"]), kind, said["fortran_order"]


def _skip(stream, size: int) -> None:
    """Pass over so many bytes: by a seek where the member is stored, by reading on where it is packed."""
    stream.seek(size, 1)


def _rows(archive: zipfile.ZipFile, name: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows [low, high) of an array, TOGETHER at once."""
    with archive.open(f"{name}.npy") as stream:
        shape, kind, turned = _header(stream)
        if turned and len(shape) > 1:
            raise ValueError(f"{name} is stored by columns")
        width = int(np.prod(shape[1:], dtype=np.int64))
        _skip(stream, low * width * kind.itemsize)
        for at in range(low, high, TOGETHER):
            n = min(TOGETHER, high - at)
            yield np.frombuffer(stream.read(n * width * kind.itemsize), kind).reshape(n, *shape[1:])


def _text(archive: zipfile.ZipFile, low: int, high: int) -> Iterator[list[str]]:
    with archive.open("meta_json.npy") as stream:
        shape, kind, _ = _header(stream)
        one = str(np.frombuffer(stream.read(kind.itemsize), kind)[0]) if not shape else None
    if one is not None:
        for at in range(low, high, TOGETHER):
            yield [one] * min(TOGETHER, high - at)
    else:
        for part in _rows(archive, "meta_json", low, high):
            yield [str(v) for v in part]


@dataclass
class _Part(InputPartition):
    file: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.rows = int(options.get("rowsperpartition", ROWS))
        if unknown := [c for c in schema.fieldNames() if c not in [f.split()[0] for f in SCHEMA.split(", ")]]:
            raise ValueError(f"archives have no {', '.join(unknown)}")

    def partitions(self) -> list[InputPartition]:
        """Stretches of rows; of each archive only the header of X is read here."""
        out: list[InputPartition] = []
        files, _ = _open(self.path)
        for name in archives(self.path):
            with files.open_input_file(name) as raw, zipfile.ZipFile(raw) as archive:
                if "X.npy" not in archive.namelist():
                    raise ValueError(f"{name} holds no X")
                with archive.open("X.npy") as stream:
                    count = _header(stream)[0][0]
            out += [_Part(name, low, min(low + self.rows, count)) for low in range(0, count, self.rows)]
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        if partition.low >= partition.high:
            return
        wanted = self.schema.fieldNames()
        low, high = partition.low, partition.high
        with files.open_input_file(partition.file) as raw, zipfile.ZipFile(raw) as archive:
            held = archive.namelist()
            shape = None
            if "shape" in wanted:
                with archive.open("X.npy") as stream:
                    shape = list(_header(stream)[0][1:])
            streams = {c: _rows(archive, MEMBERS[c], low, high) for c in wanted if c in ("t0", "log_energy", "x") and f"{MEMBERS[c]}.npy" in held}
            if "meta_json" in wanted and "meta_json.npy" in held:
                streams["meta_json"] = _text(archive, low, high)
            for at in range(low, high, TOGETHER):
                n = min(TOGETHER, high - at)
                parts = {c: next(s) for c, s in streams.items()}
                yield pa.RecordBatch.from_arrays([self._column(c, parts.get(c), partition.file, at, n, shape) for c in wanted], wanted)

    @staticmethod
    def _column(name: str, values, file: str, at: int, n: int, shape: list[int] | None) -> pa.Array:
        """A column of n rows from row at; what an archive lacks is its place (t0), 0 (log_energy) or {} (meta_json)."""
        if name == "file":
            return pa.array([file] * n)
        if name == "row":
            return pa.array(np.arange(at, at + n))
        if name == "shape":
            return pa.array([shape] * n, pa.list_(pa.int32()))
        if name == "meta_json":
            return pa.array(["{}"] * n if values is None else values)
        if name == "t0":
            return pa.array(np.arange(at, at + n, dtype=float) if values is None else values.astype(float))
        if name == "log_energy":
            return pa.array(np.zeros(n, np.float32) if values is None else values.astype(np.float32))
        flat = values.reshape(n, -1).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes archives into a folder of the job's own; the commit moves them to the target, an abort removes them."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.columns, self.rows = schema.fieldNames(), int(options.get("rowsperfile", 16 * ROWS))
        if "x" not in self.columns or not isinstance(schema["x"].dataType, ArrayType):
            raise ValueError("archives need x, an array")
        if unknown := [c for c in self.columns if c not in (*MEMBERS, "shape", "file", "row")]:
            raise ValueError(f"archives cannot hold {', '.join(unknown)}")
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _open(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        made, held, count = [], [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.rows - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == self.rows:
                    made.append(self._archive(files, root, held))
                    count, held = count + self.rows, []
        if held:
            count += sum(b.num_rows for b in held)
            made.append(self._archive(files, root, held))
        return _Written(made, count)

    def _archive(self, files: fs.FileSystem, root: str, batches: list[pa.RecordBatch]) -> str:
        table = pa.Table.from_batches(batches)
        if table.column("x").null_count:
            raise ValueError("x is null in a row")
        widths = table.column("x").combine_chunks().value_lengths().unique().to_pylist()
        if len(widths) > 1:
            raise ValueError(f"arrays of {len(widths)} lengths in one archive")
        shape = table.column("shape")[0].as_py() if "shape" in self.columns else None
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(table), *(shape or [widths[0]]))
        parts = {"X": x}
        if "t0" in self.columns:
            parts["t0"] = table.column("t0").to_numpy().astype(float)
        if "log_energy" in self.columns:
            parts["log_energy"] = table.column("log_energy").to_numpy().astype(np.float32)
        if "meta_json" in self.columns:
            parts["meta_json"] = np.array([v or "{}" for v in table.column("meta_json").to_pylist()], dtype=np.str_)
        name = f"part-{uuid.uuid4().hex}.npz"
        with files.open_output_stream(f"{root}/{self.job}/{name}") as out:
            np.savez_compressed(_Sink(out), **parts)
        return name

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        before = [f for f in archives(self.path)] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                files.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        for old in before:
            files.delete_file(old)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class _Sink:
    """What zipfile needs of a file that can only be appended to."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(memoryview(data).cast("B"))
        return len(memoryview(data).cast("B"))

    def flush(self) -> None:
        self.out.flush()

    def read(self, *_):
        raise OSError("written only")


class Windows(DataSource):
    """Options: path; rowsPerPartition (reading); rowsPerFile (writing). A schema of fewer columns reads fewer arrays. mode("append") adds archives, mode("overwrite") replaces those there."""

    @classmethod
    def name(cls) -> str:
        return "windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Windows)
