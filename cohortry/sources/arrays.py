"""Numpy's array files as a Spark data source: ``.npy``, and members of ``.npz``, read by byte ranges."""

from __future__ import annotations

import ast
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

#: Kinds of numbers that have a type in Spark: (Arrow's, Spark's).
_KINDS = {"f4": (pa.float32(), FloatType()), "f8": (pa.float64(), DoubleType()), "i4": (pa.int32(), IntegerType()), "i8": (pa.int64(), LongType())}


def open_file(path: str):
    """A seekable file of any file system that Arrow knows by its address, or a local one."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _header(f) -> tuple[np.dtype, tuple[int, ...], int]:
    """(kind of number, shape, bytes of the header) of an array file that stands at its start."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size, extra = (struct.unpack("<H", f.read(2))[0], 2) if magic[6] == 1 else (struct.unpack("<I", f.read(4))[0], 4)
    said = ast.literal_eval(bytes(f.read(size)).decode("latin1" if magic[6] < 3 else "utf-8"))
    if said["fortran_order"] and len(said["shape"]) > 1:
        raise ValueError("arrays by columns cannot be cut into ranges of rows")
    return np.dtype(said["descr"]), tuple(said["shape"]), 8 + extra + size


class _Place:
    """Where an array lies: bytes of the file from ``start`` on if it is stored as it is, else a compressed member."""

    def __init__(self, path: str, member: str | None):
        self.path, self.member, self.start = path, None, 0
        with open_file(path) as f:
            if path.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    names = z.namelist()
                    own = f"{member}.npy" if f"{member}.npy" in names else member or names[0]
                    info = z.getinfo(own)
                    if info.compress_type == zipfile.ZIP_STORED:
                        f.seek(info.header_offset + 26)
                        self.start = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                    else:
                        self.member = own
                        with z.open(own) as m:
                            self.dtype, self.shape, self.head = _header(m)
            if self.member is None:
                f.seek(self.start)
                self.dtype, self.shape, self.head = _header(f)
        if self.dtype.str[1:] not in _KINDS or not 1 <= len(self.shape) <= 2:
            raise ValueError(f"{self.dtype} in {len(self.shape)} dimensions has no type here")
        self.row = self.dtype.itemsize * (self.shape[1] if len(self.shape) == 2 else 1)

    def chunks(self, lo: int, hi: int, size: int):
        """(first row, bytes) of rows ``lo`` to ``hi`` in parts of some ``size`` bytes."""
        step = max(1, size // max(1, self.row))
        with open_file(self.path) as f:
            if self.member is None:
                f.seek(self.start + self.head + lo * self.row)
                for at in range(lo, hi, step):
                    yield at, f.read((min(hi, at + step) - at) * self.row)
            else:
                with zipfile.ZipFile(f) as z, z.open(self.member) as m:
                    m.read(self.head)
                    for at in range(lo, hi, step):
                        yield at, m.read((min(hi, at + step) - at) * self.row)


class _Reader(DataSourceReader):
    def __init__(self, place: _Place, part: int, size: int):
        self.place, self.part, self.size = place, part, size

    def partitions(self):
        rows = self.place.shape[0]
        step = rows if self.place.member else max(1, self.part // max(1, self.place.row))
        return [InputPartition((lo, min(rows, lo + step))) for lo in range(0, rows, max(1, step))] or [InputPartition((0, 0))]

    def read(self, partition):
        place = self.place
        kind = _KINDS[place.dtype.str[1:]][0]
        for at, raw in place.chunks(*partition.value, self.size):
            flat = np.frombuffer(raw, place.dtype).astype(place.dtype.newbyteorder("="))
            n = len(raw) // place.row if place.row else 0
            values = pa.array(flat, kind)
            if len(place.shape) == 2:
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * place.shape[1]), values)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], names=["row", "v"])


class ArraySource(DataSource):
    """Format ``npy`` with options ``path``, ``member`` (of an ``.npz``, the first if not given), ``partition_bytes`` and ``batch_bytes``: ``row`` and ``v``,
    an array for two dimensions and a number for one.

    A task reads a range of bytes and holds one batch of it. A compressed member can only be read from its start, so one task reads it, by batches.
    """

    @classmethod
    def name(cls):
        return "npy"

    def _place(self) -> _Place:
        return _Place(self.options["path"], self.options.get("member"))

    def schema(self):
        place = self._place()
        kind = _KINDS[place.dtype.str[1:]][1]
        return StructType([StructField("row", LongType()), StructField("v", ArrayType(kind) if len(place.shape) == 2 else kind)])

    def reader(self, schema):
        return _Reader(self._place(), int(self.options.get("partition_bytes") or 16 << 20), int(self.options.get("batch_bytes") or 2 << 20))


def read_array(spark: SparkSession, path: str, member: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("npy").options(**options)
    return (reader.option("member", member) if member else reader).load(path)


def array_bytes(x: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, x)
    return held.getvalue()
