"""Array files (.npy) as a Spark data source: partitions are row ranges, read by their offsets.

    spark.dataSource.register(ArrayRows)
    spark.read.format("npy").option("path", "/shards/*.npy").load().where("row between 1000 and 2000")

Columns: file (its name), row, values (the row's numbers; an array of more than two dimensions is flattened behind the first). A reader's
schema may name some of them only, and values as array<float> or array<int>; without values no data is read. Comparisons of
row with numbers, and of file with names, are pushed down (spark.sql.python.filterPushdown.enabled), so that other ranges and
files are not opened for data. Options: path (a file, a folder or a pattern in the last part), partitionBytes.
Files may lie wherever pyarrow and Spark both reach. Only headers are read by the driver."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from .files import located, open_uri

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20  # what a task holds at a time


def header(stream) -> tuple[tuple[int, ...], bool, object, int]:
    """(shape, column-major, dtype, offset of the data) of an open .npy file."""
    import numpy as np

    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, columns_first, dtype, stream.tell()


@dataclass
class Rows(InputPartition):
    """Rows first to last (exclusive) of a file."""

    uri: str
    name: str
    first: int
    last: int


class ArrayRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        if unknown := {f.name for f in schema} - {"file", "row", "values"}:
            raise ValueError(f"an array file has no columns {', '.join(sorted(unknown))}")
        self.columns = schema
        self.low, self.high = 0, None  # rows, high exclusive
        self.names: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            column, value = f.attribute, getattr(f, "value", None)
            if isinstance(f, IsNotNull):
                continue
            if column == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif column == ("file",) and isinstance(f, (EqualTo, In)):
                wanted = set(value if isinstance(f, In) else [value])
                self.names = wanted if self.names is None else self.names & wanted
            elif column == ("file",) and isinstance(f, StringStartsWith):
                self.prefixes.append(value)
            else:
                yield f

    def _files(self) -> list[tuple[str, str]]:
        """(uri, name) of the files that filters leave."""
        import pyarrow.fs as pafs

        fs, inner, scheme = located(self.uri)
        folder, _, pattern = inner.rpartition("/")
        if "*" not in pattern and "?" not in pattern and fs.get_file_info(inner).type == pafs.FileType.Directory:
            folder, pattern = inner, "*.npy"
        found = [x for x in fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern)]
        kept = [x for x in found if (self.names is None or x.base_name in self.names) and all(x.base_name.startswith(p) for p in self.prefixes)]
        if not found:
            raise FileNotFoundError(self.uri)
        return sorted((scheme + x.path, x.base_name) for x in kept)

    def partitions(self) -> list[Rows]:
        import math

        out = []
        for uri, name in self._files():
            with open_uri(uri, "r") as stream:
                shape, _, dtype, _ = header(stream)
            n = shape[0] if shape else 1
            row_bytes = max(1, math.prod(shape[1:]) * dtype.itemsize)
            step = max(1, self.partition_bytes // row_bytes)
            end = n if self.high is None else min(n, self.high)
            out += [Rows(uri, name, at, min(at + step, end)) for at in range(self.low, end, step)]
        return out

    def read(self, rows: Rows):
        import math

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.columns)
        with open_uri(rows.uri, "r") as stream:
            shape, columns_first, dtype, offset = header(stream)
            n, width = (shape[0] if shape else 1), math.prod(shape[1:])
            step = max(1, BATCH_BYTES // max(1, width * dtype.itemsize))

            def numbers(at: int, end: int):
                if not columns_first or width == 1:
                    stream.seek(offset + at * width * dtype.itemsize)
                    return np.frombuffer(stream.read((end - at) * width * dtype.itemsize), dtype)
                out = np.empty((end - at, *shape[1:]), dtype)  # column-major: a strip of each column
                for place in np.ndindex(*shape[1:]):
                    stream.seek(offset + (int(np.ravel_multi_index(place, shape[1:], order="F")) * n + at) * dtype.itemsize)
                    out[(slice(None), *place)] = np.frombuffer(stream.read((end - at) * dtype.itemsize), dtype)
                return out.ravel()

            for at in range(rows.first, rows.last, step):
                end = min(at + step, rows.last)
                columns = []
                for field in schema:
                    if field.name == "file":
                        columns.append(pa.array([rows.name] * (end - at), field.type))
                    elif field.name == "row":
                        columns.append(pa.array(np.arange(at, end), field.type))
                    else:
                        flat = numbers(at, end).astype(field.type.value_type.to_pandas_dtype())
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * width, pa.int32()), pa.array(flat, field.type.value_type)).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def array_rows(spark: SparkSession, path: str, columns: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SRC-19: rows of .npy files by ranges; columns: some of "file string, row long, values array<double>".

    The session's setting for filter pushdown into Python sources is switched on, and must stay on until the rows are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayRows)
    reader = spark.read.format("npy").option("partitionBytes", partition_bytes)
    return (reader.schema(columns) if columns else reader).load(path)
