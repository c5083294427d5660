"""First and last bytes of files, without reading what lies between.

The data source ``file_heads`` lists a folder and reads a few bytes of each file in
tasks: path, filename, length, head, tail.  Filters on length and filename are
applied to the listing, so files they exclude are never opened; neither are files
longer than the option ``open_up_to``, whose head and tail are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from waybill.session import prepared

SCHEMA = "path string, filename string, length long, head binary, tail binary"
#: Schemes of stores that tasks open themselves; files elsewhere are read by Spark.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
FILES_PER_TASK = 256
_TESTS = {
    EqualTo: lambda x, y: x == y,
    GreaterThan: lambda x, y: x > y,
    GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y,
    StringEndsWith: lambda x, y: x.endswith(y),
    StringStartsWith: lambda x, y: x.startswith(y),
}


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.bytes = int(options.get("bytes", "8"))
        self.open_up_to = int(options.get("open_up_to", str(1 << 62)))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            ours = getattr(f, "attribute", None) in (("length",), ("filename",))
            if ours and type(f) in _TESTS:
                self.wanted.append(f)
            elif not (ours and isinstance(f, IsNotNull)):
                yield f

    def _listed(self) -> Iterator[tuple[str, int]]:
        store, root = fs.FileSystem.from_uri(self.root)
        base = root.rstrip("/")
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            inner = info.path[len(base) :].split("/")
            if info.type != fs.FileType.File or any(x.startswith(("_", ".")) for x in inner):
                continue
            values = {"length": info.size, "filename": info.base_name}
            if all(_TESTS[type(f)](values[f.attribute[0]], f.value) for f in self.wanted):
                yield info.path, info.size

    def partitions(self) -> list[_Files]:
        files = list(self._listed())
        return [_Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.root)
        for path, length in partition.files:
            head = tail = None
            if length <= self.open_up_to:
                with store.open_input_file(path) as f:
                    head = f.read_at(min(self.bytes, length), 0)
                    tail = f.read_at(min(self.bytes, length), max(0, length - self.bytes))
            yield path, path.rsplit("/", 1)[-1], length, head, tail


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def file_heads(spark: SparkSession, path: str, bytes_: int = 8, open_up_to: int | None = None) -> DataFrame:
    """path, filename, length, head, tail of the files below a folder; hidden ones
    (``_`` or ``.``) are left out.  In stores that only Spark opens, files up to
    ``open_up_to`` are read whole instead."""
    scheme = path.split(":", 1)[0] if ":/" in path else "file"
    if scheme in SCHEMES:
        prepared(spark).dataSource.register(FileHeads)
        reader = spark.read.format("file_heads").option("path", path if ":/" in path else f"file://{path}").option("bytes", bytes_)
        return (reader.option("open_up_to", open_up_to) if open_up_to is not None else reader).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")
    read = files if open_up_to is None else files.where(F.col("length") <= open_up_to)
    read = read.select("path", "filename", "length", F.substring("content", 1, bytes_).alias("head"), F.substring("content", -bytes_, bytes_).alias("tail"))
    if open_up_to is None:
        return read
    none = F.lit(None).cast("binary")
    return read.unionByName(files.where(F.col("length") > open_up_to).select("path", "filename", "length", none.alias("head"), none.alias("tail")))
