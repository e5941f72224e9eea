"""Binary headers as a data source: spark.read.format("model_headers").load(path).

Files are planned into partitions by the bytes that their headers may take;
filters on path are applied to the list of files, before any is opened; the
columns of the schema that is asked for say how far a header is read. Without
tensors or data_start nothing behind the metadata is decoded, and ranges begin
small and grow.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from quarry.sources.files import HEADER, MOST_BYTES, CutOff, decode_header

SCHEMA = f"{HEADER}, arch string, bytes_read long"
COLUMNS = ("path", "length", "version", "metadata", "tensors", "data_start", "error", "arch", "bytes_read")
#: Bytes of the first range of a file, files and header bytes that a partition plans for.
FIRST, FILES, PLANNED = 1 << 14, 256, 64 << 20
#: What can't be known before the end of the header.
WHOLE = frozenset({"tensors", "data_start"})


@dataclass
class Files(InputPartition):
    """Some files with their lengths."""

    files: list[tuple[str, int]]


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeaderSource)


class HeaderSource(DataSource):
    """Options: path (a folder or file), glob (of file names, all by default), first (bytes of the first range)."""

    @classmethod
    def name(cls) -> str:
        return "model_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "HeaderReader":
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"headers have no columns {sorted(unknown)}")
        return HeaderReader(dict(self.options), schema)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.first = int(options.get("first", FIRST))
        self.columns = schema.names
        self.accepted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, EqualTo | In | StringContains | StringEndsWith | StringStartsWith):
                self.accepted.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {
            EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringContains: lambda f: f.value in path,
            StringEndsWith: lambda f: path.endswith(f.value), StringStartsWith: lambda f: path.startswith(f.value),
        }
        return all(tests[type(f)](f) for f in self.accepted)

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, in runs of at most FILES files and PLANNED bytes of first ranges."""
        from fnmatch import fnmatch

        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        info = system.get_file_info(place)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
        files = sorted((scheme + f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, self.glob))
        out: list[Files] = []
        planned = 0
        for path, size in files:
            if not self._wanted(path):
                continue
            need = min(size, self.first)
            if not out or len(out[-1].files) >= FILES or planned + need > PLANNED:
                out.append(Files([]))
                planned = 0
            out[-1].files.append((path, size))
            planned += need
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            row = {"path": path, "length": size, "bytes_read": 0}
            if set(self.columns) - {"path", "length"}:
                try:
                    row |= self._header(path, size)
                except (ValueError, KeyError, OSError) as e:
                    row["error"] = str(e) or type(e).__name__
            yield tuple(row.get(c) for c in self.columns)

    def _header(self, path: str, size: int) -> dict:
        """A header from growing ranges, each read behind the one before, so no byte is read twice."""
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        data, step = b"", self.first
        with system.open_input_file(place) as f:
            while True:
                data += f.read_at(min(step, size - len(data)), len(data))
                try:
                    head = decode_header(data, tensors=not WHOLE.isdisjoint(self.columns))
                    break
                except CutOff:
                    if len(data) >= min(size, MOST_BYTES):
                        raise
                    step = 3 * len(data)
        head["tensors"] = [(t["name"], t["dims"], t["kind"], t["offset"]) for t in head["tensors"]] if head["tensors"] is not None else None
        arch = head["metadata"].get("general.architecture")
        return head | {"arch": json.loads(arch) if arch else None, "bytes_read": len(data)}


def read_header_columns(spark: SparkSession, path: str, columns: list[str], glob: str = "*") -> DataFrame:
    """The columns of the headers under a path, and nothing of them that these don't need; a broken file keeps its row, with error if that is asked for."""
    register(spark)
    fields = {f.name: f for f in StructType.fromDDL(SCHEMA).fields}
    return spark.read.format("model_headers").schema(StructType([fields[c] for c in columns])).option("glob", glob).load(path)
