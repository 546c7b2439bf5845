"""Recorded responses as a data source: spark.read.format("recorded_responses").load(folder).

A folder holds files of a batch each, batch_<number>.jsonl, or folders batch=<number> with JSON files, as Spark writes them. A line is the JSON
object of a call: call, response, done, done_reason, failure (missing keys are null). A file is a partition. Filters on batch choose files before any is read; other filters are
left to Spark. Files are opened through pyarrow's file systems, so a folder is a path or a URI that pyarrow knows.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME, FILE = "recorded_responses", re.compile(r"/batch_(\d+)\.jsonl$|/batch=(\d+)/[^_.][^/]*\.json$")
FIELDS = "batch int, call int, response string, done boolean, done_reason string, failure string"
SCHEMA = pa.schema([("batch", pa.int32()), ("call", pa.int32()), ("response", pa.string()), ("done", pa.bool_()), ("done_reason", pa.string()), ("failure", pa.string())])
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


@dataclass
class File(InputPartition):
    path: str
    batch: int


class Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in COMPARE and f.attribute == ("batch",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = [(m, x.path) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if (m := FILE.search(x.path))]
        files = sorted((File(path, int(m[1] or m[2])) for m, path in found), key=lambda f: (f.batch, f.path))
        return [f for f in files if all(value is not None and COMPARE[kind](f.batch, value) for kind, value in self.tests)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is chosen
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[dict] = []
        with system.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                rows.append({**dict.fromkeys(SCHEMA.names), **{k: v for k, v in json.loads(line).items() if k in SCHEMA.names}, "batch": partition.batch})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    """Lines that are not blank, a megabyte at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from (x for x in lines if x.strip())
    if rest.strip():
        yield rest


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedResponses)
