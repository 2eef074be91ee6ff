"""A data source of JSON lines (also gzipped) that takes filters and a limit into the scan.

    spark.dataSource.register(JsonLines)
    spark.read.format("jsonlines").option("limit", 1000).load("/data/reviews")

Options: ``path`` (a file or a folder), ``limit`` (records; the files are then read in order of their names by one task, which opens no file
after the last record it needs), ``split_bytes`` (plain files are cut into ranges of so many bytes; gzipped ones aren't), ``sample`` (records
that the fields are told from if no schema is given). Blank lines are skipped; a line that isn't a JSON object is an error with its file.

Cells that don't fit the column's type are null; nested values in string columns stay JSON. Comparisons of top-level columns with
constants are decided on the parsed record, before any cell is converted (``spark.sql.python.filterPushdown.enabled``); the
limit counts what the filters leave. Files are opened through pyarrow's file systems, so stores that it knows (also HDFS) can be read.
"""

from __future__ import annotations

import gzip
import io
import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

SPLIT_BYTES, SAMPLE = 64 << 20, 1000
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_TYPES = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType()}


def _files(path: str) -> tuple[object, list[tuple[str, int]]]:
    """The file system of ``path`` and its files (name, bytes) in order of their names; hidden ones are left out."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return store, [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    plain = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return store, sorted(plain)


def _lines(store: object, name: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Lines that begin in [start, end) of a file."""
    with store.open_input_file(name) as raw:
        if name.endswith(".gz"):
            yield from gzip.GzipFile(fileobj=raw)
            return
        at = start
        if start:
            raw.seek(start - 1)
        reader = io.BufferedReader(raw, 1 << 20)
        if start:
            at = start - 1 + len(reader.readline())  # the rest of a line that began before
        for line in reader:
            if end is not None and at >= end:
                return
            at += len(line)
            yield line


def _records(store: object, name: str, start: int = 0, end: int | None = None) -> Iterator[dict]:
    for line in _lines(store, name, start, end):
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError as error:
                raise ValueError(f"{name}: {error}") from error
            if not isinstance(row, dict):
                raise ValueError(f"{name}: a line isn't an object")
            yield row


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, int | None]]


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonlines"

    def schema(self) -> StructType:
        """Fields of the first records, in order of appearance; numbers of both kinds are double, anything else mixed is string."""
        store, files = _files(self.options["path"])
        types: dict[str, DataType | None] = {}
        left = int(self.options.get("sample", SAMPLE))
        for name, _ in files:
            for row in _records(store, name):
                for key, value in row.items():
                    kind = None if value is None else _TYPES.get(type(value), StringType())
                    have = types.get(key)
                    numbers = {type(have), type(kind)} == {LongType, DoubleType}
                    types[key] = kind if have is None else have if kind is None or kind == have else DoubleType() if numbers else StringType()
                left -= 1
                if left <= 0:
                    break
            if left <= 0:
                break
        return StructType([StructField(key, kind or StringType()) for key, kind in types.items()])

    def reader(self, schema: StructType) -> JsonLinesReader:
        return JsonLinesReader(schema, dict(self.options))


class JsonLinesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.limit = int(options["limit"]) if options.get("limit") not in (None, "") else None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            simple = isinstance(f, (*_COMPARE, In, IsNull, IsNotNull)) and len(f.attribute) == 1
            kinds = (BooleanType, LongType, DoubleType, StringType)
            if simple and f.attribute[0] in self.schema.names and isinstance(self.schema[f.attribute[0]].dataType, kinds):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        _, files = _files(self.path)
        if self.limit is not None:
            return [Part([(name, 0, None) for name, _ in files])]
        parts = []
        for name, size in files:
            cuts = [0] if name.endswith(".gz") else list(range(0, max(size, 1), self.split))
            parts += [Part([(name, a, b)]) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return parts

    def cell(self, value: object, kind: DataType) -> object:
        if value is None:
            return None
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, LongType):
            return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None
        if isinstance(kind, DoubleType):
            return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
        raise TypeError(f"columns of type {kind.simpleString()} aren't read; take string and from_json")

    def keeps(self, row: dict) -> bool:
        for f in self.filters:
            name = f.attribute[0]
            value = self.cell(row.get(name), self.schema[name].dataType)
            if isinstance(f, IsNull):
                good = value is None
            elif isinstance(f, IsNotNull):
                good = value is not None
            elif isinstance(f, In):
                good = value is not None and value in f.value
            else:
                good = value is not None and _COMPARE[type(f)](value, f.value)
            if not good:
                return False
        return True

    def read(self, partition: Part) -> Iterator[tuple]:
        if self.limit is not None and self.limit <= 0:
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        count = 0
        for name, start, end in partition.files:
            for row in _records(store, name, start, end):
                if self.keeps(row):
                    yield tuple(self.cell(row.get(field.name), field.dataType) for field in self.schema)
                    count += 1
                    if count == self.limit:
                        return


def json_lines(spark: SparkSession, path: str, schema: str | StructType | None = None, limit: int | None = None, **options: object) -> DataFrame:
    """The records of ``path`` (fields by ``schema``, else told from the first ones), the first ``limit`` ones if given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)
    reader = spark.read.format("jsonlines").options(**{k: str(v) for k, v in options.items()})
    reader = reader.schema(schema) if schema is not None else reader
    return (reader if limit is None else reader.option("limit", str(limit))).load(path)


def sampled_fields(spark: SparkSession, path: str, expected: list[str], sample: int = SAMPLE) -> DataFrame:
    """(field, seen, missing, records): fields of the first ``sample`` records, and in how many of them each expected field is missing, null or empty."""
    rows = json_lines(spark, path, limit=sample, sample=sample)
    names = [*rows.columns, *(c for c in expected if c not in rows.columns)]
    missing = lambda c: F.count_if(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "")) if c in rows.columns else F.count("*")
    counts = rows.agg(F.count("*").alias("records"), F.array(*(missing(c) for c in names)).alias("m"))
    told = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(c in rows.columns).alias("seen"), F.lit(c in expected).alias("asked")) for c in names))
    tall = counts.select("records", F.explode(F.arrays_zip(told.alias("f"), F.col("m").alias("m"))).alias("x"))
    return tall.select("x.f.field", "x.f.seen", F.when(F.col("x.f.asked"), F.col("x.m")).alias("missing"), "records")
