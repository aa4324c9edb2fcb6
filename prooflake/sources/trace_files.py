"""A data source of step files: format ``steps``, for batch reads, writes and streams.

A file holds lines ``(step ID POS (role "...") (text "..."))``.  Every task of a write makes a file of its own and names it in
its commit message; the driver's commit puts one numbered list of these files in place by a rename, an abort removes
them.  Readers take the files of the lists alone, so an unfinished or failed write isn't seen.  A stream's offset is the
number of lists.  Equality on ``pos`` and ``role`` and bounds on ``id`` are pushed into the reader: files whose range of
ids can't fit aren't opened, lines that don't fit aren't made into rows.

Paths go through pyarrow's file systems, on every worker: a mounted or local folder, or any store it supports.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id bigint, pos bigint, role string, text string"
LINE = re.compile(r'\(step (-?\d+|nil) (-?\d+|nil) \(role (nil|"(?:[^"\\]|\\.)*")\) \(text (nil|"(?:[^"\\]|\\.)*")\)\)\Z', re.S)
LIST = re.compile(r"\d+\.json\Z")
_OUT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}
_IN = {"n": "\n", "r": "\r"}


def quoted(s: str | None) -> str:
    return "nil" if s is None else '"' + re.sub(r'[\\"\n\r]', lambda m: _OUT[m[0]], s) + '"'


def unquoted(s: str) -> str | None:
    return None if s == "nil" else re.sub(r"\\(.)", lambda m: _IN.get(m[1], m[1]), s[1:-1], flags=re.S)


def line(row) -> str:
    i, p = ("nil" if x is None else str(x) for x in (row[0], row[1]))
    return f"(step {i} {p} (role {quoted(row[2])}) (text {quoted(row[3])}))\n"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def listed(path: str, after: int = 0, upto: int | None = None) -> list[dict]:
    """The files of the lists with numbers in (after, upto], in order."""
    fs, root = place(path)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/lists", allow_not_found=True)) if LIST.match(f.base_name)]
    out = []
    for n in sorted(int(x[:-5]) for x in names):
        if n > after and (upto is None or n <= upto):
            with fs.open_input_stream(f"{root}/lists/{n:012d}.json") as f:
                out += json.loads(f.read())
    return out


def newest(path: str) -> int:
    fs, root = place(path)
    return max((int(f.base_name[:-5]) for f in fs.get_file_info(pafs.FileSelector(f"{root}/lists", allow_not_found=True)) if LIST.match(f.base_name)), default=0)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    low: int | None = None
    high: int | None = None
    nulls: bool = False


def rows_of(path: str, names: tuple[str, ...], tests: list[tuple[str, str, object]] = ()) -> Iterator[tuple]:
    fs, root = place(path)
    at = {"id": 0, "pos": 1, "role": 2}
    fits = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for name in names:
        with fs.open_input_stream(f"{root}/{name}") as f:
            for text in iter_lines(f):
                m = LINE.match(text)
                if not m:
                    raise ValueError(f"{name}: not a step: {text[:80]!r}")
                row = (None if m[1] == "nil" else int(m[1]), None if m[2] == "nil" else int(m[2]), unquoted(m[3]))
                if all(row[at[c]] is not None and fits[op](row[at[c]], v) for c, op, v in tests):
                    yield (*row, unquoted(m[4]))


def iter_lines(stream, size: int = 1 << 20) -> Iterator[str]:
    held = b""
    while part := stream.read(size):
        *lines, held = (held + part).split(b"\n")
        for x in lines:
            yield x.decode()
    if held:
        yield held.decode()


class Reader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files, self.tests = path, files, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        ops = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            op = ops.get(type(f))
            column = f.attribute[0] if op and len(f.attribute) == 1 else None
            if f_value(f) is not None and (column in ("id", "pos") or column == "role" and op == "="):
                self.tests.append((column, op, f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        def may_hold(f: dict) -> bool:
            if f["low"] is None:
                return not any(c == "id" for c, _, _ in self.tests)
            reach = {"=": lambda v: f["low"] <= v <= f["high"], "<": lambda v: f["low"] < v, "<=": lambda v: f["low"] <= v, ">": lambda v: f["high"] > v, ">=": lambda v: f["high"] >= v}
            return all(reach[op](v) for c, op, v in self.tests if c == "id")

        names = [f["name"] for f in listed(self.path) if may_hold(f)]
        return [Files(tuple(names[k : k + self.files])) for k in range(0, len(names), self.files)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from rows_of(self.path, partition.names, self.tests)


def f_value(f: Filter):
    return getattr(f, "value", None)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        return {"list": newest(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return [Files((f["name"],)) for f in listed(self.path, start["list"], end["list"])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from rows_of(self.path, partition.names)

    def commit(self, end: dict) -> None:
        pass


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = place(self.path)
        fs.create_dir(f"{root}/files", recursive=True)
        name, out = f"files/{uuid.uuid4().hex}.steps", None
        low = high = None
        try:
            for row in iterator:
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(line(row).encode())
                if row[0] is not None:
                    low, high = (row[0], row[0]) if low is None else (min(low, row[0]), max(high, row[0]))
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, low, high)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = place(self.path)
        fs.create_dir(f"{root}/lists", recursive=True)
        last, files = newest(self.path), [{"name": m.name, "low": m.low, "high": m.high} for m in messages if m and m.name]
        made = f"{root}/lists/.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps(files).encode())
        fs.move(made, f"{root}/lists/{last + 1:012d}.json")
        if self.overwrite:  # older lists go after the new one is there
            for n in range(1, last + 1):
                if fs.get_file_info(f"{root}/lists/{n:012d}.json").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/lists/{n:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = place(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class Steps(DataSource):
    """``spark.read.format("steps").load(path)``; option ``files``: files of a partition."""

    @classmethod
    def name(cls) -> str:
        return "steps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("files", "16")))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f.name for f in schema] != ["id", "pos", "role", "text"]:
            raise ValueError(f"columns are {SCHEMA}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Steps)
