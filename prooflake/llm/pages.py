"""Sorted arrays in files of the shared folder, for tasks that look keys up.

Spark sorts the entries (lang, part, key, v) over range partitions; each task writes its run as pages of 64-bit keys and their
values (32-bit numbers or byte strings) to a file of its own and reports where its pages begin.  Only reported pages are ever read, so a lost or repeated
attempt leaves at most a file that nobody opens.  A lookup bisects the first keys of the pages, then the page.  Where the
folder is mounted, pages are mapped: the machine's page cache holds one copy for all workers and may drop it at any time.
On other stores that pyarrow can open, a worker holds ``HELD`` pages at most and reads others again when it needs them.
The index has one row a page; it is all that goes through the driver.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

#: Entries of a page; pages (of 12 bytes an entry for numbers) that a worker holds; files that it keeps open.
PAGE, HELD, OPEN = 1 << 16, 128, 256
_INDEX = "lang string, part int, first long, file string, at long, n long, size long"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]:", "s3:", path)
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


class _File:
    """Pages in the making: entries of one (lang, part) until a page is full or the next (lang, part) begins."""

    def __init__(self, root: str, page: int):
        self.page = page
        self.fs, base = place(root)
        self.fs.create_dir(base)
        self.name = uuid.uuid4().hex
        self.out, self.path = None, f"{base}/{self.name}"
        self.at, self.size, self.of = 0, 0, None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: list[tuple] = []

    def add(self, of: tuple[str, int], key: np.ndarray, v: np.ndarray) -> None:
        if of != self.of:
            self.flush()
            self.of = of
        self.held.append((key, v))
        self.size += len(key)
        if self.size >= self.page:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        key, v = (np.concatenate(x) for x in zip(*self.held))
        data = key.astype("<i8").tobytes()
        if v.dtype == object:  # byte strings: their ends, then all of them
            data += np.cumsum(np.fromiter(map(len, v), np.int64, len(v))).astype("<i8").tobytes() + b"".join(v)
        else:
            data += v.astype("<f4").tobytes()
        data += bytes(-len(data) % 8)
        self.out = self.out or self.fs.open_output_stream(self.path)
        self.out.write(data)
        self.rows.append((*self.of, int(key[0]), self.name, self.at, len(key), len(data)))
        self.at += len(data)
        self.held, self.size = [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        if self.out:
            self.out.close()
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*self.rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "part", "first", "file", "at", "n", "size"])


def _written(root: str, page: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _File(root, page)
        for b in batches:
            lang, part = b.column("lang").to_pandas().to_numpy(), b.column("part").to_numpy()
            key, v = b.column("key").to_numpy(), b.column("v").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((lang[1:] != lang[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(key)]):
                if hi > lo:
                    file.add((lang[lo], int(part[lo])), key[lo:hi], v[lo:hi])
        yield file.close()

    return run


def store(entries: DataFrame, root: str, page: int = PAGE) -> Pages:
    """The pages of ``entries`` (lang, part int, key long, v float or binary; no nulls, keys distinct in a part), under ``root``."""
    runs = entries.select("lang", "part", "key", "v").repartitionByRange("lang", "part", "key").sortWithinPartitions("lang", "part", "key")
    return Pages(root, runs.mapInArrow(_written(root, page), _INDEX).toPandas())


@functools.lru_cache(OPEN)
def _opened(root: str, name: str) -> pa.NativeFile:
    fs, base = place(root)
    path = f"{base}/{name}"
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


@functools.lru_cache(HELD)
def _page(root: str, name: str, at: int, size: int, n: int) -> tuple[np.ndarray, pa.Buffer]:
    """Keys of a page, and the bytes after them."""
    f = _opened(root, name)
    f.seek(at)
    data = f.read_buffer(size)  # of a mapped file a view
    return np.frombuffer(data, "<i8", n), data.slice(8 * n)


_root = ""


def _using(root: str) -> None:
    """Let go of the files of an earlier table: workers serve many tasks in turn."""
    global _root
    if root != _root:
        _page.cache_clear()
        _opened.cache_clear()
        _root = root


class Pages:
    """Where the pages are: per (lang, part) their first keys, files, places and sizes."""

    def __init__(self, root: str, index: pd.DataFrame):
        self.root = root
        index = index.sort_values(["lang", "part", "first"], kind="stable")
        self.of = {of: tuple(g[c].to_numpy() for c in ("first", "file", "at", "size", "n")) for of, g in index.groupby(["lang", "part"], sort=False)}

    def _hits(self, lang: str, part: int, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, pa.Buffer]]:
        """By page: which keys have an entry in it, the entries' places, how many entries it has and what follows its keys."""
        if (lang, part) not in self.of or not len(key):
            return
        _using(self.root)
        first, file, at, size, n = self.of[lang, part]
        page = np.searchsorted(first, key, "right") - 1
        by = np.argsort(page, kind="stable") if len(first) > 1 else np.arange(len(key))
        cut = np.flatnonzero(np.diff(page[by])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(key)]):
            k, own = page[by[lo]], by[lo:hi]
            if k < 0:  # before the first page
                continue
            keys, rest = _page(self.root, file[k], int(at[k]), int(size[k]), int(n[k]))
            i = np.searchsorted(keys, key[own])
            i[i == len(keys)] = 0
            ok = keys[i] == key[own]
            yield own[ok], i[ok], len(keys), rest

    def find(self, lang: str, part: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it has an entry, and its number (else 0)."""
        hit, value = np.zeros(len(key), bool), np.zeros(len(key))
        for own, i, n, rest in self._hits(lang, part, key):
            hit[own] = True
            value[own] = np.frombuffer(rest, "<f4", n)[i]
        return hit, value

    def find_bytes(self, lang: str, part: int, key: np.ndarray) -> list[bytes | None]:
        """Each key's byte string, or None."""
        out: list[bytes | None] = [None] * len(key)
        for own, i, n, rest in self._hits(lang, part, key):
            ends = np.frombuffer(rest, "<i8", n)
            begin = np.where(i > 0, ends[i - 1], 0)
            blob = memoryview(rest)[8 * n :]
            for k, a, b in zip(own.tolist(), begin.tolist(), ends[i].tolist()):
                out[k] = bytes(blob[a:b])
        return out
