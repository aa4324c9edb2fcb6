"""Tables as immutable folders under a numbered list of versions.

A commit writes its rows to a folder of its own, then the list of folders that make up the new version to a temporary file,
and puts that file in place under the next number by one rename that fails if the number is taken.  Until then
readers see the version before, afterwards the new one, and never anything between; a writer that dies leaves files that
no version names.  Two writers that start from the same version can't both succeed.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one read its version."""


class Versions:
    """One table; ``root`` lies on any file system that Spark reads.  ``by``: columns whose values are folders of their own."""

    def __init__(self, spark: SparkSession, root: str, by: tuple[str, ...] = ()):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, tail: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}" if tail else self.root)

    # ---- readers

    def versions(self) -> list[int]:
        """Numbers of the versions there are, rising."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.root}/versions/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        numbers = self.versions()
        if not numbers or version is not None and version not in numbers:
            raise FileNotFoundError(f"{self.root}: no version{'' if version is None else f' {version}'}")
        e = self.entry(numbers[-1] if version is None else version)
        folders = [f"{self.root}/data/{f}" for f in e["folders"]]
        if not self.by:
            return self.spark.read.schema(e["schema"]).parquet(*folders)
        return self.spark.read.option("basePath", f"{self.root}/data").schema(f"{e['schema']}, `commit` string").parquet(*folders).drop("commit")

    # ---- writers

    def commit(self, df: DataFrame, append: bool = False, base: int | None = None) -> int:
        """Make ``df`` the next version, alone or after the rows of ``base`` (the latest if none is named); its number."""
        numbers = self.versions()
        base = base if base is not None else numbers[-1] if numbers else 0
        old = self.entry(base) if base and append else {"folders": [], "schema": None}
        folder = f"commit={uuid.uuid4().hex}"
        self._write(df, folder)
        schema = old["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self._publish(base + 1, {"folders": [*old["folders"], folder], "schema": schema})
        return base + 1

    def _write(self, df: DataFrame, folder: str) -> None:
        writer = df.write.partitionBy(*self.by) if self.by else df.write
        writer.parquet(f"{self.root}/data/{folder}")

    def _publish(self, number: int, entry: dict) -> None:
        made = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        self._put(made, self._path(f"versions/{number:020d}.json"))

    def _put(self, made, place) -> None:
        """The one step that counts."""
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(made, place, none)
        except Py4JJavaError as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{place.getName()} is taken") from None
            raise

    def clean(self, last: int = 2) -> int:
        """Remove all but the ``last`` versions and the folders that only they name; how many folders went.

        Not to be run beside a writer: a folder that it has written but not published isn't named yet.
        """
        numbers = self.versions()
        stay = {f for n in numbers[-last:] for f in self.entry(n)["folders"]}
        for n in numbers[:-last]:
            self.fs.delete(self._path(f"versions/{n:020d}.json"), False)
        found = [s.getPath() for s in self.fs.listStatus(self._path("data"))] if self.fs.exists(self._path("data")) else []
        gone = [p for p in found if p.getName() not in stay]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)
