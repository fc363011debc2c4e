"""Tables that change together, in a folder that all executors share: HDFS, an object store, a local folder.

Each change writes new folders beside the old ones and then a mark, a small file that names the folders of every
table. A reader takes the newest mark, so it sees all of a change or nothing of it, and a failure on the way, of
an executor or of the driver, leaves the tables as they were. Marks are numbered and never written over: of two
writers that go on from the same mark, the second fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Folders of a table, beyond which a change writes it anew as one; marks that are kept.
FOLDERS, MARKS = 32, 3


class State:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(f"{self.root}/marks").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.root}/marks/*.json")) or []
        return sorted(int(f.getPath().getName()[:-5]) for f in found)

    def _mark(self, number: int) -> dict[str, list[str]]:
        stream = self._files.open(self._path(f"{self.root}/marks/{number:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self) -> dict[str, list[str]]:
        """The folders of each table, as of the newest mark."""
        numbers = self.numbers()
        return self._mark(numbers[-1]) if numbers else {}

    def read(self, name: str, schema: str) -> DataFrame:
        """A table; an empty one where it has not been written."""
        folders = self.tables().get(name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def write(self, df: DataFrame) -> str:
        """The rows in a new folder that no mark names yet; to be given to change()."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def at(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def change(self, replace: Mapping[str, DataFrame | str] | None = None, append: Mapping[str, DataFrame | str] | None = None) -> None:
        """Puts tables in place of the old ones, or rows behind them, all at once. Each is a frame, or a folder
        that write() gave."""
        numbers = self.numbers()
        now = self._mark(numbers[-1]) if numbers else {}
        put = lambda x: x if isinstance(x, str) else self.write(x)
        new = {k: list(v) for k, v in now.items()}
        for name, x in (replace or {}).items():
            new[name] = [put(x)]
        for name, x in (append or {}).items():
            folders = [*new.get(name, []), put(x)]
            if len(folders) > FOLDERS:
                folders = [self.write(self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]))]
            new[name] = folders
        number = numbers[-1] + 1 if numbers else 0
        out = self._files.create(self._path(f"{self.root}/marks/{number:09d}.json"), False)  # fails where it exists
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        self._clean([*numbers, number])

    def _clean(self, numbers: list[int]) -> None:
        """Drops marks but the newest, and folders that only dropped marks name."""
        old, kept = numbers[:-MARKS], numbers[-MARKS:]
        if not old:
            return
        used = {f for n in kept for folders in self._mark(n).values() for f in folders}
        gone = {f for n in old for folders in self._mark(n).values() for f in folders} - used
        for f in gone:
            self._files.delete(self._path(f"{self.root}/{f}"), True)
        for n in old:
            self._files.delete(self._path(f"{self.root}/marks/{n:09d}.json"), False)
