"""Versioned publication: tables of one folder become visible together, by a numbered commit that names them.

Data is written under names of its own and never overwritten. A commit is one small file, created only if its number is
still free, so that of two writers one fails, and readers see a version entirely or not at all. A reader opens a version
once and keeps to it: later commits add files and delete none, until `vacuum`."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

READY, DEGRADED = "ready", "degraded"


@dataclass(frozen=True)
class Version:
    number: int
    status: str
    tables: dict[str, str]
    about: dict = field(default_factory=dict)


class Published:
    """The versions of a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas: dict[str, str] = {}  # commits carry them, so that no file is opened to infer one

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, table: DataFrame, name: str, partition_by: str | None = None, row_group: int = 128 << 20) -> str:
        """Writes a table that no version has yet; a commit may name it by what is returned. row_group: bytes that a reader
        of its files may hold at once."""
        at = f"data/{name}-{uuid.uuid4().hex[:12]}"
        table.write.option("parquet.block.size", row_group).parquet(f"{self.path}/{at}", partitionBy=partition_by, compression="zstd")
        self.schemas[at] = table.schema.json()
        return at

    def table(self, at: str) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(self.schemas[at]))) if at in self.schemas else self.spark.read
        return reader.parquet(f"{self.path}/{at}")

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("commits") if n.endswith(".json"))

    def version(self, number: int) -> Version:
        said = json.loads(self._read(f"commits/{number:012d}.json"))
        self.schemas.update(said["schemas"])
        return Version(number, said["status"], said["tables"], said["about"])

    def latest(self) -> Version | None:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def commit(self, tables: dict[str, str], status: str = READY, about: dict | None = None, after: Version | None = None) -> Version:
        """Publishes the version behind `after`. Fails if that is no longer the latest one."""
        number = (after.number if after else 0) + 1
        fs, path = self._at(f"commits/{number:012d}.json")
        # the file appears under its number only when it is whole, and only if no other has it
        draft = self._at(f"drafts/{uuid.uuid4().hex}.json")[1]
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"status": status, "tables": tables, "about": about or {}, "schemas": {p: self.schemas[p] for p in tables.values() if p in self.schemas}}).encode()))
        out.close()
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise ValueError(f"version {number} was published by another writer")
        return Version(number, status, tables, about or {})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions older than the last `keep` and the data that none of those names; returns how many tables went.
        Data of a build that has not committed yet goes as well: run it where no build runs."""
        numbers = self.numbers()
        held = {p for n in numbers[-keep:] for p in self.version(n).tables.values()}
        gone = [n for n in self._names("data") if f"data/{n}" not in held]
        for name in [*(f"data/{n}" for n in gone), *(f"commits/{n:012d}.json" for n in numbers[:-keep])]:
            fs, path = self._at(name)
            fs.delete(path, True)
        return len(gone)

