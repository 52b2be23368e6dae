"""The run ledger as a Spark data source: batch and stream reads, atomic appends.

    spark.dataSource.register(LedgerSource)
    runs.write.format("run_ledger").mode("append").save(path)
    spark.read.format("run_ledger").load(path)
    spark.readStream.format("run_ledger").load(path)

A ledger is a folder that all executors share.  Each task of a write puts its rows
in a file of its own; the driver then names those files in the next commit file,
which comes to be whole or not at all, under a number that only one writer can
take.  Readers see committed files alone.  A write that fails leaves nothing; files
of a writer that died are never named and can be swept.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "timestamp string, git_sha string, config_hash string, data_snapshot_hash string, seed long, config string, metrics string, notes string"
FIELDS = tuple(f.split()[0] for f in SCHEMA.split(", "))
REQUIRED = tuple(f for f in FIELDS if f not in ("notes", "git_sha"))  # what no run may lack


def local(path: str) -> str:
    return path.removeprefix("file://")


def commits(path: str, after: int = 0) -> list[int]:
    """The numbers of the commits beyond ``after``, ascending."""
    folder = f"{path}/commits"
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted(n for x in names if x.endswith(".json") and (n := int(x.removesuffix(".json"))) > after)


def _files(path: str, number: int) -> list[dict]:
    with open(f"{path}/commits/{number:012d}.json", encoding="utf-8") as f:
        return json.load(f)["files"]


def run_count(path: str) -> int:
    """The number of runs logged, from the commits alone."""
    path = local(path)
    return sum(x["rows"] for n in commits(path) for x in _files(path, n))


def sweep(path: str) -> int:
    """Remove files that no commit names, of writers that ended badly; no write
    may be under way.  Gives their number."""
    path = local(path)
    named = {x["name"] for n in commits(path) for x in _files(path, n)}
    lost = [x for x in os.listdir(f"{path}/runs") if x not in named] if os.path.isdir(f"{path}/runs") else []
    for x in lost:
        os.remove(f"{path}/runs/{x}")
    return len(lost)


@dataclass
class FilePart(InputPartition):
    name: str
    rows: int

    def __init__(self, name: str, rows: int):
        super().__init__(name)
        self.name, self.rows = name, rows


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def _rows(path: str, part: FilePart) -> Iterator[tuple]:
    seen = 0
    with open(f"{path}/runs/{part.name}", encoding="utf-8") as f:
        for line in f:
            row = json.loads(line)
            if set(row) != set(FIELDS):
                raise ValueError(f"{part.name}: the fields are not those of a run")
            seen += 1
            yield tuple(row[c] for c in FIELDS)
    if seen != part.rows:
        raise ValueError(f"{part.name} has {seen} runs, its commit says {part.rows}")


class LedgerReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePart(x["name"], x["rows"]) for n in commits(self.path) for x in _files(self.path, n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.path, partition) if isinstance(partition, FilePart) else iter(())


class LedgerStreamReader(DataSourceStreamReader):
    """Offsets are commit numbers; a commit comes whole, in one batch."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(commits(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        numbers = [n for n in commits(self.path, start["commit"]) if n <= end["commit"]]
        return [FilePart(x["name"], x["rows"]) for n in numbers for x in _files(self.path, n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass  # a ledger keeps all


class LedgerWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        """One task's rows, checked, in a file of its own."""
        os.makedirs(f"{self.path}/runs", exist_ok=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        at = f"{self.path}/runs/{name}"
        try:
            with open(at, "x", encoding="utf-8") as f:
                for row in iterator:
                    value = {c: row[c] for c in FIELDS}
                    lacking = [c for c in REQUIRED if value[c] is None or value[c] == ""]
                    if lacking:
                        raise ValueError(f"missing fields: {', '.join(lacking)}")
                    f.write(json.dumps(value, sort_keys=True) + "\n")
                    rows += 1
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.remove(at)
            raise
        if not rows:
            os.remove(at)
        return Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        if not files:
            return
        folder = f"{self.path}/commits"
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with open(draft, "x", encoding="utf-8") as f:
            json.dump({"files": files}, f)
            f.flush()
            os.fsync(f.fileno())
        number = max(commits(self.path), default=0)
        while True:
            number += 1
            try:
                os.link(draft, f"{folder}/{number:012d}.json")  # fails where another writer took the number
                break
            except FileExistsError:
                continue
        os.remove(draft)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.path}/runs/{m.name}"):
                os.remove(f"{self.path}/runs/{m.name}")


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_ledger"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a run ledger needs a path")
        return local(self.options["path"])

    def reader(self, schema) -> LedgerReader:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [tuple(f.replace(" long", " bigint").split()) for f in SCHEMA.split(", ")]:
            raise ValueError("a run ledger has one schema")
        return LedgerReader(self._path())

    def streamReader(self, schema) -> LedgerStreamReader:
        return LedgerStreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is appended to, never overwritten")
        lacking = [c for c in FIELDS if c not in schema.names]
        if lacking:
            raise ValueError(f"missing fields: {', '.join(lacking)}")
        return LedgerWriter(self._path())


def register(spark) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(LedgerSource)
