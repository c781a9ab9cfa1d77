"""Payloads to other systems: a sink that shows all of a write's tasks or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class DeliveryWriter(DataSourceWriter):
    """Each task writes one file of JSON lines beside the outbox; commit moves the files of the tasks that Spark
    accepted into it and writes a manifest last; abort deletes them. A task that is tried again writes a file of its own."""

    def __init__(self, options: dict, overwrite: bool):
        self.url, self.run = options["path"], options.get("run", uuid.uuid4().hex)
        if overwrite:
            raise ValueError("deliveries are only appended")

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        files, path = pafs.FileSystem.from_uri(self.url)
        return files, "/".join([path, *names])

    def write(self, iterator: Iterator[Row]) -> _Part:
        task = TaskContext.get()
        files, folder = self._at("_pending", self.run)
        files.create_dir(folder)
        path, n = f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}.jsonl", 0
        with files.open_output_stream(path) as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        return _Part(path, n)

    def commit(self, messages: list[_Part | None]) -> None:
        files, outbox = self._at(self.run)
        if files.get_file_info(f"{outbox}/_MANIFEST.json").type != pafs.FileType.NotFound:
            self.abort(messages)  # this run has been delivered before
            return
        files.create_dir(outbox)
        parts = [m for m in messages if m is not None and m.rows]
        for m in parts:
            files.move(m.path, f"{outbox}/{m.path.rpartition('/')[2]}")
        with files.open_output_stream(f"{outbox}/_MANIFEST.json") as out:
            out.write(json.dumps({"run": self.run, "files": len(parts), "rows": sum(m.rows for m in parts)}).encode())
        self._clean()

    def abort(self, messages: list[_Part | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, pending = self._at("_pending", self.run)
        if files.get_file_info(pending).type != pafs.FileType.NotFound:
            files.delete_dir(pending)


class Delivery(DataSource):
    """spark.dataSource.register(Delivery); df.write.format("delivery").mode("append").options(path=..., run=...).save()

    path is a URI that driver and executors share. A run that is written again under its name adds nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def writer(self, schema: StructType, overwrite: bool) -> DeliveryWriter:
        return DeliveryWriter(self.options, overwrite)
