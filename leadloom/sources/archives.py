"""Zipped registers: the one entry of each archive with a given ending, as lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_INFLATED = 512 * 1024 * 1024


def entry_lines(raw: bytes, ending: str, most: int = MAX_INFLATED) -> Iterator[str]:
    """Lines of the only entry that ends so; encrypted, ambiguous, missing or too large ones are errors."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = [i for i in z.infolist() if i.filename.lower().endswith(ending)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} entries end with {ending}")
        if found[0].flag_bits & 1:
            raise ValueError("the entry is encrypted")
        if found[0].file_size > most:
            raise ValueError("the entry is too large")
        with z.open(found[0]) as f:
            for line in io.TextIOWrapper(f, "utf-8-sig", newline=None):
                yield line.rstrip("\n")


def read_zip_lines(spark: SparkSession, path: str, ending: str = ".csv") -> DataFrame:
    """(file, n, line) of the archives at path: a task inflates one archive at a time and streams its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held: list[str] = []
                start = 0
                for line in entry_lines(raw, ending):
                    held.append(line)
                    if len(held) == 10_000:
                        yield _rows(file, start, held)
                        start, held = start + len(held), []
                if held:
                    yield _rows(file, start, held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, n long, line string")


def _rows(file: str, start: int, lines: list[str]) -> pa.RecordBatch:
    n = pa.array(range(start, start + len(lines)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), n, pa.array(lines)], ["file", "n", "line"])
