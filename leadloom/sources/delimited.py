"""CSV and TSV registers: strict parsing, banner lines, header contracts, closed projections, export."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FIELD = 1_048_576
MAX_COLUMNS = 512
CORRUPT = "_corrupt"


def header_gap(actual: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    """Expected columns that are missing, and columns that weren't expected, whatever the case."""
    have, want = {c.strip().lower() for c in actual}, {c.strip().lower() for c in expected}
    return [c for c in expected if c.strip().lower() not in have], [c for c in actual if c.strip().lower() not in want]


def read_register(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", banner_lines: int = 0) -> DataFrame:
    """Rows of a delimited register, all columns strings, and `_corrupt` with the whole text of ragged rows.

    The header is read and compared with `columns`, whatever their order and case: a column that is
    missing is an error; others of the file are left out. With banner lines the file is read as
    text, the first lines and the header dropped by their position in it, and the rest parsed: fields
    then can't contain line breaks. Without, quoted line breaks are part of a field.
    """
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": str(MAX_FIELD), "maxColumns": str(MAX_COLUMNS)}
    top = spark.read.text(path).limit(banner_lines + 1).collect()
    if len(top) <= banner_lines:
        raise ValueError(f"{path} has no header")
    header = [c.strip().lstrip("\ufeff").strip() for c in next(csv.reader([top[banner_lines][0]], delimiter=delimiter))]
    missing, _ = header_gap(header, columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    kind = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    place = {c.lower(): k for k, c in enumerate(header)}
    wanted = [F.col(f"`{header[place[c.strip().lower()]]}`").alias(c.strip()) for c in columns]
    if not banner_lines:
        rows = spark.read.schema(kind).options(**options, header="true", multiLine="true", enforceSchema="true").csv(path)
        return rows.select(*wanted, CORRUPT)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")).alias("n", "line"))
    body = lines.where((F.col("n") > banner_lines) & (F.trim("line") != ""))
    return body.select(F.from_csv("line", ", ".join(f"`{f.name}` string" for f in kind), options).alias("r")).select("r.*").select(*wanted, CORRUPT)


def closed(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, whatever their case; all others vanish at the scan."""
    keep = {a.lower() for a in allowed}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() in keep])


def forbidden_paths(schema: T.DataType, forbidden: set[str], at: str = "") -> list[str]:
    """Paths of fields with a forbidden name anywhere in a nested schema."""
    if isinstance(schema, T.ArrayType):
        return forbidden_paths(schema.elementType, forbidden, at)
    if isinstance(schema, T.MapType):
        return forbidden_paths(schema.valueType, forbidden, at)
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        here = f"{at}.{f.name}" if at else f.name
        if f.name.lower() in forbidden:
            out.append(here)
        out += forbidden_paths(f.dataType, forbidden, here)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    """All data fields quoted, quotes doubled, a header; one folder of files, written by the tasks."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
