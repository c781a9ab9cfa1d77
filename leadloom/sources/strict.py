"""Strict delimited files of any size: read in splits although fields may hold line breaks, every fault named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written
from .delimited import MAX_COLUMNS, MAX_FIELD, header_gap

FAULTS = ("unclosed_quote", "text_after_quote", "quote_in_bare_field", "field_too_large", "too_many_columns", "short_row", "long_row")


def records(spark: SparkSession, path: str, banner_lines: int = 0) -> DataFrame:
    """(file, record, text, unclosed): the records of each file, numbered from 0 after its banner.

    A line begins a record if an even number of quotes stands before it in its file. That number is a
    sum over the file's blocks, one row each, and over the lines before it in its own block, so blocks are
    read side by side. Lines after a quote that is never closed stay single, all of them `unclosed`.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = written(lines.select(F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at")))
    first = lines.groupBy("file", "block").agg(F.min("at").alias("first"))
    lines = lines.join(first, ["file", "block"])
    lines = lines.where(~((F.col("block") == 0) & (F.col("at") - F.col("first") < banner_lines))).drop("first")
    lines = lines.withColumn("line", F.when((F.col("block") == 0), F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))

    def before(value: str) -> Column:
        """Sum over the blocks before, one row per block."""
        return F.coalesce(F.sum(value).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    in_block = Window.partitionBy("file", "block").orderBy("at")
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    blocks = blocks.select("file", "block", before("q").alias("q_before"), F.sum("q").over(Window.partitionBy("file")).alias("q_all"))
    sofar = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("sofar", sofar).join(blocks, ["file", "block"])
    lines = lines.withColumn("begins", ((F.col("q_before") + F.col("sofar")) % 2 == 0).cast("int"))
    begun = F.sum("begins").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    lines = written(lines.select("file", "block", "at", "line", "begins", (F.col("q_all") % 2 == 1).alias("odd"), begun.alias("begun")))
    starts = lines.groupBy("file", "block").agg(F.sum("begins").alias("s"))
    starts = starts.select("file", "block", before("s").alias("s_before"), F.sum("s").over(Window.partitionBy("file")).alias("s_all"))
    lines = lines.join(starts, ["file", "block"]).withColumn("record", F.col("s_before") + F.col("begun") - 1)
    unclosed = F.col("odd") & (F.col("record") == F.col("s_all") - 1)
    lines = lines.withColumn("unclosed", unclosed).withColumn("single", F.when(unclosed, F.col("at")))
    whole = lines.groupBy("file", "record", "unclosed", "single").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), r"\r$", "")
    return whole.select("file", "record", text.alias("text"), "unclosed")


def read_strict(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", banner_lines: int = 0) -> DataFrame:
    """Rows of a register: `columns` (of every file's header, whatever their order and case), _file, _record and _fault.

    _fault is the first of FAULTS that a row has, null for a sound one; a faulty row's columns are null,
    never padded or cut. Blank lines are no rows. Files whose headers differ are read each by its
    own; one that lacks a column is an error.
    """
    d = "\\t" if delimiter == "\t" else "\\" + delimiter
    raw = records(spark, path, banner_lines).where(F.trim("text") != "")
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), "text"), F.lit(f'{d}("(?:[^"]++|"")*+"[^{d}]*+|[^{d}]*+)'), F.lit(1))
    raw = written(raw.withColumn("fields", fields))
    heads = raw.where("record = 0").select("file", F.transform("fields", lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit(""))))).alias("head"))
    kinds = [r["head"] for r in heads.select("head").distinct().collect()]  # one of each layout
    if not kinds:
        raise ValueError(f"{path} has no header")
    for k in kinds:
        missing, _ = header_gap(k, columns)
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}")
    rows = raw.where("record > 0").join(heads, "file")
    quoted = lambda x: x.startswith('"')
    n, wide = F.size("fields"), F.size("head")
    fault = (
        F.when(F.col("unclosed"), "unclosed_quote")
        .when(F.exists("fields", lambda x: quoted(x) & ~x.rlike('(?s)^"(?:[^"]++|"")*+"$')), "text_after_quote")
        .when(F.exists("fields", lambda x: ~quoted(x) & F.contains(x, F.lit('"'))), "quote_in_bare_field")
        .when(F.exists("fields", lambda x: F.length(x) > MAX_FIELD), "field_too_large")
        .when(n > MAX_COLUMNS, "too_many_columns")
        .when(n < wide, "short_row")
        .when(n > wide, "long_row")
    )
    plain = F.transform("fields", lambda x: F.when(quoted(x), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = rows.withColumn("_fault", fault).withColumn("values", F.when(F.col("_fault").isNull(), plain))
    at = lambda c: F.try_element_at("values", F.array_position("head", c.strip().lower()).cast("int"))
    return rows.select(*[at(c).alias(c.strip()) for c in columns], F.col("file").alias("_file"), F.col("record").alias("_record"), "_fault")
