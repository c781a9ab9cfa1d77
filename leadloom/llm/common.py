"""Helpers that several operators share: shared-folder tables, connected components, text columns."""

from __future__ import annotations

import gc
import re
import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal key of a document whose doc_id is null: sorts before all others.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as spark.checkpoint.dir or the context names it.

    Without one, a local session gets a folder of its machine; a cluster's executors would each
    write to their own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints/leadloom").rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have `rows` rows at most: whole texts are long, and a task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans run within have no generated method of more than the 8,000 bytes that the JVM compiles.

    A stage of many wide columns and several joins is one longer method otherwise, and is interpreted.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, compression: str = "lz4") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the rereading of files, never the recomputation of
    earlier stages. The table is removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    gc.collect()
    jvm.System.gc()  # lets Spark remove the shuffle files of the finished stages
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that materialize() has returned and nothing will read again."""
    files = table.inputFiles()
    if not files:
        return
    jvm = table.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def doc_key(name: str = "doc_id") -> Column:
    """The doc_id as a key that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def key_to_id(c: Column) -> Column:
    return F.when(c != NULL_ID, c)


def lowest_hashed(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The `rows` rows whose key hashes lowest, of about `total`: the same ones however df is partitioned.

    A threshold lets through twice as many as are wanted, so what the tasks send to be ordered
    doesn't grow with the input.
    """
    u = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, 2 * rows / max(1, total))
    return df.where(u < int(share * (1 << 40))).orderBy(u, *df.columns).limit(rows)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node of its component.

    Alternating large-star and small-star steps: each step sends only (node, neighbour) pairs and a
    minimum per node, so no neighbourhood is ever gathered. A node with very many neighbours is
    joined to one row, which AQE splits when it is skewed. Each round's pairs are a table in the
    shared folder, which goes when the next round's is written. Empty input gives an empty result; self-loops only name their node.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    pairs = _ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    pairs = materialize(pairs)
    before = None
    while True:
        spent = pairs
        pairs = materialize(_small_star(_large_star(spent)))
        discard(spent)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = pairs.union(pairs.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    linked = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(linked.union(least.select("u", F.col("m").alias("v"))))
