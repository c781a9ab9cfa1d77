"""A keyed table that batches are merged into: idempotent, optimistic, rewritten by buckets."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import dropped, written

#: Buckets of a key's hash: a merge rewrites those that its rows fall into.
BUCKETS = 64
#: Times that a merge is planned anew because another one was committed first.
TRIES = 20


@dataclass
class Version:
    """A committed state: its number, the folder of every bucket, and the last batch of each writer."""

    number: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


@dataclass
class Merged:
    """What a merge did. A replayed batch did nothing."""

    created: int = 0
    updated: int = 0
    unchanged: int = 0
    ambiguous: int = 0
    replayed: bool = False
    replanned: int = 0


class UpsertTable:
    """Rows of `schema` under `key`, in a folder that driver and executors share.

    A version is one small file, created under the next number if nobody else has; it names the folders of
    the buckets and, for each writer, the last batch that it holds. So a batch that comes again is seen, and a batch is
    either in a version or not at all. A merge that finds its number taken is planned anew on what the
    other one has left: what it wanted to create is then perhaps an update, or nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.n = spark, path.rstrip("/"), schema, key, buckets

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> Version:
        at, files = self._files(f"{self.path}/versions")
        numbers = [int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()] if files.exists(at) else []
        if not numbers:
            return Version()
        top = max(numbers)
        at, files = self._files(f"{self.path}/versions/{top:012d}")
        stream = files.open(at)
        try:
            return Version(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, v: Version) -> bool:
        """Whether the version's number was free. A file of another name is written first, as a half-written version must not be seen."""
        text = json.dumps({"number": v.number, "buckets": v.buckets, "writers": v.writers})
        part, files = self._files(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = files.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        at, _ = self._files(f"{self.path}/versions/{v.number:012d}")
        done = not files.exists(at) and files.rename(part, at)
        if not done:
            files.delete(part, False)
        return done

    def read(self, version: Version | None = None, buckets: list[str] | None = None) -> DataFrame:
        v = version or self.current()
        paths = sorted({p for b, p in v.buckets.items() if buckets is None or b in buckets})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def merge(self, batch: DataFrame, order: str | None = None, writer: str = "batch", batch_id: int | None = None) -> Merged:
        """Merge rows into the table. Values that aren't null or blank win; of rows with one key the last by `order`.

        Rows without a key are added as they are. A key that the table holds twice is ambiguous: its
        rows stay and the batch's are left out. Without a batch_id nothing is known of replays.
        """
        fields = [f.name for f in self.schema.fields if f.name != self.key]
        rows = batch.where(F.col(self.key).isNotNull())
        place = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in fields])
        new = rows.groupBy(self.key).agg(F.max(F.struct(place.alias("p"), F.struct(*fields).alias("v"))).alias("r")).select(self.key, *[F.col("r.v")[c].alias(f"new_{c}") for c in fields], F.lit(True).alias("_new"))
        loose = batch.where(F.col(self.key).isNull()).select(self.schema.names)
        touched = [str(r[0]) for r in batch.select(self._bucket()).distinct().collect()]  # `buckets` numbers at most
        for attempt in range(TRIES):
            v = self.current()
            if batch_id is not None and v.writers.get(writer, -1) >= batch_id:
                return Merged(replayed=True, replanned=attempt)
            if not touched:
                return Merged()
            old = self.read(v, touched)
            twice = old.where(F.col(self.key).isNotNull()).groupBy(self.key).count().where("count > 1").select(self.key, F.lit(True).alias("_twice"))
            j = old.withColumn("_old", F.lit(True)).join(new, self.key, "full").join(twice, self.key, "left")
            kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}
            given = {c: F.when(F.trim(f"new_{c}") != "", F.col(f"new_{c}")) if kinds[c] == "string" else F.col(f"new_{c}") for c in fields}
            take = F.col("_new").isNotNull() & F.col("_twice").isNull()
            after = [F.when(take, F.coalesce(given[c], F.col(c))).otherwise(F.col(c)).alias(c) for c in fields]
            same = F.lit(True)
            for c in fields:
                same = same & (given[c].isNull() | given[c].eqNullSafe(F.col(c)))
            action = F.when(F.col("_new").isNull(), "kept").when(F.col("_twice").isNotNull(), "ambiguous").when(F.col("_old").isNull(), "created").when(same, "unchanged").otherwise("updated")
            out = j.select(self.key, *after, action.alias("_action")).select(*self.schema.names, "_action").union(loose.withColumn("_action", F.lit("created")))
            seen = Observation()
            counts = [F.count_if(F.col("_action") == a).alias(a) for a in ("created", "updated", "unchanged")]
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            out.observe(seen, *counts).withColumn("_bucket", self._bucket()).drop("_action").write.partitionBy("_bucket").parquet(folder)
            ambiguous = new.join(twice, self.key).count() if not twice.isEmpty() else 0
            at, files = self._files(folder)
            made = {s.getPath().getName().partition("=")[2]: s.getPath().toString() for s in files.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
            buckets = {b: p for b, p in v.buckets.items() if b not in touched} | made
            writers = v.writers | ({writer: batch_id} if batch_id is not None else {})
            if self._commit(Version(v.number + 1, buckets, writers)):
                return Merged(**seen.get, ambiguous=ambiguous, replanned=attempt)
            files.delete(at, True)
        raise PySparkException(f"{self.path}: other merges came first {TRIES} times")

    def sink(self, order: str | None = None):
        """For writeStream.foreachBatch: every batch once, however often Spark hands it over. `writer` is the query's id."""

        def batch(df: DataFrame, batch_id: int) -> None:
            writer = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
            if self.current().writers.get(writer, -1) >= batch_id:
                return
            staged = written(df)  # read once, so that what the stream observes is counted once
            self.merge(staged, order, writer, batch_id)
            dropped(staged)

        return batch
