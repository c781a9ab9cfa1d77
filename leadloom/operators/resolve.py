"""Entity resolution: known keys, duplicates, claims of several sources, change plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_known(df: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is in the index under the same name.

    One anti-join per key: a single join on "this key or that one" would compare every pair. Null
    keys match nothing.
    """
    return reduce(lambda d, k: d.join(index.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, df)


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with `duplicate`: false for the first row of each key in the given order."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def best_per_entity(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The row with the largest value per entity: an aggregate, so rows meet already reduced."""
    every = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(every, value).alias("r")).select("r.*")


def capped(df: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first `cap` rows by an order that ends with a unique key (a top-k)."""
    return df.orderBy(*order).limit(cap)


def claims(candidates: DataFrame, key: str, priority: Column, *order: Column) -> DataFrame:
    """candidates with `winner`, the source that claims each entity first, and `claimed`.

    Rows with a null key always stand for themselves. Each entity's group is aggregated to its first
    row and joined back, so no window holds a group.
    """
    place = F.struct(priority.alias("p"), *[o.alias(f"o{k}") for k, o in enumerate(order)])
    first = candidates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(place.alias("place"), F.col("source").alias("source"))).alias("first"))
    j = candidates.withColumn("place", place).join(first, key, "left")
    own = F.col(key).isNull() | (F.col("place") == F.col("first.place"))
    return j.select(*candidates.columns, F.coalesce("first.source", "source").alias("winner"), own.alias("claimed"))


def plan_changes(existing: DataFrame, desired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """create, update, noop or orphan for every key of either side, with the names of changed fields.

    Equal nulls are equal. A key that occurs twice in `existing` is ambiguous: nothing is chosen.
    """
    n = existing.groupBy(key).agg(F.count("*").alias("matches"), *[F.min(f).alias(f"old_{f}") for f in fields])
    j = desired.select(key, *fields, F.lit(True).alias("wanted")).join(n, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]))
    action = (
        F.when(F.col("wanted").isNull(), "orphan")
        .when(F.col("matches") > 1, "ambiguous")
        .when(F.col("matches").isNull(), "create")
        .when(F.size(changed) > 0, "update")
        .otherwise("noop")
    )
    return j.select(key, action.alias("action"), F.when(action == "update", F.array_join(changed, ",")).otherwise("").alias("changed"))


def apply_plan(existing: DataFrame, desired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """existing after the actions of plan_changes(): desired values win where they aren't null or blank, missing rows are added.

    Rows whose key is ambiguous stay as they are, and nothing is added for it. Null keys match nothing:
    each is a row of its own. A key that `desired` repeats has no one value to take: it is left alone, too.
    """
    kinds = dict(desired.dtypes)
    repeated = lambda df: df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    unclear = repeated(existing).union(repeated(desired)).distinct().withColumn("_unclear", F.lit(True))
    old = existing.select(key, *[F.col(f).alias(f"old_{f}") for f in fields]).join(unclear, key, "left")
    new = desired.select(key, *fields).join(unclear, key, "left_anti")
    j = old.join(new, key, "full")
    given = lambda f: F.when(F.trim(f) != "", F.col(f)) if kinds[f] == "string" else F.col(f)
    return j.select(key, *[F.coalesce(given(f), F.col(f"old_{f}")).alias(f) for f in fields])


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """existing and the new rows whose keys it lacks; of new rows with the same keys the first by `order`, then by all columns.

    A null in a key equals nothing, so each such row is added. Columns that one side lacks are null.
    """
    given = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    place = F.struct(*order, *[c for c in new.columns if c not in order])
    first = new.where(given).groupBy(*keys).agg(F.min(place).alias("_first")).select(*[F.col("_first")[c].alias(c) for c in new.columns])
    fresh = first.join(existing.select(*keys), keys, "left_anti").select(*new.columns).union(new.where(f"NOT ({given})"))
    return existing.unionByName(fresh, allowMissingColumns=True)


def broken_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and isn't in parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent, child[child_key] == parent[parent_key], "left_anti")
