"""Ordered rule chains: the first rule that holds gives a row its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]  # kind, reason, predicate that rejects


def verdict(df: DataFrame, rules: list[Rule], kind: str = "kind", reason: str = "reason") -> DataFrame:
    """df with the kind and reason of the first rule that rejects the row, null for accepted ones.

    A predicate that is null doesn't reject. One CASE expression gives both: later rules aren't evaluated, and none is twice.
    """
    first = F.lit(None).cast("int")
    for i, (_, _, rejects) in reversed(list(enumerate(rules))):
        first = F.when(F.coalesce(rejects, F.lit(False)), i).otherwise(first)
    found = computed_once(df.select("*", first.alias("_rule")), "_rule")
    names = [F.array(*[F.lit(rule[part]) for rule in rules]) for part in (0, 1)]
    return found.select(*df.columns, F.get(names[0], F.col("_rule")).alias(kind), F.get(names[1], F.col("_rule")).alias(reason))


def all_failures(failures: list[tuple[str, Column]]) -> Column:
    """Array of the names of every predicate that holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in failures]))


def tally(df: DataFrame, kind: str = "kind", deduped: str | None = None) -> DataFrame:
    """Rows per kind; accepted ones count as `accepted`, those flagged in `deduped` as `deduped`."""
    k = F.coalesce(F.col(kind), F.lit("accepted"))
    if deduped:
        k = F.when(F.col(kind).isNull() & F.col(deduped), F.lit("deduped")).otherwise(k)
    return df.groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


def case_map(c: Column, mapping: dict, default=None) -> Column:
    """CASE over a small catalog."""
    out = F.lit(default)
    for k, v in reversed(mapping.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def computed_once(df, *names: str):
    """df with the named columns behind a generator: expressions that use them several times don't repeat their work."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))
