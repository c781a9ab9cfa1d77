"""Merkle manifest of a dataset: digests of rows, one ternary tree per source, one tree over the sources, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

#: Children of a node.
ARITY = 3
#: Levels that one round of combining builds: a block has at most ARITY ** LEVELS nodes of its lowest level.
LEVELS = 5
#: Columns that a leaf binds, in order.
BOUND = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree whose leaves are the roots of all others.
TOP = "*"

_BLOCK = "tree string, block long, last boolean, size long, levels array<array<string>>"
_PATH = "tree string, idx long, digest string, lefts array<string>, rights array<string>, subroot string, root string"


def digest_of(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: `-` for null, else the UTF-8 byte count, a colon and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the CRC-32 of the decimal doc_id is even; a null id's isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _width(size: int, level: int) -> int:
    """Nodes on a level of a tree with `size` nodes on level 0."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


class _Partial:
    """What has arrived of a block: nodes by level, and parents that still wait for children.

    A digest is an event: it goes to its parent's slot of its number. The parent that has as many
    children as the tree's size gives it is hashed and arrives in turn, so ancestors come out as soon
    as their last child is there, in whatever order the children come.
    """

    __slots__ = ("nodes", "size", "waiting")

    def __init__(self, size: int):
        self.size = size
        self.nodes: list[dict[int, str]] = [{} for _ in range(LEVELS + 1)]
        self.waiting: dict[tuple[int, int], dict[int, str]] = {}

    def arrive(self, idx: int, digest: str, level: int = 0) -> _Partial:
        while True:
            self.nodes[level][idx] = digest
            width = _width(self.size, level)
            if level == LEVELS or width == 1:
                return self
            parent = idx // ARITY
            children = self.waiting.setdefault((level, parent), {})
            children[idx] = digest
            if len(children) < min(ARITY, width - ARITY * parent):
                return self
            del self.waiting[level, parent]
            idx, digest, level = parent, _hash([children[k] for k in sorted(children)]), level + 1

    def merge(self, other: _Partial) -> _Partial:
        """The children that wait on the other side arrive here; its finished nodes need no second look."""
        for level, nodes in enumerate(other.nodes):
            self.nodes[level].update(nodes)
        for (level, _), children in other.waiting.items():
            for idx, digest in children.items():
                self.arrive(idx, digest, level)
        return self

    def levels(self) -> list[list[str]]:
        return [[nodes[k] for k in sorted(nodes)] for nodes in self.nodes if nodes]


def _combined(nodes: DataFrame) -> DataFrame:
    """One row per block of (tree, size, idx, digest): the block's nodes on each of its levels, lowest first.

    The combining starts where the nodes lie, so what is shuffled are the parents left open there.
    """
    def block(r) -> tuple:
        return (r["tree"], r["idx"] // ARITY**LEVELS), (r["size"], r["idx"], r["digest"])

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rdd: RDD = nodes.select("tree", "size", "idx", "digest").rdd.map(block)
    done = rdd.combineByKey(
        lambda v: _Partial(v[0]).arrive(v[1], v[2]), lambda c, v: c.arrive(v[1], v[2]), _Partial.merge, tasks
    )

    def row(item: tuple) -> tuple:
        (tree, k), c = item
        if c.waiting:
            raise ValueError(f"tree {tree}: children of block {k} are missing")
        return tree, k, _width(c.size, LEVELS) == 1, c.size, c.levels()

    return materialize(nodes.sparkSession.createDataFrame(done.map(row), _BLOCK, verifySchema=False))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `idx`, the row's number within its tree by `order` (nulls first), and `size`, the tree's rows.

    The rows are sorted by ranges, which a large tree or many equal rows don't make uneven. Numbers
    are positions within a range plus the counts of the ranges before, one row per tree and range.
    """
    # Equal rows may go to several ranges, by where they lie in the table.
    rows = materialize(rows).withColumn("_at", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("tree", *order, "_at").sortWithinPartitions("tree", *order, "_at")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ranged.drop("_at").withColumns({"_part": F.spark_partition_id(), "_pos": position}))
    discard(rows)
    spans = placed.groupBy("tree", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    spans = spans.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    numbered = placed.join(spans, ["tree", "_part"]).withColumn("idx", F.col("_pos") + F.col("_shift"))
    return numbered.drop("_part", "_pos", "_shift")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up, until every tree has one node.

    A round's open frontier, the roots of its blocks, is shuffled to blocks of the next: each has
    ARITY ** LEVELS times fewer nodes than the one before.
    """
    out = []
    while True:
        blocks = _combined(nodes)
        out.append(blocks)
        left = blocks.where(~F.col("last"))
        if left.isEmpty():
            return out
        width = F.col("size")
        for _ in range(LEVELS):
            width = F.ceil(width / ARITY)
        nodes = left.select("tree", width.cast("long").alias("size"), F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the last node of every tree."""
    tops = [b.where("last").select("tree", F.element_at(F.element_at("levels", -1), 1).alias("digest")) for b in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def _descend(row) -> Iterator[tuple]:
    """A path for each of a block's lowest nodes: the siblings on its way up in the block, then the block's own path."""
    levels, block = row["levels"], row["block"]
    first = [block * ARITY ** (LEVELS - k) for k in range(len(levels))]
    for at, digest in enumerate(levels[0]):
        lefts, rights, i = [], [], first[0] + at
        for k in range(len(levels) - 1):
            lo = i // ARITY * ARITY
            lefts.append("".join(levels[k][lo - first[k] : i - first[k]]))
            rights.append("".join(levels[k][i - first[k] + 1 : lo - first[k] + ARITY]))
            i //= ARITY
        yield row["tree"], first[0] + at, digest, lefts + row["lefts"], rights + row["rights"], row["subroot"], row["root"]


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of all leaves, handed down from the trees' last nodes (`tops`) through the reverse links of each round."""
    spark, below = tops.sparkSession, None
    own = ["lefts", "rights", "subroot", "root"]
    for k, blocks in reversed(list(enumerate(rounds))):
        ready = blocks.where("last").join(tops.select("tree", *own), "tree")
        if below is not None:
            inner = blocks.where(~F.col("last")).join(below.select("tree", F.col("idx").alias("block"), *own), ["tree", "block"])
            ready = ready.unionByName(inner)
        below = spark.createDataFrame(ready.rdd.flatMap(_descend), _PATH, verifySchema=False)
        if k:
            below = materialize(below)
    return below


@dataclass
class Manifest:
    """A built tree: its numbered leaves, the rounds of blocks of the sources' trees, and those of the tree over them."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    top_rounds: list[DataFrame]

    def root(self) -> str | None:
        """Digest of the whole dataset; None if it has no rows."""
        found = _roots(self.top_rounds).first()
        return found["digest"] if found else None

    def proofs(self) -> DataFrame:
        """Every leaf's columns with `lefts` and `rights`, the joined digests of the siblings before and after it
        on each level up to the root, `subroot` and `root`."""
        empty = F.array().cast("array<string>")
        root = _roots(self.top_rounds).select("tree", "digest", empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        tops = self.subroots.select(F.col("of"), "idx").join(_paths(self.top_rounds, root), "idx")
        tops = materialize(tops.select(F.col("of").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root"))
        paths = _paths(self.rounds, tops).drop("digest")
        return self.leaves.join(paths, ["tree", "idx"])


def build(rows: DataFrame, source: str, *order: str) -> Manifest:
    """The manifest of rows that have a hex `leaf`.

    Leaves of a source ascend by `order`, then by leaf, nulls first; equal leaves may stand in any order.
    Sources ascend by their UTF-8 bytes, null first; an empty name is a source of its own.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    leaves = materialize(_numbered(rows.withColumn("tree", tree), *order, "leaf"))
    rounds = _rounds(leaves.withColumnRenamed("leaf", "digest"))
    # "-" sorts before "=": null first, then by name.
    subroots = materialize(_numbered(_roots(rounds).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), "of"))
    return Manifest(leaves, rounds, subroots, _rounds(subroots))


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def verify(proofs: DataFrame, leaf: str = "leaf") -> DataFrame:
    """proofs with `folded_root`, recomputed from a leaf's digest and its siblings, and `verified`."""
    got = proofs.withColumn("folded_root", fold(F.col(leaf), F.col("lefts"), F.col("rights")))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    Rows whose doc_id has an even CRC-32 are folded from a text without its line feeds, so those that
    have any are not verified; null texts stay null. Repeated rows each get a leaf; rows of one doc_id
    and source are ordered by their leaves. Null sources are one source, null ids come first. Extra
    columns are ignored. An empty table gives no row. A row's digests are taken once, where it is read;
    only digests are shuffled.
    """
    others = [F.col(c) for c in BOUND[:-1]]
    altered = F.when(tampered(F.col("doc_id")), digest_of(*others, F.translate(F.col("text").cast("string"), "\n", "")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest_of(*others, F.col("text")).alias("leaf"), altered.alias("altered"))
    proofs = build(rows, "source", "doc_id").proofs()
    found = verify(proofs.withColumn("read", F.coalesce("altered", "leaf")), "read")
    siblings = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(F.col("lefts").alias("l"), F.col("rights").alias("r")), lambda s: F.array(s["l"], s["r"]))))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def oracle() -> str:
    """DuckDB SQL of manifest(): nodes by recursion over levels, siblings by windows, paths by recursion upwards."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')".format
    digest = lambda text: "sha256(" + " || ".join([field(c) for c in BOUND[:-1]] + [field(text)]) + ")"
    shift = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda ch: ord(ch)::bigint)), lambda crc, byte: {shift}), 4294967295)"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS level, idx, digest, size FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (size + 2) // 3
  FROM {name} WHERE size > 1 GROUP BY tree, level, idx // 3, size),
{name}_family AS (
  SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM {name} WHERE size > 1)"""

    return f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {digest("text")} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {digest("replace(text, chr(10), '')")} END AS altered FROM documents),
leaves AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf, altered) AS r FROM given),
{tree("nodes", "leaves")},
tops AS (SELECT '*' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1),
{tree("upper", "tops")},
climb AS (
  SELECT r, tree, 0 AS level, idx, '' AS siblings, coalesce(altered, leaf) AS folded FROM leaves
  UNION ALL
  SELECT r, c.tree, c.level + 1, c.idx // 3, siblings || lefts || rights, sha256(lefts || folded || rights)
  FROM climb c JOIN nodes_family f ON c.tree = f.tree AND c.level = f.level AND c.idx = f.idx),
rise AS (
  SELECT r, '*' AS tree, 0 AS level, t.idx, siblings, folded FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1) c JOIN tops t ON t.of = c.tree
  UNION ALL
  SELECT r, c.tree, c.level + 1, c.idx // 3, siblings || lefts || rights, sha256(lefts || folded || rights)
  FROM rise c JOIN upper_family f ON c.level = f.level AND c.idx = f.idx),
done AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT n.doc_id, n.leaf, t.digest AS subroot, root.digest AS root, sha256(d.siblings) AS proof_sha256, d.folded AS folded_root, d.folded = root.digest AS verified
FROM leaves n JOIN done d USING (r) JOIN tops t ON t.of = n.tree CROSS JOIN (SELECT digest FROM upper WHERE size = 1) root"""
