"""Operator 11: a Merkle manifest of a dataset, kept as concatenated-level strings.

A leaf is the hash of a row's fields, each written as its byte count, ``:`` and its value (``-`` for null). The leaves of a
tree (one per source) stand in the order of their key. Every aligned block of ``SPAN`` nodes is one row that keeps each of
its levels as one hex string: parents are hashes of fixed-width substrings of the level below, and the siblings of a node
are the substrings that flank it. What a block hashes to is a node of the next round, until a tree has one block; the
roots of the trees are then the nodes of a last tree, built by the same functions.

Positions come from a range partitioning by (tree, key, leaf) with counts per partition, so no task holds more than a
slice of a tree and a block never more than ``SPAN`` nodes, however large one source is. All tables that later steps read
again are written to the shared checkpoint folder.

Defined results: nulls hash as ``-`` (an empty text as ``0:``); rows of one tree with equal or null keys stand in the order
of their leaf hash (null keys first), so repeated rows are leaves side by side; an empty table has no rows and no root;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.base import keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes hashed together, hex characters of a digest, nodes of a block (two levels).
FAN, HEX = 16, 64
SPAN = FAN * FAN
RUN = FAN * HEX
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:binary,right:binary>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of fields, each with its length before it."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def positions(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``nodes`` with ``pos``, gapless from 0 within ``tree`` by ``order``, and ``n``, the nodes of the tree."""
    # written with its partition number, so that both readers below see the same slices
    slices = keep(nodes.repartitionByRange("tree", *order).withColumn("slice", F.spark_partition_id()))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = slices.groupBy("tree", "slice").agg(F.count("*").alias("rows")).select(
        "tree", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(of_tree).alias("n"))
    inside = Window.partitionBy("tree", "slice").orderBy(*order)
    return slices.withColumn("at", F.row_number().over(inside)).join(counts, ["tree", "slice"]).withColumn(
        "pos", F.col("first") + F.col("at") - 1).drop("slice", "at", "first")


def _parents(level: Column) -> Column:
    """The next level's string: hashes of all runs of a level's string."""
    runs = F.ceil(F.octet_length(level) / RUN)
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashes, "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, cells, level0, level1, level2, digest) from nodes (tree, pos, n, digest, item)."""
    cells = nodes.groupBy("tree", F.floor(F.col("pos") / SPAN).alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("cells"))
    level0 = F.array_join(F.transform("cells", lambda c: c["digest"]), "").cast("binary")
    found = keep(cells.withColumn("level0", level0))
    found = found.withColumn("level1", F.when(F.col("n") > 1, _parents(F.col("level0"))))
    found = found.withColumn("level2", F.when(F.col("n") > FAN, _parents(F.col("level1"))))
    return found.withColumn("digest", F.coalesce("level2", "level1", "level0").cast("string"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (tree, digest) of the finished trees."""
    rounds = []
    while True:
        rounds.append(keep(blocks(nodes)))
        open_ = rounds[-1].where(F.col("n") > SPAN)
        if not open_.limit(1).count():
            break
        nodes = open_.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), "digest",
                             F.lit(None).cast("int").alias("item"))
    tops = [r.where(F.col("n") <= SPAN).select("tree", "digest") for r in rounds]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return rounds, out


def _flanks(level: Column, at: Column) -> Column:
    """What stands left and right of node ``at`` in its run of a level's string."""
    inside = at % FAN
    return F.struct(F.substring(level, (at - inside) * HEX + 1, inside * HEX).alias("left"),
                    F.substring(level, (at + 1) * HEX + 1, (FAN - 1 - inside) * HEX).alias("right"))


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every node of the first round with its path; ``above`` has (tree, path, ...) of every tree's root."""
    passed = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for r in reversed(rounds):
        found = r.where(F.col("n") <= SPAN).join(above, "tree")
        if upper is not None:
            found = found.unionByName(r.where(F.col("n") > SPAN).join(
                upper.select("tree", F.col("pos").alias("block"), "path", *passed), ["tree", "block"]))

        def cell(c, i):
            second = F.when(F.col("n") > FAN, F.array(_flanks(F.col("level1"), F.floor(i / FAN).cast("int"))))
            first = F.when(F.col("n") > 1, F.array(_flanks(F.col("level0"), i)))
            none = F.array().cast(PATH)
            return F.struct(c["pos"].alias("pos"), c["digest"].alias("digest"), c["item"].alias("item"),
                            F.concat(F.coalesce(first, none), F.coalesce(second, none), F.col("path")).alias("path"))

        upper = found.select("tree", *passed, F.explode(F.transform("cells", cell)).alias("cell")).select("tree", *passed, "cell.*")
    return upper


@dataclass
class Manifest:
    """Block tables of the source trees and of the tree over them; ``(tree, subroot)`` and ``('', root)``."""

    rounds: list[DataFrame]
    top_rounds: list[DataFrame]
    subroots: DataFrame
    root: DataFrame

    def blocks(self) -> DataFrame:
        """One row per block: kind (leaves or subroots), round, tree, block and its levels as hex strings."""
        out = None
        for kind, rounds in (("leaves", self.rounds), ("subroots", self.top_rounds)):
            for k, r in enumerate(rounds):
                rows = r.select(F.lit(kind).alias("kind"), F.lit(k).alias("round"), "tree", "block",
                                *[F.col(f"level{i}").cast("string").alias(f"level{i}") for i in range(3)])
                out = rows if out is None else out.unionByName(rows)
        return out

    def write(self, folder: str) -> None:
        """The manifest's files: its blocks and its root as Parquet."""
        self.blocks().write.parquet(f"{folder}/blocks")
        self.root.write.parquet(f"{folder}/root")

    def proofs(self) -> DataFrame:
        """tree, subroot, root, pos, digest (leaf hash), item and path (siblings left and right, level by level)."""
        top = descend(self.top_rounds, self.root.select("tree", F.array().cast(PATH).alias("path"), "root"))
        return descend(self.rounds, top.select(
            F.col("item").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))


def build(leaves: DataFrame, order: Sequence[Column]) -> Manifest:
    """Manifest of ``leaves`` (tree, digest, item), those of a tree in ``order``, trees in the order of their name."""
    rounds, subroots = climb(positions(keep(leaves), order).select("tree", "pos", "n", "digest", "item"))
    tops = keep(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("item")))
    top_rounds, root = climb(positions(tops, [F.col("item")]).select("tree", "pos", "n", "digest", "item"))
    return Manifest(rounds, top_rounds, subroots.select("tree", F.col("digest").alias("subroot")),
                    keep(root.select("tree", F.col("digest").alias("root"))))


def tree_of(source: Column) -> Column:
    """Name of a source's tree: null before all others, the rest in byte order."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def siblings_hash(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.aggregate(path, F.lit(b""), lambda s, p: F.concat(s, p["left"], p["right"])), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf hash and its siblings lead to."""
    return F.aggregate(path, leaf, lambda x, p: F.sha2(F.concat(p["left"], x.cast("binary"), p["right"]), 256))


def verified(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source",
             text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row of ``docs`` against the manifest.

    Rows whose key has a crc32 divisible by 5 come back tampered with (A-Z of the text in lower case)."""
    tampered = F.translate(F.col(text), UPPER, LOWER)
    hit = F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % 5 == 0
    leaves = docs.select(
        tree_of(F.col(source)).alias("tree"), leaf_hash([F.col(c) for c in fields]).alias("digest"),
        F.struct(F.col(key).alias("key"), F.when(hit, leaf_hash([tampered if c == text else F.col(c) for c in fields])).alias("other")).alias("item"))
    manifest = build(leaves, [F.col("item.key").asc_nulls_first(), F.col("digest")])
    found = manifest.proofs().select(
        F.col("item.key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        siblings_hash(F.col("path")).alias("proof_sha256"), fold(F.coalesce("item.other", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
