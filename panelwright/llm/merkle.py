"""Merkle manifest of a document table: a tree for each language, one tree above their roots, and a proof for each row.

A tree is built level by level with conditional aggregates: the children of one parent are spread into ``fanout`` slot
columns, whose concatenation is hashed to the parent's digest. The same columns without a child's own slot are its
siblings. Proofs come down from the root: what lies above a parent is joined to its slots once, for all its children,
so a document meets its whole path in one join of its own row with its parent's.

Leaves are numbered within a language without bringing a language together: rows are dealt by ranges of (language,
id), numbered within their range, and the ranges' counts are summed. Everything is built-in Spark functions; only the
number of leaves of the largest language reaches the driver, which says how many levels there are.

Defined cases: a null language is a tree of its own and comes first; a null id comes first in its tree and is never
tampered with; null and empty values differ (``-`` and ``0:``); rows that repeat an id stand next to each other in the
order of their leaf digests; identical rows are a leaf each; a tree of one leaf is that leaf; the length of a text
doesn't matter; an empty table gives an empty manifest; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import written

FANOUT = 8


def field(value: Column) -> Column:
    """A value as it is hashed: its size in UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered): a row's digest, and where 3 divides crc32 of its id the digest with a lower-cased text."""
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return documents.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        F.sha2(F.concat(*fields, field(F.col("text"))), 256).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.sha2(F.concat(*fields, field(lowered)), 256)).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within ``tree``) and ``n``, the tree's size.

    Ranges are dealt by tree, order and a random number, so identical rows don't end in one task either.
    """
    by = ["tree", *order, "salt"]
    dealt = rows.withColumn("salt", F.rand(11)).repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("row", 33))
    ranges = dealt.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return dealt.join(ranges, ["tree", "part"]).select(*rows.columns, (F.col("row") + F.col("shift")).alias("place"), "n")


def slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def spread(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, parent, n, c0, c1, ...): the children of each parent in slot columns; a tree of one node has no parents."""
    slot = F.col("place") % fanout
    children = [F.max(F.when(slot == s, F.col("digest"))).alias(c) for s, c in enumerate(slots(fanout))]
    return nodes.where("n > 1").groupBy("tree", F.floor(F.col("place") / fanout).alias("parent")).agg(F.max("n").alias("n"), *children)


def levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Slot tables from the leaves (tree, place, n, digest) up, and for each level, one more than those, the trees that end there."""
    tables, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        if most <= 1:
            return tables, tops
        tables.append(written(spread(nodes, fanout), f"level{len(tables)}"))
        nodes = tables[-1].select("tree", F.col("parent").alias("place"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.concat_ws("", *slots(fanout)), 256).alias("digest"))
        most = -(-most // fanout)


def siblings(slot: Column, fanout: int) -> Column:
    """What stands left and right of a slot's child among the slot columns."""
    left = F.concat_ws("", *(F.when(slot > s, F.col(c)) for s, c in enumerate(slots(fanout))))
    right = F.concat_ws("", *(F.when(slot < s, F.col(c)) for s, c in enumerate(slots(fanout))))
    return F.struct(left.alias("left"), right.alias("right"))


def above_leaves(tables: list[DataFrame], tops: list[DataFrame], ends: DataFrame, fanout: int) -> DataFrame:
    """(tree, parent, n, slots, path, subroot, root) for the parents of leaves, and for trees of one leaf (parent -1, slots null).

    ``ends``: (tree, path, subroot, root) of each tree's own root; a path is an array of (left, right), lowest level first.
    """
    carried = ["path", "subroot", "root"]
    known = None
    for level in range(len(tables), -1, -1):
        ended = ends.join(tops[level].select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("place"), *carried)
        known = ended if known is None else known.unionByName(ended)
        if level:
            table = tables[level - 1].join(known.withColumnRenamed("place", "parent"), ["tree", "parent"])
            if level == 1:
                break
            filled = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), s) for s, c in enumerate(slots(fanout)))))
            each = table.withColumn("slot", F.explode(filled))
            known = each.select("tree", (F.col("parent") * fanout + F.col("slot")).alias("place"), F.concat(F.array(siblings(F.col("slot"), fanout)), F.col("path")).alias("path"), "subroot", "root")
    single = ends.join(tops[0].select("tree"), "tree").select("tree", F.lit(-1).cast("long").alias("parent"), F.lit(1).cast("long").alias("n"), *(F.lit(None).cast("string").alias(c) for c in slots(fanout)), *carried)
    return table.unionByName(single) if tables else single


def manifest(documents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path): for each row its leaf and the way from it to the root."""
    found = written(numbered(written(leaves(documents), "leaves"), ["doc_id", "leaf"]), "placed")
    tables, tops = levels(found.select("tree", "place", "n", F.col("leaf").alias("digest")), fanout)
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    # the tree above: its leaves are the languages' roots, in one tree without a name
    ranked = written(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), ["lang"]), "subroots")
    upper, peak = levels(ranked.select("tree", "place", "n", "digest"), fanout)
    root = peak[-1]
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    steps = above_leaves(upper, peak, root.select("tree", no_path.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")), fanout)
    ends = met(ranked, steps, fanout).select(F.col("lang").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    above = written(above_leaves(tables, tops, written(ends, "ends"), fanout), "above")
    return met(found, above, fanout).select("doc_id", "leaf", "tampered", "subroot", "root", "path")


def met(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Leaves of a tree (tree, place, n, ...) with their whole path."""
    mine = nodes.withColumn("parent", F.when(F.col("n") > 1, F.floor(F.col("place") / fanout)).otherwise(-1))
    own = F.when(F.col("parent") >= 0, F.array(siblings(F.col("place") % fanout, fanout))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
    return mine.join(above.drop("n"), ["tree", "parent"]).withColumn("path", F.concat(own, "path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x.left, digest, x.right), 256))


def digests(found: DataFrame) -> DataFrame:
    """The manifest with each path as one hash, and the root recomputed from the row as it may have been tampered with."""
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), ""), 256)
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
