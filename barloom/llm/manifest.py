"""Merkle manifest of a table: every row's digest, its proof, and what a changed row folds to.

A row is a leaf, the leaves of a tree (a language) in order are hashed two by two, and the roots of all
trees likewise into one. A superblock is 2 ** LEVELS consecutive nodes of one tree. Going up, each
superblock is reduced to one node, and these are the nodes of the next tier, until every tree has one.
Going down, a superblock's nodes are cogrouped with the one row of what lies outside: the siblings
above its top node. One applyInPandas call per superblock reduces it again, joins the outer siblings to each
node's own, and, for leaves, folds. A group holds a superblock and one outer row, whatever the size of
table, tree or language; a table of n rows takes log(n) / LEVELS tiers.

Defined results: nulls are encoded as `-`, apart from any value; null languages are a tree of their own, the first;
null doc_ids come first in their tree and are not tampered with; rows that share a doc_id are ordered by leaf, so equal rows
may swap; a tree of one row has it as its root, and its proof holds what lies above; without any sibling a proof is the digest of the
empty string; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, prepare

#: Levels of a superblock: 1,024 nodes.
LEVELS = 10
#: Fixed fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """Of string columns: the digest of `-` or length in bytes, colon and value, one behind the other."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a trial changes this row: the checksum of its decimal doc_id divides by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest, changed: the leaf of each row, and of the row with 1 added to n_chars where it is tampered with."""
    text = {c: F.col(c).cast("string") for c in FIELDS}
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
    changed = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf([*(text | {"n_chars": more}).values()]))
    tree = F.coalesce(F.concat(F.lit("="), text["lang"]), F.lit(""))  # ordered like lang, null first
    return docs.select(tree.alias("tree"), "doc_id", leaf([*text.values()]).alias("digest"), changed.alias("changed"))


def numbered(rows: DataFrame, order: list[str], tables: Tables) -> DataFrame:
    """rows (tree, ...) with i, the place in the tree, and n, its size: a written table.

    Rows are dealt out by range of tree and order; a row's place is its place in its part and the number of the
    tree's rows in earlier parts. No tree is ever in one task for its size."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = tables.write(dealt.select("*", F.spark_partition_id().alias("part"), row.alias("row")), "dealt")
    parts = dealt.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return dealt.join(parts, ["tree", "part"]).withColumn("i", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The digests of a superblock and of all levels above them: up to one node of a tree of n, or `levels` of a larger tree."""
    out = [digests]
    for _ in range(min(levels, (n - 1).bit_length())):
        below = out[-1]
        out.append([_digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def _siblings(levels: list[list[str]], i: int) -> list[str]:
    """What the i-th node is hashed with on its way up: < or > for the side, and the digest; empty where it is alone."""
    out = []
    for nodes in levels[:-1]:
        k = i ^ 1
        out.append(("<" if k < i else ">") + nodes[k] if k < len(nodes) else "")
        i >>= 1
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a node and its siblings give."""
    for x in path:
        digest = _digest(x[1:], digest) if x[:1] == "<" else _digest(digest, x[1:])
    return digest


def proof(path: list[str]) -> str:
    return _digest(*(x[1:] for x in path))


def _block(levels: int) -> Column:
    return F.shiftright("i", levels).alias("block")


def grow(nodes: DataFrame, tables: Tables, levels: int) -> list[DataFrame]:
    """The tiers over a written table of nodes (tree, i, n, digest): the last has one node for each tree."""
    tiers = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:

        def reduce(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("i")
            tree, i, n = block["tree"].iloc[0], int(block["i"].iloc[0]), int(block["n"].iloc[0])
            top = _levels(block["digest"].tolist(), n, levels)[-1][0]
            return pd.DataFrame({"tree": [tree], "i": [i >> levels], "n": [-(-n >> levels)], "digest": [top]})

        tops = tiers[-1].select("tree", "i", "n", "digest").groupBy("tree", _block(levels)).applyInPandas(reduce, "tree string, i long, n long, digest string")
        tiers.append(tables.write(tops, "tier"))
        largest = -(-largest >> levels)
    return tiers


def joined(nodes: DataFrame, outer: DataFrame, levels: int, each: Callable[[pd.DataFrame, list[list[str]], pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """nodes (tree, i, n, digest, ...) cogrouped by superblock with outer (tree, i, path, ...), the row of its top node.

    each(nodes in order, their whole paths, outer row) gives the rows of a superblock."""

    def work(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i", ignore_index=True)
        up = _levels(block["digest"].tolist(), int(block["n"].iloc[0]), levels)
        top = above.iloc[0]
        return each(block, [_siblings(up, k) + list(top["path"]) for k in range(len(block))], top)

    inner = nodes.groupBy("tree", _block(levels))
    outer = outer.select(*(F.col(c).alias("block" if c == "i" else c) for c in outer.columns))
    return inner.cogroup(outer.groupBy("tree", "block")).applyInPandas(work, schema)


def _paths(tiers: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """(tree, i, path, subroot, root) of the second tier's nodes, or of the first one's where it is the last."""

    def each(block: pd.DataFrame, paths: list[list[str]], top: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["tree"], "i": block["i"], "path": paths, "subroot": top["subroot"], "root": top["root"]})

    for nodes in reversed(tiers[1:-1]):
        outer = joined(nodes.select("tree", "i", "n", "digest"), outer, levels, each, "tree string, i long, path array<string>, subroot string, root string")
    return outer


def _subroots(tops: DataFrame, tables: Tables, levels: int) -> DataFrame:
    """(tree, i, path, subroot, root) of each tree's top node: the trees' roots as the leaves of one tree."""
    own = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], tables)
    tiers = grow(own, tables, levels)
    top = tiers[-1].select("tree", F.lit(0).cast("long").alias("i"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def each(block: pd.DataFrame, paths: list[list[str]], top: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["name"], "i": 0, "path": paths, "subroot": block["digest"], "root": top["root"]})

    nodes = own.select("tree", "i", "n", "digest", "name")
    return joined(nodes, _paths(tiers, top, levels), levels, each, "tree string, i long, path array<string>, subroot string, root string")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings from the leaf up, < or > for the side, empty where alone), proof_sha256, folded_root, verified."""
    prepare(docs.sparkSession)
    with Tables(docs.sparkSession) as tables:
        digests = tables.write(leaves(docs), "digests")  # texts are read and hashed once, not again to find the ranges
        rows = tables.write(numbered(digests, ["doc_id", "digest"], tables), "leaves")
        tiers = grow(rows, tables, levels)
        outer = tables.write(_paths(tiers, _subroots(tiers[-1], tables, levels), levels), "outer")
        tables.keep(rows)
        tables.keep(outer)

    def each(block: pd.DataFrame, paths: list[list[str]], top: pd.Series) -> pd.DataFrame:
        out = block[["doc_id"]].assign(leaf=block["digest"], subroot=top["subroot"], root=top["root"], proof=paths)
        out["proof_sha256"] = [proof(p) for p in paths]
        start = block["changed"].where(block["changed"].notna(), block["digest"])
        return out.assign(folded_root=[fold(d, p) for d, p in zip(start, paths)])

    nodes = rows.select("tree", "i", "n", "digest", "changed", F.col("doc_id").cast("string").alias("doc_id"))  # pandas has no long with nulls
    schema = "doc_id string, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string"
    out = joined(nodes, outer, levels, each, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
