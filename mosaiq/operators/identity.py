"""Cryptographic identity of tables: a tree of SHA-256 digests over canonical rows.

A row's digest is that of its canonical JSON (columns by name, nulls kept). Its place in the tree is the beginning of the
digest of its key, so it does not depend on files, partitions or other rows, and a changed value leaves the row where it
is. The digest of a leaf is that of its rows' digests in order of key and row digest; the digest of a node is that of its
children in order; the node at level 0 is the table. Two trees are compared from level to level: a changed, added or
missing row is found in its leaf. A leaf of a table of n rows holds about n / 256 ** levels digests of 64 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 2
_KEPT = {"ignoreNullFields": "false"}


def row_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), _KEPT)


def row_digests(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key_digest, digest) of every row; without a key the whole row is the key."""
    names = sorted(df.columns)
    return df.select(F.sha2(row_json(key or names), 256).alias("key_digest"), F.sha2(row_json(names), 256).alias("digest"))


def tree(df: DataFrame, key: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """(level, node, rows, digest): every node that holds rows. A node is named by two hexadecimal digits a level; an empty table has the node of level 0 only."""
    rows = row_digests(df, key)
    folded = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key_digest", "digest"))), lambda r: r["digest"]), ""), 256)
    nodes = rows.groupBy(F.substring("key_digest", 1, 2 * levels).alias("node")).agg(F.count(F.lit(1)).alias("rows"), folded.alias("digest"))
    out = nodes.select(F.lit(levels).alias("level"), "node", "rows", "digest")
    for level in range(levels - 1, -1, -1):
        below = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda r: r["digest"]), ""), 256)  # 256 children at most
        by = [F.substring("node", 1, 2 * level).alias("_node")] if level else []
        nodes = nodes.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"), below.alias("digest"))
        nodes = nodes.select(F.col("_node").alias("node") if level else F.lit("").alias("node"), "rows", "digest")
        out = out.unionByName(nodes.select(F.lit(level).alias("level"), "node", "rows", "digest"))
    return out


def table_identity(df: DataFrame, key: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row: rows and the digest of the table."""
    return tree(df, key, levels).filter("level = 0").select("rows", "digest")


def differing(stored: DataFrame, found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The leaves whose digests differ between two trees or that only one has: node, rows_stored, rows_found."""
    side = lambda t, s: t.filter(F.col("level") == levels).select("node", F.col("rows").alias(f"rows_{s}"), F.col("digest").alias(f"_{s}"))
    both = side(stored, "stored").join(side(found, "found"), "node", "full")
    return both.filter(~F.col("_stored").eqNullSafe(F.col("_found"))).select("node", F.coalesce("rows_stored", F.lit(0)).alias("rows_stored"), F.coalesce("rows_found", F.lit(0)).alias("rows_found"))


def rows_of(df: DataFrame, nodes: DataFrame, key: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of df that lie in the given leaves, to look at."""
    placed = df.withColumn("_node", F.substring(F.sha2(row_json(key or df.columns), 256), 1, 2 * levels))
    return placed.join(nodes.select(F.col("node").alias("_node")), "_node", "left_semi").drop("_node")
