"""Merkle manifest of a table: leaves, roots and proofs, with the upper proofs by butterfly exchange."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcetally.session import stored

#: Children of a node; levels of a tree that one task hashes by itself, so a partition has FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 8, 4
HEX = 64
PATH = "array<struct<before: string, after: string>>"


def leaf_of(*columns: Column) -> Column:
    """Digest of values, one after the other: `-` for null, else its bytes in UTF-8, `:` and the
    value, integers in decimal."""
    parts = []
    for value in columns:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` plus ``name``, their number from 0 by ``order``: a range partitioning, the rows before
    each range from one row a range.  Equal rows of ``order`` can't be told apart by their place."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "merkle-ranged")
    placed = placed.withColumn("_range", F.shiftrightunsigned("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    numbered = placed.join(F.broadcast(first), "_range").withColumn(name, F.col("_place") - F.shiftleft("_range", 33) + F.col("_ahead"))
    return numbered.drop("_place", "_range", "_ahead")


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, at, n, node, path) for ``nodes`` (tree, at, n, node), the ``n`` nodes of each tree: its
    root as ``node``, and the siblings met on the way up.

    Round r joins aligned groups of ``fanout`` subtrees of fanout ** r nodes.  A node holds the root of
    its subtree and sends it to one node of every other subtree of the group, the one in the same
    place; where the last subtree is shorter its nodes take turns.  So each node gets at most
    ``fanout`` roots a round, hashes the ancestor itself, as all others below it do, and ends with its
    whole proof: nothing has to come down again.  The number of rounds is the depth of the largest
    tree; each is one shuffle of at most ``fanout`` rows a node, written to the shared folder.
    """
    state = nodes.select("tree", "at", "n", "node", F.array().cast(PATH).alias("path"))
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    stride = 1
    while stride < most:
        digit = F.pmod(F.floor(F.col("at") / stride), F.lit(fanout)).cast("int")
        low = F.pmod("at", F.lit(stride))
        seen = state.withColumns({"digit": digit, "low": low}).withColumn("begin", F.col("at") - F.col("low") - F.col("digit") * stride)
        mine = F.least(F.lit(stride), F.col("n") - F.col("begin") - F.col("digit") * stride)
        met = seen.withColumn("size", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
        start = F.col("begin") + F.col("other") * stride
        theirs = F.least(F.lit(stride), F.col("n") - start)
        same = F.col("other") == F.col("digit")
        met = met.where(same | (F.col("low") < theirs))                       # a subtree that is not there has no nodes
        receivers = F.when(same, F.array("at")).otherwise(F.transform(F.sequence("low", theirs - 1, "size"), lambda p: start + p))
        sent = met.select("tree", "n", "digit", "node", F.when(same, F.col("path")).alias("path"), F.when(same, F.col("digit")).alias("own"), F.explode(receivers).alias("at"))
        got = sent.groupBy("tree", "at").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("run"),
                                             F.first("path", ignorenulls=True).alias("path"), F.max("own").alias("own"))
        part = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
        level = F.struct(part(lambda x: x["digit"] < F.col("own")).alias("before"), part(lambda x: x["digit"] > F.col("own")).alias("after"))
        grown = F.col("n") > stride
        state = stored(got.select("tree", "at", "n", F.when(grown, F.sha2(part(lambda x: F.lit(True)), 256)).otherwise(F.col("run")[0]["node"]).alias("node"),
                                  F.when(grown, F.concat("path", F.array(level))).otherwise(F.col("path")).cast(PATH).alias("path")), "merkle-round")
        stride *= fanout
    return state


def parents(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[a:a + fanout]).encode()).hexdigest() for a in range(0, len(nodes), fanout)]


def subtree(leaves: list[str], depth: int, fanout: int) -> list[list[str]]:
    """Nodes by level, leaves first, ``depth`` levels up."""
    levels = [leaves]
    for _ in range(depth):
        levels.append(parents(levels[-1], fanout))
    return levels


def depth_of(n: int, most: int, fanout: int) -> int:
    """Levels above ``n`` leaves until one node is left, ``most`` at most."""
    depth, span = 0, 1
    while span < n and depth < most:
        depth, span = depth + 1, span * fanout
    return depth


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` plus subroot, root and proof: of the tree over the leaves of a row's group, of the tree
    over all groups' subroots, and the leaf's siblings on the way to the root.

    ``leaf_col`` holds digests in hex.  In a group, leaves ascend by ``id_col`` (null first), equal ids
    by leaf; groups ascend by their bytes, null first.  While a tree has several nodes, every
    ``fanout`` neighbours become the digest of their hex texts; the last run may have fewer, or one.  A
    proof has a struct for each level, lowest first: the siblings before and after the node, as hex
    texts one after the other.  Other columns stay, but for names that begin with `_` or are given
    here.  Rows that are equal in all stay rows of their own.  An empty table gives an empty result.

    A partition is fanout ** levels neighbouring leaves of one group, whatever the group's size, so a
    group with most rows is many tasks.  Its subtree is hashed in one task; everything above comes
    from ``butterfly``, once for the partitions of each group and once for the groups.
    """
    rest = [c for c in rows.columns if c not in ("subroot", "root", "proof") and not c.startswith("_")]
    # Numbered before the ranges are drawn, so equal rows don't have to share one.
    rows = stored(rows.select(*rest).withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    ordered = ranked(rows, "_at", F.col(group_col).asc_nulls_first(), F.col(id_col).asc_nulls_first(), F.col(leaf_col).asc(), F.col("_row").asc())
    groups = stored(ordered.groupBy(F.col(group_col).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "merkle-groups")
    groups = stored(ranked(groups, "_tree", F.col("_first").asc()), "merkle-groups")
    span = fanout ** levels
    leaves = (ordered.join(groups, F.col(group_col).eqNullSafe(F.col("_group")))
              .withColumn("_at", F.col("_at") - F.col("_first")).withColumn("_block", F.floor(F.col("_at") / span)).drop("_first", "_group"))

    def top(key, table):
        table = table.sort_by("_at")
        depth = depth_of(table["_n"][0].as_py(), levels, fanout)
        node = subtree(table[leaf_col].to_pylist(), depth, fanout)[-1][0]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [table["_n"][0].as_py()], [node]], names=["tree", "at", "n", "node"])

    schema = "tree long, at long, n long, node string"
    tops = stored(leaves.select("_tree", "_block", "_at", "_n", leaf_col).groupBy("_tree", "_block").applyInArrow(top, schema), "merkle-tops")
    blocks = butterfly(tops.withColumn("n", F.ceil(F.col("n") / span)), fanout)
    subroots = blocks.where("at = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(groups.count()).cast("long").alias("n"), "node")
    above = butterfly(subroots, fanout)
    upper = blocks.join(above.select(F.col("at").alias("tree"), F.col("node").alias("root"), F.col("path").alias("more")), "tree").select(
        F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("node").alias("subroot"), "root", F.concat("path", "more").alias("path"))
    upper = stored(upper, "merkle-upper")

    names = [*rest, "subroot", "root", "proof"]

    def prove(key, table, known):
        table = table.sort_by("_at")
        path = known["path"][0].as_py()
        nodes = subtree(table[leaf_col].to_pylist(), depth_of(table["_n"][0].as_py(), levels, fanout), fanout)
        before, after = [], []
        joined = [["".join(level[a:a + fanout]) for a in range(0, len(level), fanout)] for level in nodes[:-1]]
        for i in range(len(table)):
            at = i
            for level in joined:
                run, own = level[at // fanout], HEX * (at % fanout)
                before.append(run[:own])
                after.append(run[own + HEX:])
                at //= fanout
            before += [p["before"] for p in path]
            after += [p["after"] for p in path]
        each = len(joined) + len(path)
        offsets = pa.array(range(0, each * len(table) + 1, each) if each else [0] * (len(table) + 1), pa.int32())
        proof = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
        same = lambda name: pa.array([known[name][0].as_py()] * len(table), pa.string())
        return pa.table([*[table[c] for c in rest], same("subroot"), same("root"), proof], names=names)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return (leaves.drop("_row").groupBy("_tree", "_block").cogroup(upper.groupBy("_tree", "_block"))
            .applyInArrow(prove, f"{fields}, subroot string, root string, proof {PATH}"))
