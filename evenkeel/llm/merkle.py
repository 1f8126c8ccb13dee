"""A manifest of hashes over a table: a tree for each source, one tree over the sources, and proofs for every row.

A row's leaf is the hash of its fields (`-` for null, else the UTF-8 length, `:` and the value).  Leaves are numbered in
each source by its order, and while a level has several nodes every `fanout` consecutive ones are hashed into a parent, a
single one in the last run too; what is left is the source's subroot.  Subroots, ordered by source (null first), make the
root in the same way.

Levels are DataFrames: a level's parents are groups of the numbers divided by the fanout, with their sorted children.
Going down again, each level's nodes get their siblings by a join with their parents, before the siblings that those have
already, so that a level's work is a part of the one below it and all levels together take no more than half as much again as the
lowest.  No step brings the rows of a source together: numbers come from rows written once in range order, and groups
have `fanout` rows.  Texts are hashed as they are read, and never shuffled.

Nulls and odd rows: null fields are hashed as `-`, rows with a null source make a source of their own, and null ids come
first.  Rows with equal ids are ordered by leaf; repeated rows are leaves of their own.  An empty table gives no rows.
Columns beyond the fields and those to keep are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import Scratch, col, fresh, join_hot
from evenkeel.operators.windows import row_index

FANOUT = 3


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 length, `:` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _climb(scratch: Scratch, nodes: DataFrame, levels: int, fanout: int, name: str) -> list[DataFrame]:
    """The levels above `nodes` (tree, i, n, hash): the same, with `children`, the hashes below; n is the number of nodes
    that the tree has on the level."""
    made: list[DataFrame] = []
    for k in range(1, levels + 1):
        below = (made[-1] if made else nodes).where("n > 1")
        parent = F.floor(F.col("i") / fanout).cast("long").alias("i")
        groups = below.groupBy("tree", parent).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("run"), F.max("n").alias("n"))
        children = F.col("run.hash")
        made.append(scratch.keep(groups.select("tree", "i", F.ceil(F.col("n") / fanout).alias("n"), F.sha2(_joined(children), 256).alias("hash"), children.alias("children")), f"{name}-{k}"))
    return made


def _with_siblings(nodes: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """nodes with `path`: the siblings left and right of them, before those of their parents (i, children, path).

    A parent without children stands for the way from a tree's top on, which is passed down as it is.
    """
    at = (F.col("a.i") % fanout).cast("int")
    children = F.col("b.children")
    step = F.struct(_joined(F.slice(children, 1, at)).alias("before"), _joined(F.slice(children, at + 2, fanout)).alias("after"))
    path = F.when(children.isNull(), F.col("b.path")).otherwise(F.concat(F.array(step), F.col("b.path")))
    same = (F.col("a.tree") == F.col("b.tree")) & (F.floor(F.col("a.i") / fanout) == F.col("b.i"))
    return nodes.alias("a").join(parents.alias("b"), same).select(*[F.col(f"a.{c}") for c in nodes.columns], path.alias("path"))


def _descend(scratch: Scratch, nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """nodes with their `path`.  tops (tree, level, path) has the way on from each tree's top."""
    parents: DataFrame | None = None
    for k in range(len(levels), -1, -1):
        start = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("i"), F.lit(None).cast("array<string>").alias("children"), "path")
        parents = start if parents is None else parents.select("tree", "i", "children", "path").unionByName(start)
        if k:
            parents = scratch.keep(_with_siblings(levels[k - 1].select("tree", "i", "children"), parents, fanout), f"{name}-{k}")
    return _with_siblings(nodes, parents, fanout)


def _height(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def _height_of(n: Column, most: int, fanout: int) -> Column:
    """_height as a column; most is the height of the largest tree."""
    return F.lit(most) if not most else F.coalesce(*[F.when(n <= fanout**k, F.lit(k)) for k in range(most + 1)])


def prove(spark: SparkSession, rows: DataFrame, source: str, order: str, leaf_col: str, fanout: int = FANOUT) -> tuple[DataFrame, str]:
    """rows (small ones: keys and hashes, with a leaf in the column `leaf_col`) with one more struct column, and its name:
    subroot, root and path, an array of the hashes before and after the row's node on every level, from the leaf up."""
    if fanout < 2:
        raise ValueError("a run needs two nodes at least")
    scratch, name = Scratch(spark, "merkle"), fresh(rows, "merkle")
    # Hashed and written once before the rows are put in order; `of` is the source as text that is never null.
    narrow = rows.select(F.struct(*map(col, rows.columns)).alias("kept"), col(source).alias("source"), col(order).alias("order"), col(leaf_col).alias("hash"), field(col(source)).alias("of"))
    placed = row_index(scratch.keep(narrow, "leaves"), [F.asc_nulls_first("source"), F.asc_nulls_first("order"), "hash"], "place")
    sizes = placed.groupBy("of").agg(F.max("source").alias("source"), F.count("*").alias("n"), F.min("place").alias("first"))
    trees = scratch.keep(row_index(scratch.keep(sizes, "sizes"), [F.asc_nulls_first("source")], "tree").drop("source"), "trees")
    n_rows, n_trees, largest = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    told = join_hot(placed.select("kept", "hash", "of", "place"), trees, "of", "n", n_rows)
    leaves = scratch.keep(told.select("kept", "tree", (F.col("place") - F.col("first")).alias("i"), "n", "hash"), "numbered")
    high, over = _height(largest, fanout), _height(n_trees, fanout)
    levels = _climb(scratch, leaves.select("tree", "i", "n", "hash"), high, fanout, "level")

    tops = leaves.where("n = 1").select("tree", "hash")
    for x in levels:
        tops = tops.unionByName(x.where("n = 1").select("tree", "hash"))
    heights = trees.select("tree", _height_of(F.col("n"), high, fanout).alias("level"))
    # The subroots are the leaves of one more tree, whose number is 0.
    subroots = scratch.keep(tops.join(heights, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n_trees).cast("long").alias("n"), "hash", "level"), "subroots")
    above = _climb(scratch, subroots.select("tree", "i", "n", "hash"), over, fanout, "above")
    top = (above[-1] if above else subroots).where("n = 1").select("hash").first()
    ended = spark.range(1).select(F.col("id").alias("tree"), F.lit(over).alias("level"), F.expr("CAST(array() AS array<struct<before: string, after: string>>)").alias("path"))
    ways = scratch.keep(_descend(scratch, subroots, above, ended, fanout, "way-above").select(F.col("i").alias("tree"), "level", "hash", "path"), "ways")

    proved = _descend(scratch, leaves, levels, ways.select("tree", "level", "path"), fanout, "way")
    with_top = join_hot(proved, ways.join(trees, "tree").select("tree", F.col("hash").alias("subroot"), F.col("n").alias("size")), "tree", "size", n_rows)
    root = F.lit(top[0] if top else None).cast("string")
    return with_top.select("kept.*", F.struct("subroot", root.alias("root"), "path").alias(name)), name


def proof(path: Column) -> Column:
    """All siblings on the way up, joined."""
    return _joined(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))
