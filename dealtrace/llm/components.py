"""Connected components of a link table, as joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from .common import forget, keep


def _links(a: str, b: str, links: DataFrame) -> DataFrame:
    """Every link once, the smaller end first, without links to oneself."""
    return links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _looked_up(links: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``links`` with one end replaced by its root."""
    found = lookup_join(links.withColumnRenamed(column, "node"), roots, "node", "inner")
    return found.drop("node").withColumnRenamed("root", column)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    Every round a node moves to its smallest neighbour and on to that one's, and
    the links are drawn anew between the places reached.  Links within one place
    vanish, so the table shrinks from round to round; a path of ``n`` links takes
    about log2(n) rounds.  Where every node of a round went is put together at
    the end.  A node with very many links is spread over tasks
    (:func:`lookup_join`).  Null ends and links to oneself are left out.
    """
    left, rounds = keep(_links("a", "b", links), "links"), []
    while True:
        both = left.union(left.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near"))
        up = keep(near.select("node", F.least("node", "_near").alias("up")), "moves")
        beyond = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        moved = keep(lookup_join(up, beyond, "up", "inner").select("node", "root"), "moves")
        forget(up)
        rounds.append(moved)
        drawn = _looked_up(_looked_up(left, "a", moved), "b", moved)
        after = keep(_links("a", "b", drawn), "links")
        forget(left)
        left = after
        if not left.limit(1).count():
            break
    roots = rounds.pop()
    while rounds:
        earlier = rounds.pop().select("node", F.col("root").alias("_via"))
        later = roots.select(F.col("node").alias("_via"), "root")
        whole = lookup_join(earlier, later, "_via", "left")
        roots = keep(whole.select("node", F.coalesce("root", "_via").alias("root")), "roots")
    return roots
