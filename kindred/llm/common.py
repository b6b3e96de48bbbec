"""What the operators of this subpackage share: folds, word columns and connected components; and stored(), for their imports."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindred.sources.store import stored

#: The white space that separates words: space and the code points 9 to 13.
SPACES = "\t\n\x0b\x0c\r"


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def spaced(text: Column) -> Column:
    """text (null: empty) with every separator of words as a space."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(spaced_text: Column) -> Column:
    """The words of what spaced() returns, in order."""
    return F.array_remove(F.split(spaced_text, " ", -1), "")


def occurrences(text: Column, char: str) -> Column:
    """How often a one-byte character stands in text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def trimmed() -> None:
    """Gives the freed memory of this process back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


#: Graphs of so many edges (4 MB) are solved on the driver.
FEW_EDGES = 1 << 18


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node that each reaches: roots hook to smaller roots beside them, then all point to their roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an undirected graph, as (node, component): each node that has an edge, with the smallest node it reaches.

    edges has columns (a, b). Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two
    aggregations over the edges, so a component of any size is never gathered in one task, and a number of rounds that
    grows with the logarithm of the longest path. Stops when a round changes no edge; raises if max_rounds do not suffice.
    At most `few` distinct edges are solved on the driver instead, where a round costs no tasks.
    No edges give no rows; loops and repeated edges have no effect beyond naming their node.
    """
    seen = Observation()
    e = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().observe(seen, F.count(F.lit(1)).alias("n")))
    if seen.get["n"] <= few:
        held = e.toArrow()
        nodes, least = _least(*(held[c].to_numpy().astype(np.int64) for c in "ab"))
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least}), "node bigint, component bigint")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a OR a = b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.unionByName(e.filter("a = b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        seen = Observation()
        e = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        now = (seen.get["n"], seen.get["h"])
        if now == before:
            return e.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()
        before = now
    raise RuntimeError(f"components: {max_rounds} rounds did not suffice")
