"""Embedding near-dedup by a robust-pruned flat graph.

1. Equal vectors form a class, so copies are one node however many there are. Classes are 64-bit hashes; where two vectors
   share one, another seed is taken.
2. Centroids are fitted on a bounded sample (at most `SAMPLE` classes, by a hash of the vector); every class is indexed in
   its `overlap` nearest shards. Beyond `MOST_SHARDS` shards each of these cells has centroids of its own, fitted on at most
   `CELL_SAMPLE` of its classes, so shards grow with the rows. A shard larger than `BLOCK` rows is dealt into blocks, so no
   task holds more.
3. Each shard's block becomes a graph: every node's nearest neighbours, robustly pruned (a neighbour goes if a kept one is
   `ALPHA` times closer to it than the node is), and a chain through the block that keeps all nodes reachable. The
   adjacency lists of a node from all its shards are united.
4. Search: in each of its shards a query goes greedily from the medoid towards itself; from what it finds, the range
   expands over neighbours whose cosine is at least `threshold - slack`, until none is new. Blocks of a large shard are
   searched for each block of queries.
5. Links are verified by the cosine in double precision. A pair that shares several shards is counted in the first of
   them only; a task returns counts and a spanning forest of what it found, never its pairs.
6. Recall is audited against brute force on `AUDIT` classes (all, if there are no more), chosen by hash whatever the search
   found, over all rows: once over their links and once as the mean over those with links, of which the lesser counts. Below
   `least_recall` the overlap is doubled and the search repeated; if `WIDEST` shards a vector do not suffice either, an
   error names the recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
components of double precision are compared as such, however great or small; vectors that differ only in length of the
arrow are not equal, but link;
vectors of another length than the most frequent one link only among their own length (each length is a graph of its own
shard); a null vec_id gets no row of another component; repeated rows count as copies; an empty table gives an empty
result; other columns, labels among them, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import components, stored

SAMPLE = 50_000
SHARD = 1_000
MOST_SHARDS = 4_096
BLOCK = 4_096
NEIGHBOURS = 48
DEGREE = 24
ALPHA = 1.2
BEAM = 8
AUDIT = 1_024
CELL_SAMPLE = 2_048
WIDEST = 24


def _unit(data, kind: str) -> np.ndarray:
    """Rows of bytes (numbers of that kind) as unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    v = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kind_of(embeddings: DataFrame) -> str:
    """Single precision where the column has it, else double."""
    return "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (its components' bytes; null if it links with nothing)."""
    kind = kind_of(embeddings)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for e in batch["embedding"]:
                v = None if e is None else np.array([np.nan if x is None else x for x in e], kind)
                out.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": out})

    column = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding")
    packed = embeddings.select(F.col("vec_id").cast("string"), column).mapInPandas(pack, "vec_id string, vector binary")
    return packed.withColumn("vec_id", F.col("vec_id").cast("bigint"))


def classed(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """every (vec_id, vector) with `class`, and a row a class: class, first_id, copies, vector."""
    for seed in range(42, 58):
        named = every.withColumn("class", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "vector")))
        sums = [F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.min("vector").alias("vector"), F.max("vector").alias("other")]
        classes = stored(named.filter("class IS NOT NULL").groupBy("class").agg(*sums))
        if classes.filter("vector <> other").isEmpty():
            return named, classes.drop("other")
    raise RuntimeError("no seed tells all vectors apart by 64 bits")


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of unit vectors, by some k-means steps."""
    x = x.astype(np.float32)
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(6):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c.astype(np.float32)


def centroids(classes: DataFrame, n: int, kind: str, seed: int = 11) -> dict[int, np.ndarray]:
    """For each vector length (in bytes) its cells' centres: at most MOST_SHARDS, from a sample of at most SAMPLE."""
    rows = classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("vector").collect()
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["vector"]), []).append(bytes(r["vector"]))
    return {length: _means(_unit(data, kind), max(1, min(MOST_SHARDS, len(data), round(n * len(data) / len(rows) / SHARD))), seed) for length, data in by_length.items()}


def _refined(rows: DataFrame, fine: int, kind: str) -> DataFrame:
    """rows (class, vector, copies, shards) with each of their cells replaced by the shard of the nearest of `fine` centres of that cell."""
    cells = rows.select("class", "vector", "copies", F.posexplode("shards").alias("k", "cell"))
    near = Window.partitionBy("cell").orderBy(F.xxhash64("class"))
    sample = cells.select("cell", "vector", F.row_number().over(near).alias("r")).filter(F.col("r") <= CELL_SAMPLE).select("cell", "vector")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = _unit(part["vector"].tolist(), kind)
        c = _means(x, min(fine, len(x)), 13)
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "centres": [c.tobytes()]})

    centres = stored(sample.groupBy("cell").applyInPandas(fit, "cell bigint, centres binary"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    held = centres.join(sizes, "cell").select(F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "centres")

    def assign(part: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        x = _unit(part["vector"].tolist(), kind)
        c = np.frombuffer(centres["centres"].iloc[0], np.float32).reshape(-1, x.shape[1])
        return part[["class", "k"]].assign(shard=part["cell"].to_numpy(np.int64) * (1 << 20) + (x @ c.T).argmax(1))

    placed = dealt.groupBy("cell", "part").cogroup(held.groupBy("c", "p")).applyInPandas(assign, "class bigint, k int, shard bigint")
    lists = placed.groupBy("class").agg(F.array_sort(F.collect_set("shard")).alias("shards"))  # at most `overlap` each
    return rows.drop("shards").join(lists, "class")


def robust_prune(v: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Of each node's neighbours, nearest first, those that no kept one stands for."""
    out = []
    for i, c in enumerate(near):
        between = 1.0 - v[c] @ v[c].T
        own = 1.0 - v[c] @ v[i]
        left, kept = np.ones(len(c), bool), []
        for j in range(len(c)):
            if left[j]:
                kept.append(j)
                if len(kept) == degree:
                    break
                left &= alpha * between[j] > own
        out.append(c[kept])
    return out


def build(v: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a block."""
    n = len(v)
    m = min(NEIGHBOURS, n - 1)
    near = np.zeros((n, m), np.int64)
    for a in range(0, n, 1024):
        s = v[a : a + 1024] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if m:
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            near[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    lists = [set(x.tolist()) for x in robust_prune(v, near)]
    for i in range(n):  # a chain, both ways, and each neighbour's way back
        lists[i].add((i + 1) % n)
        lists[i].add((i - 1) % n)
    for i, x in enumerate(robust := [list(s) for s in lists]):
        for j in x:
            lists[j].add(i)
    del robust
    return [np.fromiter((j for j in s if j != i), np.int64) for i, s in enumerate(lists)]


def search(v: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, threshold: float, slack: float, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the nodes of at least threshold, itself left out. own: the query's place among the nodes, or -1."""
    centre = v.mean(0)
    medoid = int((v @ centre).argmax())
    seen = np.full(len(v), -1, np.int64)
    for q, x in enumerate(queries):
        at = [medoid]
        seen[medoid] = q
        best = [(float(v[medoid] @ x), medoid)]
        open_ = list(best)
        while open_:  # greedy: the best open node's neighbours, until none of the beam is open
            open_.sort()
            s, node = open_.pop()
            if len(best) >= BEAM and s < best[-1][0]:
                break
            new = adjacency[node][seen[adjacency[node]] != q]
            if len(new):
                seen[new] = q
                at.extend(new.tolist())
                found = list(zip((v[new] @ x).tolist(), new.tolist(), strict=True))
                best = sorted(best + found, reverse=True)[:BEAM]
                floor = best[-1][0]
                open_ = [o for o in open_ + found if o[0] >= floor]
        nodes = np.array(at)
        if own[q] >= 0 and seen[own[q]] != q:
            seen[own[q]] = q
            nodes = np.append(nodes, own[q])
        sims = v[nodes] @ x
        front = nodes[sims >= threshold - slack]
        hits = [nodes[sims >= threshold]]
        while len(front):  # range expansion
            new = np.unique(np.concatenate([adjacency[i] for i in front]))
            new = new[seen[new] != q]
            seen[new] = q
            sims = v[new] @ x
            front = new[sims >= threshold - slack]
            hits.append(new[sims >= threshold])
        got = np.concatenate(hits)
        yield q, got[got != own[q]]


def linked(classes: DataFrame, n: int, kind: str, threshold: float = 0.95, slack: float = 0.05, overlap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(class, n_links) over the copies of other classes, and edges (a, b) of a spanning forest of each task's links. classes: class, vector, copies."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(centroids(classes, n, kind))  # at most MOST_SHARDS centres a length

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for length, part in batch.groupby(batch["vector"].str.len()):
                x = _unit(part["vector"].tolist(), kind)
                c = held.value.get(int(length))
                if c is None:  # a length that the sample misses
                    c = np.zeros((1, x.shape[1]), np.float32)
                k = min(overlap, len(c))
                near = np.sort(np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k], axis=1) + int(length) * MOST_SHARDS
                out.append(part.assign(shards=near.astype(np.int64).tolist()))
            if out:
                yield pd.concat(out)[["class", "vector", "copies", "shards"]]

    rows = stored(classes.select("class", "vector", "copies").mapInPandas(assign, "class bigint, vector binary, copies bigint, shards array<bigint>"))
    if n > MOST_SHARDS * SHARD:
        rows = stored(_refined(rows, -(-n // (MOST_SHARDS * SHARD)), kind))
    placed = rows.withColumn("shard", F.explode("shards"))
    blocks = placed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = stored(placed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("class", "shard"), F.col("blocks")).cast("int")))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        v, names = _unit(part["vector"].tolist(), kind), part["class"].to_numpy()
        return pd.DataFrame({"class": names, "near": [names[x].tolist() for x in build(v)]})

    lists = placed.select("shard", "block", "class", "vector").groupBy("shard", "block").applyInPandas(make, "class bigint, near array<bigint>")
    united = stored(lists.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # at most `overlap` bounded lists each

    def find(key, asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        columns = ["class", "n_links", "other", "count"]
        if not len(asked) or not len(nodes):
            return pd.DataFrame(columns=columns)
        shard, names, v = key[0], nodes["node"].to_numpy(np.int64), _unit(nodes["node_vector"].tolist(), kind)
        place = {int(c): i for i, c in enumerate(names)}
        adjacency = [np.array([place[j] for j in x if j in place], np.int64) for x in nodes["near"]]
        copies, first = nodes["copies"].to_numpy(np.int64), [set(x) for x in nodes["node_shards"]]
        asked_names = asked["class"].to_numpy(np.int64)
        own = np.array([place.get(int(c), -1) for c in asked_names])
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        counts, edges = np.zeros(len(asked), np.int64), []
        mine = [[s for s in x if s < shard] for x in asked["shards"]]
        for q, hits in search(v, adjacency, _unit(asked["vector"].tolist(), kind), threshold, slack, own):
            counted = hits if not mine[q] else np.array([h for h in hits if not any(s in first[h] for s in mine[q])], np.int64)
            counts[q] = copies[counted].sum() if len(counted) else 0
            a = root(int(asked_names[q]))
            for h in names[hits].tolist():
                b = root(h)
                if a != b:
                    parent[b] = a
                    edges.append((int(asked_names[q]), None, h))
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 2))
        counted, none = np.repeat([True, False], [len(asked), len(a)]), np.zeros(len(a), np.int64)
        return pd.DataFrame({"class": np.concatenate([asked_names, a]), "n_links": np.concatenate([counts, none]), "other": np.concatenate([np.zeros(len(asked), np.int64), b]), "count": counted})

    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = pairs.select(*[F.col(c).alias(a) for c, a in (("shard", "s"), ("block", "of"), ("with", "in"), ("class", "class"), ("vector", "vector"), ("shards", "shards"))])
    nodes = pairs.join(united, "class").select(*[F.col(c).alias(a) for c, a in (("shard", "t"), ("with", "nodes_of"), ("block", "nodes_in"), ("class", "node"), ("vector", "node_vector"), ("copies", "copies"), ("shards", "node_shards"), ("near", "near"))])
    found = stored(asked.groupBy("s", "of", "in").cogroup(nodes.groupBy("t", "nodes_of", "nodes_in")).applyInPandas(find, "class bigint, n_links bigint, other bigint, count boolean"))
    counts = found.filter("count").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    return counts, found.filter("NOT count").select(F.col("class").alias("a"), F.col("other").alias("b"))


def audited(classes: DataFrame, counts: DataFrame, kind: str, threshold: float = 0.95) -> float:
    """The lesser of two shares of brute-force links that the counts hold, over AUDIT classes chosen by hash, each compared with every row: of all their links, and the mean share of a class with links."""
    chosen = classes.orderBy(F.xxhash64("class")).limit(AUDIT).select("class", "vector")
    asked = chosen.join(counts, "class", "left").collect()
    if not asked:
        return 1.0
    held = classes.sparkSession.sparkContext.broadcast([(r["class"], bytes(r["vector"])) for r in asked])  # AUDIT vectors

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["vector"].str.len()):
                mine = [(c, x) for c, x in held.value if len(x) == length]
                if mine:
                    names = np.array([c for c, _ in mine])
                    hit = (_unit([x for _, x in mine], kind) @ _unit(part["vector"].tolist(), kind).T >= threshold) & (names[:, None] != part["class"].to_numpy()[None])
                    yield pd.DataFrame({"class": names, "n": hit @ part["copies"].to_numpy(np.int64)})

    compared = classes.select("class", "vector", "copies").mapInPandas(compare, "class bigint, n bigint")
    true = {r["class"]: r["n"] for r in compared.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # AUDIT rows
    found = {r["class"]: min(r["n_links"] or 0, true.get(r["class"], 0)) for r in asked}
    linked_ones = [c for c, n in true.items() if n]
    if not linked_ones:
        return 1.0
    return min(sum(found[c] for c in linked_ones) / sum(true[c] for c in linked_ones), sum(found[c] / true[c] for c in linked_ones) / len(linked_ones))


def grouped(embeddings: DataFrame, threshold: float = 0.95, least_recall: float = 0.98) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept, and recall: the audit's figure, the same in every row."""
    kind = kind_of(embeddings)
    every, classes = classed(stored(vectors(embeddings)))
    n, overlap = classes.count(), 3
    if not n:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    while True:
        counts, edges = linked(classes, n, kind, threshold, overlap=overlap)
        recall = audited(classes, counts, kind, threshold)
        if recall >= least_recall:
            break
        if overlap >= WIDEST:
            raise RuntimeError(f"recall {recall:.4f} is below {least_recall} with {overlap} shards a vector")
        overlap *= 2
    labels = components(edges)
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(least, "component").select("class", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = every.select("vec_id", "class").join(named, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(recall))


#: The digest that op6 returns where no link is missed, in DuckDB: all pairs, and what can be reached over links.
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT rid, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY reach.a),
n AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept, CAST(1 AS DOUBLE) AS recall FROM v JOIN least USING (rid) LEFT JOIN n USING (rid)
"""
