"""MinHash near-dedup by bottom-k sketches from one hash function.

1. Each document's set of shingles (hashes of five-word runs) gives its size, a digest and its `k` smallest hashes.
   Documents of equal sets form a class; from here on one row stands for a class.
2. Inverted lists of retained values. Two sets with a Jaccard similarity of 0.75 share about three quarters of their
   sketches (standard deviation 3.5 of 64); at least `share` of a sketch is asked for, about seven deviations below.
   Sets that share so many retained values share one among the rarest `size - needed + 1` of either (prefix filter), so
   the common values of a passage that stands in many documents open no candidates at all.
3. Only links between different components matter. A few rounds link each class to the class it shares most with among
   the lists' hubs (one member a list), so a group of g near copies costs about g pairs a round, not its square. Lists
   whose members then are in one component are done. For the classes in the others the lists are made anew, from the
   rarest quarter of their full sets (the exact prefix filter: a passage in many documents opens nothing unless it is
   three quarters of them); after one more round, all pairs across components that these lists still hold follow, unless
   their sizes, the places of the shared value in both, or the parities of their hashes rule the similarity out.
4. Every pair is filtered by the estimate from the union of the two sketches and verified on the full sets.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer than five
words are one shingle; a null doc_id stands in no component of another document and is kept only if nothing with an id
equals it (deduplicated() goes by texts: there rows with null or repeated ids link as all others do); repeated rows are copies; an empty table gives an empty result; other columns have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import shingles
from kindred.llm.common import components, stored

K = 64
SHARE = 0.375
#: The estimate of a pair may be so far below the threshold: over six standard deviations at k = 64.
MARGIN = 0.35
ROUNDS = 2
#: Hubs that a class meets in the round on the second lists: most of those left link with some members of a large group and not with others.
HUBS = 2


def _sets(texts, n: int) -> Iterator[np.ndarray]:
    for words in shingles.word_hashes(texts):
        yield np.unique(shingles.runs(words, n))


def _slices(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: a batch's texts are not all Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _class(whole: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, k: int = K, words: int = 5, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class (a digest of the set; null if empty) and sketch (the k smallest hashes, 8 bytes each). carried: further columns of 64-bit numbers to keep."""
    ids = ("doc_id", *carried)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = [(len(s), _class(s.tobytes()) if len(s) else 0, s[:k].tobytes()) for s in _sets(part["text"].to_pylist(), words)]
            n, c, s = (pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))
            yield pa.RecordBatch.from_arrays([*(part[x] for x in ids), n, c, s], [*ids, "n_shingles", "class", "sketch"])

    out = docs.select(*[F.col(x).cast("bigint") for x in ids], F.col("text")).mapInArrow(sketch, "".join(f"{x} bigint, " for x in ids) + "n_shingles bigint, class bigint, sketch binary")
    return out.withColumn("class", F.when(F.col("n_shingles") > 0, F.col("class")))


def postings(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """(value, class) of the retained values that can open a candidate. classes: class, n_shingles, sketch."""
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["sketch"].str.len().to_numpy(np.int64) // 8
            yield pd.DataFrame({"value": np.frombuffer(b"".join(batch["sketch"]), np.int64), "class": np.repeat(batch["class"].to_numpy(np.int64), sizes), "size": np.repeat(sizes, sizes)})

    every = classes.select("class", "sketch").mapInPandas(values, "value bigint, class bigint, size bigint")
    return _rarest(every, F.greatest(F.lit(1), F.floor(F.col("size") * share)).cast("int"))


def _rarest(values: DataFrame, needed: Column) -> DataFrame:
    """(value, class, size, place): of each class the size - needed + 1 rarest values and their places in that order. values: value, class, size. Values of one class only come first in that order and need no row."""
    often = stored(values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"))  # stored, so that AQE sees a join of two exchanges and can split a hot value
    shared = values.join(often, "value")
    lists = shared.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("v"))  # at most a set's size each
    lists = lists.withColumn("first", F.size("v") - needed + 1).filter("first > 0")
    place = (F.col("size") - F.size("v") + F.col("i") + 1).cast("int").alias("place")
    return lists.select("class", "size", "v", F.posexplode(F.slice("v", F.lit(1), F.col("first"))).alias("i", "x")).select("x.value", "class", "size", place)


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int = 5) -> DataFrame:
    """(class, set) with the sorted hashes, 8 bytes each, of the classes in wanted. One document of each is read again."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            whole = [s for s in (x.tobytes() for x in _sets(part["text"].to_pylist(), words)) if s]
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in whole], pa.int64()), pa.array(whole, pa.binary())], ["class", "set"])

    ids = classes.join(wanted, "class", "left_semi").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return texts.mapInArrow(full, "class bigint, set binary").join(wanted, "class", "left_semi").dropDuplicates(["class"])


def prefix_postings(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(value, class) of the rarest hashes of full sets, as many as two sets of that similarity cannot miss each other by; hashes of one set only are left out."""

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["set"].str.len().to_numpy(np.int64) // 8
            yield pd.DataFrame({"value": np.frombuffer(b"".join(batch["set"]), np.int64), "class": np.repeat(batch["class"].to_numpy(np.int64), sizes), "size": np.repeat(sizes, sizes)})

    values = sets.mapInPandas(every, "value bigint, class bigint, size bigint")
    return _rarest(values, F.ceil(F.col("size") * F.lit(threshold)).cast("int"))


def parities(sets: DataFrame) -> DataFrame:
    """(class, bits): 512 bits, each the parity of how many of a set's hashes fall on it. The bits in which two sets differ are at most the hashes in which they differ."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = [np.packbits(np.bincount((np.frombuffer(x, np.uint64) & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64).tolist() for x in batch["set"]]
            yield pd.DataFrame({"class": batch["class"], "bits": odd})

    return sets.mapInPandas(bits, "class bigint, bits array<bigint>")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float = 0.75, margin: float = MARGIN) -> DataFrame:
    """Those of pairs (a, b) of classes whose full sets have a Jaccard similarity of threshold or more. classes: class, n_shingles, sketch; sets: class, set."""
    top, bottom = round(threshold * 1000), 1000

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch["sa"], batch["sb"], batch["na"], batch["nb"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                union = np.union1d(a, b)
                size = len(union) if max(n, m) <= max(len(a), len(b)) else min(len(a), len(b))
                both = np.intersect1d(a, b, assume_unique=True)
                keep.append((both <= union[size - 1]).sum() >= (threshold - margin) * size)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * bottom >= F.greatest("na", "nb") * top)
    near = sized.mapInPandas(close, "a bigint, b bigint")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["xa"], batch["xb"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bottom * both >= top * (len(a) + len(b) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    whole = lambda x: sets.select(F.col("class").alias(x), F.col("set").alias(f"x{x}"))
    return stored(near.join(whole("a"), "a").join(whole("b"), "b").mapInPandas(exact, "a bigint, b bigint"))


def _hubs(lists: DataFrame, first: int, n: int = 1) -> DataFrame:
    """Up to n pairs a class: each with that one of the lists' hubs, under an order of its own, that it shares most lists with. lists: value, class, component."""
    key = lambda salt: F.struct(F.xxhash64(F.lit(salt), "class").alias("order"), F.col("class").alias("hub"), F.col("component").alias("hub_component"))
    hubs = stored(lists.groupBy("value").agg(*[F.min(key(first + k)).alias(f"h{k}") for k in range(n)]).select("value", F.array(*[f"h{k}" for k in range(n)]).alias("hubs")))
    met = lists.join(hubs, "value").select(F.col("class").alias("a"), "component", F.posexplode("hubs").alias("k", "h"))
    pairs = met.filter("h.hub_component <> component").groupBy("a", "k", F.col("h.hub").alias("b")).agg(F.count("*").alias("n"))
    best = pairs.groupBy("a", "k").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lists (value, class, …) with the component of each class, without those that lie in one component."""
    c = lists.withColumn("component", F.col("class")) if labels is None else lists.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = stored(c.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value"))
    return stored(c.join(split, "value", "left_semi"))  # value, class, size, place, component


def class_components(docs: DataFrame, classes: DataFrame, threshold: float = 0.75, rounds: int = ROUNDS, words: int = 5) -> DataFrame:
    """(node, component) of the classes that link with another class."""
    lists = stored(postings(classes))
    sets = stored(full_sets(docs, classes, lists.select("class").distinct(), words))
    links = tried = labels = None
    last = rounds + 1  # one round with hubs on the second lists, then what they leave open
    for k in range(last + 1):
        lists = _open(lists.drop("component"), labels)
        if lists.isEmpty():
            break
        if k == rounds:
            lists = _open(prefix_postings(sets.join(lists.select("class").distinct(), "class", "left_semi"), threshold), labels)
        if k < last:
            pairs = _hubs(lists, k, 1 if k < rounds else HUBS)
        else:
            held = lists.join(parities(sets.join(lists.select("class").distinct(), "class", "left_semi")), "class").select("value", "class", "component", "size", "place", *[F.col("bits")[i].alias(f"w{i}") for i in range(8)])
            x, y = (held.select("value", F.col("class").alias(s), F.col("component").alias(f"c{s}"), F.col("size").alias(f"n{s}"), F.col("place").alias(f"p{s}"), *[F.col(f"w{i}").alias(f"w{i}{s}") for i in range(8)]) for s in "ab")
            sizes = f"least(na, nb) >= {threshold!r} * greatest(na, nb) - 1e-6"
            enough = f"1 + least(na - pa, nb - pb) >= {threshold / (1 + threshold)!r} * (na + nb) - 1e-6"  # what can still be common after the place of this value
            differ = f"{' + '.join(f'bit_count(w{i}a ^ w{i}b)' for i in range(8))} <= {(1 - threshold) / (1 + threshold)!r} * (na + nb) + 1e-6"
            pairs = x.join(y, "value").filter(f"a < b AND ca <> cb AND {sizes} AND {enough} AND {differ}").select("a", "b").distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = verified(pairs, classes, sets, threshold)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = stored(components(links))
    return labels if labels is not None else classes.sparkSession.createDataFrame([], "node bigint, component bigint")


def grouped(docs: DataFrame, threshold: float = 0.75, words: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Copies and near copies, through any chain of links, share the smallest doc_id."""
    every = stored(sketches(docs, words=words))
    some = every.filter("n_shingles > 0")
    ids = stored(some.groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    classes = stored(some.join(ids, ["class", "doc_id"]).dropDuplicates(["class"]).select("class", "doc_id", "n_shingles", "sketch"))
    labels = class_components(docs, classes, threshold, words=words)
    named = ids.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "component").select("class", "component_id"))
    out = every.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs with one row of each component of texts: that of the smallest id, a null id last. Texts without words stay; of rows equal in id and text one does.

    Ids may be null or repeated, so a row is known by a hash of its id and text, and that is what stands for its class.
    """
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(row.alias("doc_id"), F.col("doc_id").cast("bigint").alias("id"), "text")
    every = stored(sketches(keyed, carried=("id",)))
    first = stored(every.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "doc_id")).alias("first")))
    classes = stored(every.join(first.select("class", F.col("first.doc_id").alias("doc_id")), ["class", "doc_id"]).dropDuplicates(["class"]).select("class", "doc_id", "n_shingles", "sketch"))
    labels = class_components(keyed, classes, threshold)
    best = first.join(labels.withColumnRenamed("node", "class"), "class", "left").groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("first").alias("first"))
    kept = stored(best.select(F.col("first.doc_id").alias("_row")).unionByName(every.filter("class IS NULL").select(F.col("doc_id").alias("_row")).distinct()))
    again = stored(every.groupBy(F.col("doc_id").alias("_row")).agg(F.count("*").alias("n")).filter("n > 1").join(kept, "_row", "left_semi").select("_row"))
    out = docs.withColumn("_row", row).join(kept, "_row", "left_semi")
    if not again.isEmpty():
        out = out.join(again, "_row", "left_anti").unionByName(out.join(again, "_row", "left_semi").dropDuplicates(["_row", "doc_id", "text"]))  # hashes may collide, rows may not go
    return out.drop("_row").select(docs.columns)


#: The digest that op8 returns, in DuckDB: shingles as text, all pairs that share one, and what can be reached over links.
SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM d),
one AS (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM sets),
common AS (SELECT a.rid AS a, b.rid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM one a JOIN one b ON a.x = b.x AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * n >= 75 * (na + nb - n)),
reach AS (SELECT rid AS a, rid AS b FROM sets UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS rid, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.rid = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN least USING (rid)
"""
