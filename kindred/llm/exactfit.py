"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most `width` tokens; only longer ones are cut. The plan is made on the histogram of piece
lengths (at most `width` numbers, whatever the input's size): from the longest length down, what a sequence still lacks
is looked up among single lengths, sums of pairs and sums of triples that are available, and a combination that fills it
exactly is used as often as its lengths' counts allow; where there is none, the longest length that fits goes in (best
fit) and the rest is looked up again. A plan is a list of patterns with repeat counts, of which each uses up a length.

Pieces then find their place by their rank among those of their length. Ranks come from two levels, (length, hash bucket)
and buckets in a length, so a length that a third of all pieces share is never in one task; rows that are equal have numbers
of their own, so that copies of one document spread over the buckets as well.

Defined cases: a null or empty text is the end id alone, one piece; repeated rows are packed each; an empty table gives an
empty result; other columns have no effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import tokens
from kindred.llm.common import stored

WIDTH = 4096


def pieces(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and ids (4 bytes each, little-endian) if asked for."""
    path = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = enc.ids(text)
                for k, at in enumerate(range(0, len(ids), 4 * width)):
                    part = ids[at : at + 4 * width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] * with_ids)))
            yield pd.DataFrame(rows, columns=columns)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInPandas(cut, "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))  # as text to Python and back: numbers with nulls among them become floating in pandas


class Sums:
    """Which sums single lengths, pairs and triples of available lengths have: bit s of a number stands for the sum s. Rebuilt when a length is used up."""

    def __init__(self, counts: np.ndarray):
        width = len(counts) - 1
        mask = (1 << (width + 1)) - 1
        self.there = [int(x) for x in np.flatnonzero(counts > 0)]
        self.single = sum(1 << x for x in self.there)
        self.pair = self.triple = 0
        for x in self.there:
            self.pair |= self.single << x & mask
        for x in self.there:
            self.triple |= self.pair << x & mask


def _two(free: np.ndarray, gap: int) -> list[int] | None:
    """Two lengths that fill gap exactly, those that can most often."""
    a = np.arange(1, gap // 2 + 1)
    if not len(a):
        return None
    enough = np.minimum(free[a], free[gap - a]) - (2 * a == gap) * (free[a] + 1) // 2
    best = int(a[enough.argmax()])
    return [gap - best, best] if enough.max() > 0 else None


def _exact(counts: np.ndarray, used: dict[int, int], gap: int, sums: Sums) -> list[int] | None:
    """One to three lengths that fill gap exactly, beside those used already. The index of sums says which kinds can; counts decide."""
    free = counts[: gap + 1].copy()
    for length, n in used.items():
        if length <= gap:
            free[length] -= n
    if sums.single >> gap & 1 and free[gap] > 0:
        return [gap]
    if sums.pair >> gap & 1 and (found := _two(free, gap)):
        return found
    if sums.triple >> gap & 1:
        for c in np.flatnonzero(free[:gap] > 0)[::-1].tolist():
            if 3 * c < gap:
                break
            if sums.pair >> (gap - c) & 1:
                free[c] -= 1
                if found := _two(free, gap - c):
                    return [c, *found]
                free[c] += 1
    return None


def solve(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often}, number of sequences) that place every piece."""
    counts = np.zeros(width + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out, sums = [], None
    for length in range(width, 0, -1):
        while counts[length] > 0:
            used, gap = {length: 1}, width - length
            while gap > 0:
                sums = sums or Sums(counts)
                if fill := _exact(counts, used, gap, sums):
                    for x in fill:
                        used[x] = used.get(x, 0) + 1
                    gap = 0
                    break
                free = counts[: gap + 1].copy()
                for x, n in used.items():
                    if x <= gap:
                        free[x] -= n
                if not len(fits := np.flatnonzero(free > 0)):
                    break
                x = int(fits[-1])
                used[x] = used.get(x, 0) + 1
                gap -= x
            times = int(min(counts[x] // n for x, n in used.items()))
            for x, n in used.items():
                counts[x] -= n * times
                if counts[x] == 0:
                    sums = None
            out.append((used, times))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how often in a sequence, offset), sorted: where the pieces of a length go, by rank."""
    rows, next_rank, sequence = [], {}, 0
    for used, times in patterns:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, next_rank.get(length, 0), sequence, n, offset))
            next_rank[length] = next_rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(cut: DataFrame) -> DataFrame:
    """cut (with `row`, a number of its own for each row) with `rank`, from 0 within each length."""
    many = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 1
    buckets = int(np.ceil(np.sqrt(many)))
    b = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(buckets)))
    sums = b.groupBy("length", "bucket").count()
    before = sums.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row")) - 1
    return b.withColumn("own", own).join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("own") + F.col("before")).drop("bucket", "own", "l", "b", "before")


def packed(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """Every piece with sequence_id and offset: its sequence and its place there. The plan is broadcast: at most 2 * width patterns of at most sqrt(2 * width) lengths, some MB."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, width, with_ids).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `width` rows
    table = spark.sparkContext.broadcast(places(solve(histogram, width)))
    kept = [c for c in cut.columns if c != "row"]

    kept_types = [(c, "string" if c == "doc_id" else t) for c, t in cut.dtypes if c in kept]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = table.value
        order = (at[:, 0] << 44) + at[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            row = at[np.searchsorted(order, (length << 44) + rank, "right") - 1] if len(batch) else np.zeros((0, 5), np.int64)
            i = rank - row[:, 1]
            yield batch[kept].assign(sequence_id=row[:, 2] + i // np.maximum(row[:, 3], 1), offset=row[:, 4] + i % np.maximum(row[:, 3], 1) * length)

    schema = ", ".join(f"{c} {t}" for c, t in kept_types) + ", sequence_id bigint, offset bigint"
    out = ranked(cut).withColumn("doc_id", F.col("doc_id").cast("string")).select(*kept, "rank").mapInPandas(place, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
