"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities.

Documents are tokenised and cut losslessly into pieces of at most `width` ids. Packing happens where the documents lie: a
task gathers pieces up to `buffer` ids, sorts them by falling length and puts each into the open sequence with the least
room that still holds it; a segment tree over the width + 1 possible capacities finds that room in log2(width) steps. No
shuffle, memory bounded by the buffer whatever a text's or partition's size, and a lost executor's task packs the same
again. The price is a few sequences a buffer that are not full.

Each row is one sequence: its ids padded to the matrix' width, cumulative segment lengths, position ids that restart at
every segment, and which pieces of which documents it holds.

Defined cases: null and empty texts are the end id alone; a null id is kept as null; repeated rows are packed each; an
empty table gives an empty result; other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import tokens

WIDTH = 4096
#: Ids gathered before they are packed: 8 MB at 4 bytes.
BUFFER = 2 << 20
SCHEMA = "sequence_id bigint, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class Capacities:
    """A segment tree over capacities 0 to width: which capacities have an open sequence."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The sequence with the least capacity of at least length, taken out of the tree, and that capacity."""
        count, at = self.count, length + self.size
        if not count[at]:
            while at and (at & 1 or not count[at + 1]):  # up until a right neighbour has one
                at >>= 1
            if not at:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], width: int = WIDTH) -> list[list[int]]:
    """Which pieces (by place in lengths) share a sequence. Equal lengths keep their order."""
    tree, out = Capacities(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = len(out), width
            out.append([])
        sequence, capacity = found
        out[sequence].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], sequence)
    return out


def _rows(pieces: list[tuple], width: int, first: int, kind: str) -> pd.DataFrame:
    rows = []
    for k, members in enumerate(best_fit_decreasing([len(p[3]) // 4 for p in pieces], width)):
        held = [pieces[i] for i in members]
        sizes = [len(p[3]) // 4 for p in held]
        ids, positions = np.zeros(width, kind), np.zeros(width, kind)
        ids[: sum(sizes)] = np.frombuffer(b"".join(p[3] for p in held), "<u4")
        positions[: sum(sizes)] = np.concatenate([np.arange(n) for n in sizes])
        rows.append((first + k, sum(sizes), len(held), [p[0] for p in held], [p[1] for p in held], [p[2] for p in held], [0, *np.cumsum(sizes).tolist()], ids.tobytes(), positions.tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def packed(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, buffer: int = BUFFER, kind: str = "<u2") -> DataFrame:
    """One row per sequence. kind: numpy's type of the matrices' numbers; two bytes hold a vocabulary and a width of up to 65,536, and a type too small for either is an error."""
    path = tokenizer or tokens.default_path()
    most = max(tokens.largest_id(path), width - 1)
    if most > np.iinfo(kind).max:
        raise ValueError(f"numbers of type {kind} can't hold {most}; ask for a wider kind")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, waiting, size = tokens.encoder(path), [], 0
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = enc.ids(text)
                for k, at in enumerate(range(0, len(ids), 4 * width)):
                    waiting.append((None if doc_id is None else int(doc_id), k, at // 4, ids[at : at + 4 * width]))
                    size += len(waiting[-1][3]) // 4
                    if size >= buffer:
                        out = _rows(waiting, width, made, kind)
                        made, waiting, size = made + len(out), [], 0
                        for a in range(0, len(out), 64):
                            yield out.iloc[a : a + 64]
        if waiting:
            out = _rows(waiting, width, made, kind)
            for a in range(0, len(out), 64):
                yield out.iloc[a : a + 64]

    return docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInPandas(pack, SCHEMA)


def unpacked(sequences: DataFrame, kind: str = "<u2") -> DataFrame:
    """The pieces again: doc_id, piece, start, ids (4 bytes each); the round trip of packed()."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                ids = np.frombuffer(r.input_ids, kind)
                rows += [(d, p, s, ids[a:b].astype("<u4").tobytes()) for d, p, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:])]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "ids"])

    return sequences.mapInPandas(cut, "doc_id bigint, piece int, start bigint, ids binary")


def write(sequences: DataFrame, path: str) -> None:
    """The packed sequences as Parquet: a row of the id matrix, its segments and its positions each; committed by Spark's writers, so no executor's loss leaves half a file."""
    sequences.write.mode("overwrite").parquet(path)
