"""LM scoring by deleted interpolation.

p(w | u v) = a * c(u v w) / c(u v) + b * c(v w) / c(v) + g * c(w) / N + d / (V + 1), where (a, b, g, d) depend on the bucket of
the context's frequency: the power of two of c(u v), or of c(v) where u v does not occur. `least` is the count below which
pairs and triples count as not occurring: 1 for the method as it is, 2 (the default) so that a document does not vouch for
itself by what stands in it alone. Expectation-maximisation
learns them: one fold of the training documents is deleted from the counts, and the weights make that fold likely under the
counts that remain. An estimate without a context hands its weight to the next lower order. Scores then use the counts of
all training documents. c, N and V are exact and cover every training document; words, pairs and triples are told apart by
64-bit hashes.

Texts are gathered into blocks of some MB, each of one fold kind, in a stored table. A block asks for the counts of its
distinct words and pairs, and then of those triples of which both pairs occur twice (others can't): one row per block and
range of hashes, with sorted, difference-coded keys and its own counts. Where triples that occur once count, a held-out block
asks for all whose pairs occur; a training block that has a pair which occurs once knows that its triples occur once, and names
them only where held-out blocks have asked for both pairs. For each range the blocks' counts are added up and
the sums sent back in the order asked. So the corpus' occurrences are never shuffled one by one, a frequent key is one a
block, and nothing of the vocabulary's size is on one machine. Ranges grow with the input, and so that rows don't grow with
its square, more than 2^FAN_BITS ranges are reached in levels: the requests of some blocks for a wide range are merged into
one, which then asks for the narrower ranges in it. The expectation step is summed in a histogram whose cells are context
buckets and half octaves of the ratios of probabilities; the weights are fitted on the driver on that histogram, which has
some 100,000 cells in practice: counts of at most 2^40 leave room for no more than some millions, whatever the input's size.

Defined cases: a null or empty text is its end token alone; a null id belongs to no fold and trains; repeated rows count and
are scored each; without training documents every token has probability 1 / (V + 1) = 1 and scores are 0; an empty table
gives an empty result; other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shingles
from kindred.llm.common import fold, stored
from kindred.sources.store import released

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
#: A request is split at once into at most 2^FAN_BITS ranges, and about as many requests are merged for the next level.
FAN_BITS = 6
#: Marks the count of a pair that a held-out block asks for; counts are below.
ASKED = 1 << 40
#: Buckets by the frequency of one word of context, and as many again by that of two.
BUCKETS = 40
#: Cells of the histogram for one octave of a ratio, and the octaves covered on either side of 1.
CELLS, OCTAVES = 2, 48
END, START = np.uint64(0x51ED270B4D2C1B5F), np.uint64(0x2545F4914F6CDD1D)
_PAIR, _TRIPLE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, compressed: planes of zeros cost nothing."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, kind, n_bytes, ids, nulls, sizes, texts): documents of one kind together; kind 0 held out, 1 deleted fold, 2 other training documents. texts: compressed."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        waiting: dict[int, list] = {0: [], 1: [], 2: []}
        size, made, part = [0, 0, 0], 0, TaskContext.get().partitionId()

        def done(kind: int) -> pd.DataFrame:
            nonlocal made
            rows, waiting[kind] = waiting[kind], []
            ids = np.array([int(i or 0) for i, _ in rows], np.int64)
            block = pd.DataFrame([{
                "block": (part << 24) + made, "kind": kind, "n_bytes": size[kind], "ids": ids.tobytes(), "nulls": np.array([i is None for i, _ in rows], bool).tobytes(),
                "sizes": np.array([len(t) for _, t in rows], np.int64).tobytes(), "texts": zstandard.ZstdCompressor(level=7).compress(b"".join(t for _, t in rows)),
            }])
            made, size[kind] = made + 1, 0
            return block

        for batch in batches:
            for i, f, text in zip(batch["doc_id"], batch["f"], batch["text"], strict=True):
                kind = 0 if f == HELD_OUT else 1 if f == DELETED else 2
                data = (text or "").encode("utf-8", "surrogatepass")
                waiting[kind].append((i, data))
                size[kind] += len(data)
                if size[kind] >= BLOCK_BYTES or len(waiting[kind]) >= 1 << 17:
                    yield done(kind)
        for kind in waiting:
            if waiting[kind]:
                yield done(kind)

    source = docs.select(F.col("doc_id").cast("string"), fold(F.col("doc_id"), FOLDS).alias("f"), F.col("text"))
    return source.mapInPandas(gather, "block bigint, kind int, n_bytes bigint, ids binary, nulls binary, sizes binary, texts binary")


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each of x among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


class Tokens:
    """A block's tokens. words, pairs: sorted distinct hashes; word, v: places in words of each token and of the one before it; pair, uv: places in pairs of the pair that a token ends, and of the one before it."""

    def __init__(self, row):
        import zstandard

        sizes = np.frombuffer(row["sizes"], np.int64)
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(sizes.sum()))) if sizes.sum() else b""
        ends = np.cumsum(sizes)
        parts = list(shingles.word_hashes(data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)))
        end = np.array([END])
        self.lengths = np.array([len(p) + 1 for p in parts], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        hashes = np.concatenate([x for p in parts for x in (p, end)]) if parts else np.zeros(0, np.uint64)
        n, docs = len(hashes), len(parts)
        before = self._shifted(hashes, START)
        with np.errstate(over="ignore"):
            pairs = shingles.mix(before * _PAIR + hashes)
            none = shingles.mix(START * _PAIR + START)
            self.triple_hash = shingles.mix(self._shifted(pairs, none) * _TRIPLE + hashes)
        self.words, places = _unique(np.concatenate([hashes, np.full(docs, START)]))
        self.word, self.word_counts = places[:n], np.bincount(places, minlength=len(self.words))
        self.v = self._shifted(self.word, places[-1] if docs else 0)
        self.pairs, places = _unique(np.concatenate([pairs, np.full(docs, none)]))
        self.pair, self.pair_counts = places[:n], np.bincount(places, minlength=len(self.pairs))
        self.uv = self._shifted(self.pair, places[-1] if docs else 0)

    def _shifted(self, x: np.ndarray, start) -> np.ndarray:
        """What stands before each token; start before a document's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def triples(self, pair_totals: np.ndarray, least: int = 2, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens end a triple to ask for; these triples' sorted distinct hashes, and the place of each; which tokens end a triple that occurs once, here, and is not asked for. asked: in a training block, which pairs held-out blocks ask for."""
        both = lambda x: x[self.pair] & x[self.uv]
        mask = both(pair_totals >= least)
        alone = np.zeros(len(mask), bool)
        if least < 2 and asked is not None:
            alone = mask & ~both(pair_totals >= 2) & ~both(asked)
            mask = mask & ~alone
        return mask, *_unique(self.triple_hash[mask]), alone


REQUEST = "order int, part bigint, member bigint, keys binary, counts binary, gone binary"
REPLY = "member bigint, order int, part bigint, totals binary, gone binary, n bigint, n_gone bigint, v bigint"


def _split(order: int, member: int, keys: np.ndarray, counts: np.ndarray, gone: np.ndarray | None, bits: int) -> list[tuple]:
    """Rows of REQUEST, one for each range of 2^bits that keys fall in. gone: the counts of deleted documents, None for none, counts itself for all."""
    parts = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(np.diff(parts, prepend=np.uint64(1 << 63))).tolist() + [len(keys)]
    held = lambda a, b: None if gone is None else b"=" if gone is counts else _packed(gone[a:b])
    return [(order, int(parts[a]), member, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b]), held(a, b)) for a, b in zip(cuts, cuts[1:])]


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def requests(table: DataFrame, bits: int, least: int) -> DataFrame:
    """What each block asks of words (order 1) and pairs (order 2), with its own training counts and which of them are deleted. Where triples that occur once count, a held-out block's pairs are marked."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                t, out = Tokens(row), []
                for order, keys, counts in ((1, t.words, t.word_counts), (2, t.pairs, t.pair_counts)):
                    counts = counts * (row["kind"] > 0)
                    if least < 2 and order == 2 and row["kind"] == 0:
                        counts = counts + ASKED
                    out += _split(order, row["block"], keys, counts, counts if row["kind"] == 1 else None, bits)
                yield _table(out, REQUEST)

    return table.mapInPandas(ask, REQUEST)


def triple_requests(table: DataFrame, answered: DataFrame, bits: int, least: int) -> DataFrame:
    """What each block asks of triples (order 3), once it knows how often its pairs occur."""

    def ask(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in block.iterrows():
            t = Tokens(row)
            _, keys, places, _ = _triples(t, _answers(rows), row["kind"], least)
            counts = np.bincount(places, minlength=len(keys)) * (row["kind"] > 0)
            out += _split(3, row["block"], keys, counts, counts if row["kind"] == 1 else None, bits)
        return _table(out, REQUEST)

    return table.groupBy("block").cogroup(answered.filter("order = 2").groupBy("member")).applyInPandas(ask, REQUEST)


def _marked(counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts, and which are marked by ASKED."""
    return [c & (ASKED - 1) for c in counts], [c >= ASKED for c in counts]


def _merged(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The rows' keys as places among the distinct ones, these, and their counts in all and in deleted documents. What one row marks is marked in the first."""
    with np.errstate(over="ignore"):
        keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in rows["keys"]]
    counts, asked = _marked([_unpacked(c).astype(np.int64) for c in rows["counts"]])
    gone = [np.zeros(len(c), np.int64) if g is None else c if bytes(g) == b"=" else _unpacked(g).astype(np.int64) for g, c in zip(rows["gone"], counts, strict=True)]
    distinct, places = _unique(np.concatenate(keys))
    add = lambda x: np.bincount(places, weights=np.concatenate(x), minlength=len(distinct)).astype(np.int64)  # noqa: E731  # exact below 2^53
    total, asked = add(counts), np.concatenate(asked)
    if asked.any():
        mark = np.zeros(len(distinct), np.int64)
        mark[places[asked]] = ASKED
        total += mark
    return np.split(places, np.cumsum([len(k) for k in keys])[:-1]), distinct, total, add(gone)


def replies(asked: DataFrame, bits: int, members: int, done: int | None = None) -> DataFrame:
    """For each request the sums over all, in its order; and, as member -1, each range's number of training tokens, of deleted ones and of distinct ones. asked has 2^done ranges, to be narrowed to 2^bits."""
    done = min(bits, FAN_BITS) if done is None else done

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        places, distinct, total, gone = _merged(rows)
        out = [(m, int(key[0]), int(key[1]), _packed(total[i]), None if g is None else _packed(gone[i]), 0, 0, 0) for m, g, i in zip(rows["member"], rows["gone"], places, strict=True)]
        if key[0] == 1:
            real = distinct != START
            out.append((-1, 1, int(key[1]), None, None, int(total[real].sum()), int(gone[real].sum()), int((total[real] > 0).sum())))
        return _table(out, REPLY)

    if done >= bits:
        return asked.groupBy("order", "part").applyInPandas(add, REPLY)
    groups, narrow = -(-members // (1 << FAN_BITS)), min(bits, done + FAN_BITS)
    asked = stored(asked.withColumn("together", F.pmod(F.xxhash64("member"), F.lit(groups))))

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, distinct, total, gone = _merged(rows)
        return _table(_split(int(key[0]), int(key[2]), distinct, total, gone, narrow), REQUEST)

    inner = stored(replies(asked.groupBy("order", "part", "together").applyInPandas(merge, REQUEST), bits, groups, narrow))

    def back(key, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        places, *_ = _merged(rows)
        total, gone, asked = _answers(found)[int(key[0])]
        total = total + asked * ASKED
        return _table([(m, int(key[0]), int(key[1]), _packed(total[i]), None if g is None else _packed(gone[i]), 0, 0, 0) for m, g, i in zip(rows["member"], rows["gone"], places, strict=True)], REPLY)

    wide = inner.filter("member >= 0").withColumn("wide", F.shiftright("part", narrow - done))
    out = asked.groupBy("order", "part", "together").cogroup(wide.groupBy("order", "wide", "member")).applyInPandas(back, REPLY)
    return out.unionByName(inner.filter("member < 0"))


def _answers(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the sums over all training documents and over the deleted ones (0 where they were not asked for), and which are marked."""
    out = {}
    for order, part in rows.sort_values("part").groupby("order"):
        total, asked = _marked([_unpacked(x).astype(np.int64) for x in part["totals"]])
        gone = [np.zeros(len(t), np.int64) if g is None else _unpacked(g).astype(np.int64) for t, g in zip(total, part["gone"], strict=True)]
        out[order] = np.concatenate(total), np.concatenate(gone), np.concatenate(asked)
    return out


def _triples(t: Tokens, a: dict[int, tuple], kind: int, least: int) -> tuple:
    """The triples of a block with these answers."""
    return t.triples(a[2][0], least, a[2][2] if kind > 0 else None)


def _estimates(t: Tokens, totals: dict[int, np.ndarray], mask: np.ndarray, places: np.ndarray, alone: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the bucket of its context, and the three maximum-likelihood estimates, each over the uniform one (0 where there are no counts). totals: counts by order, of pairs and triples those that count."""
    divide = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0) * (v + 1.0)
    uv, one = totals[2][t.uv], totals[1][t.v]
    power = lambda x: np.minimum(BUCKETS - 1, np.frexp(x.astype(float))[1])
    bucket = np.where(uv > 0, BUCKETS + power(uv), power(one))
    triple = np.zeros(len(uv), np.int64)
    triple[mask], triple[alone] = totals[3][places], 1
    return bucket, divide(triple, uv), divide(totals[2][t.pair], one), totals[1][t.word] / max(n, 1) * (v + 1.0)


def _known(a: dict[int, tuple], left: bool, least: int) -> dict[int, np.ndarray]:
    """Counts by order, of all training documents or (left) without the deleted ones; those of pairs and triples below least as 0."""
    counts = {k: x - y if left else x for k, (x, y, _) in a.items()}
    often = lambda x: np.where(x >= least, x, 0)
    return {1: counts[1], 2: often(counts[2]), 3: often(counts.get(3, np.zeros(0, np.int64)))}


def expectation_counts(table: DataFrame, answered: DataFrame, n: int, v: int, least: int) -> DataFrame:
    """(bucket, three, two, one, tokens): tokens of the deleted fold by context bucket and by the cells of the ratios under the counts without that fold; cell -1: ratio 0."""

    def cell(ratio: np.ndarray) -> np.ndarray:
        out = np.full(len(ratio), -1, np.int64)
        out[ratio > 0] = np.clip(np.rint(np.log2(ratio[ratio > 0]) * CELLS), -OCTAVES * CELLS, OCTAVES * CELLS) + OCTAVES * CELLS
        return out

    names = ["bucket", "three", "two", "one"]

    def count(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in block.iterrows():
            t, a = Tokens(row), _answers(rows)
            mask, _, places, _ = _triples(t, a, row["kind"], least)  # those that occur once, here, are deleted
            bucket, *ratios = _estimates(t, _known(a, True, least), mask, places, np.zeros(len(mask), bool), n, v)
            wide = 2 * OCTAVES * CELLS + 2
            code = bucket.astype(np.int64)
            for r in ratios:
                code = code * wide + cell(r) + 1
            codes, tokens = np.unique(code, return_counts=True)
            cells = {}
            for name in names[:0:-1]:
                cells[name], codes = codes % wide - 1, codes // wide
            out.append(pd.DataFrame({"bucket": codes, **{k: cells[k] for k in names[1:]}, "tokens": tokens}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*names, "tokens"])

    deleted = table.filter("kind = 1")
    joined = deleted.groupBy("block").cogroup(answered.join(deleted.select(F.col("block").alias("member")), "member", "left_semi").groupBy("member"))
    return joined.applyInPandas(count, ", ".join(f"{x} bigint" for x in (*names, "tokens"))).groupBy(*names).agg(F.sum("tokens").alias("tokens"))


def weights(histogram: pd.DataFrame, steps: int = 60) -> np.ndarray:
    """Rows of four mixture weights (triple, pair, word, uniform), one for each context bucket, by expectation-maximisation; one pseudo-count each keeps every weight above 0. Buckets without tokens take those of all tokens."""
    ratio = lambda c: np.where(c < 0, 0.0, 2.0 ** ((c - OCTAVES * CELLS) / CELLS))
    h = histogram.astype("int64")
    likely = np.stack([*(ratio(h[x].to_numpy()) for x in ("three", "two", "one")), np.ones(len(h))], 1)
    tokens, bucket = h["tokens"].to_numpy(float), h["bucket"].to_numpy()

    def fit(rows: np.ndarray) -> np.ndarray:
        x, m = likely[rows], tokens[rows]
        w = np.full(4, 1 / 4)
        for _ in range(steps):
            share = x * w
            share *= (m / np.maximum(share.sum(1), 1e-300))[:, None]
            w = (share.sum(0) + 1.0) / (m.sum() + 4.0)
        return w

    every = fit(np.ones(len(h), bool)) if len(h) else np.array([0.0, 0.0, 0.0, 1.0])
    return np.stack([fit(bucket == b) if (bucket == b).any() else every for b in range(2 * BUCKETS)])


def scored(docs: DataFrame, least: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Pairs and triples count from `least` occurrences (1 or 2)."""
    if least not in (1, 2):
        raise ValueError("pairs and triples count from 1 or 2 occurrences")
    table = stored(blocks(docs))
    size, members = table.agg(F.sum("n_bytes"), F.count("*")).first()
    bits = max(0, (-(-int(size or 0) // RANGE_BYTES) - 1).bit_length())
    top = min(bits, FAN_BITS)
    answered = stored(replies(requests(table, top, least), bits, members))
    n, n_gone, v = (int(x or 0) for x in answered.filter("member < 0").agg(F.sum("n"), F.sum("n_gone"), F.sum("v")).first())
    columns = ["member", "order", "part", "totals", "gone"]
    answered = answered.filter("member >= 0").select(*columns)
    answered = answered.unionByName(stored(replies(triple_requests(table, answered, top, least), bits, members).filter("member >= 0").select(*columns)))
    mixture = weights(expectation_counts(table, answered, n - n_gone, v, least).toPandas())  # see above for its bound
    released(docs.sparkSession)

    def score(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in block.iterrows():
            t, a = Tokens(row), _answers(rows)
            counts = _known(a, False, least)
            mask, _, places, alone = _triples(t, a, row["kind"], least)
            bucket, three, two, one = _estimates(t, counts, mask, places, alone, n, v)
            w, word = mixture[bucket], counts[1][t.word]
            a = np.where(counts[2][t.uv] > 0, w[:, 0], 0.0)
            b = np.where(counts[1][t.v] > 0, w[:, 0] + w[:, 1] - a, 0.0)
            likely = a * three + b * two + (1 - w[:, 3] - a - b) * one + w[:, 3] if n else np.ones(len(word))
            each = lambda x: np.add.reduceat(x, t.first)
            ids = np.frombuffer(row["ids"], np.int64)
            names = [None if null else str(i) for i, null in zip(ids.tolist(), np.frombuffer(row["nulls"], bool), strict=True)]
            out.append(pd.DataFrame({
                "doc_id": names, "held_out": row["kind"] == 0, "n_tokens": t.lengths, "n_known": each((word > 0).astype(np.int64)), "train_tokens": n,
                "base_score": each(np.log10((word + 1.0) / (n + v + 1.0))), "score": each(np.log10(likely / (v + 1.0))),
            }))
        return pd.concat(out)

    schema = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return table.groupBy("block").cogroup(answered.groupBy("member")).applyInPandas(score, schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
