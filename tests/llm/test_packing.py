import random
import zlib

import numpy as np
import pytest

from kindred.llm import bestfit, exactfit, tokens

DOC = "doc_id long, text string, piece string"
TEXTS = ["", None, "Hello, WORLD! it's 12ab", "naïve café ÀÉ's ŁÓDŹ", "<|endoftext|> a", "word " * 9000, "a\tb\x0bc  d", "x" * 3000, "Hello, WORLD! it's 12ab"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", ""), (2, TEXTS[2], "")], DOC)


def test_encoder_equals_tokenizer(tokenizer):
    enc = tokens.Encoder(tokens.default_path())
    r = random.Random(1)
    letters = "abcÄß漢é'.,!%0²Ⅷİ́Σς "
    for t in [*TEXTS, *("".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300))]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == ids(tokenizer, t), repr(t)


def test_exact_fit_pieces(spark, tokenizer):
    got = exactfit.packed(docs(spark)).toPandas()
    for i, t in enumerate(TEXTS):
        want = ids(tokenizer, t)
        rows = got[got.doc_id == i].drop_duplicates(["piece"]).sort_values("piece")
        assert rows.start.tolist() == list(range(0, len(want), 4096)) and rows.length.sum() == len(want)
        assert rows.ids_crc32.tolist() == [zlib.crc32(np.array(want[a : a + 4096], "<u4").tobytes()) for a in range(0, len(want), 4096)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == s.length.cumsum().to_numpy() - s.length.to_numpy()).all() and s.length.sum() <= 4096
    assert len(got) == sum(-(-len(ids(tokenizer, t)) // 4096) for t in TEXTS) + 2
    assert exactfit.packed(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_places_everything_tightly(seed):
    r = random.Random(seed)
    h = {}
    for _ in range(4000):
        n = r.choice([r.randint(1, 4096), r.randint(1, 200), 4096, 700])
        h[n] = h.get(n, 0) + 1
    plan = exactfit.solve(h)
    used = {}
    for pattern, times in plan:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= 4096
        for x, n in pattern.items():
            used[x] = used.get(x, 0) + n * times
    assert used == h
    assert sum(t for _, t in plan) <= -(-sum(x * n for x, n in h.items()) // 4096) * 1.01 + 2


def test_one_length_only(spark):
    assert sum(t for _, t in exactfit.solve({3000: 10})) == 10
    assert sum(t for _, t in exactfit.solve({2048: 10})) == 5 and exactfit.solve({}) == []


def naive(lengths, width):
    room, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(c, k) for k, c in enumerate(room) if c >= lengths[i]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(room)
            room.append(width)
            out.append([])
        room[k] -= lengths[i]
        out[k].append(i)
    return room, out


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_equals_naive_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 100) for _ in range(300)]
    room, _ = naive(lengths, 100)
    got = bestfit.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in s) for s in got) == sorted(room)
    assert sorted(i for s in got for i in s) == list(range(300))


def test_best_fit_round_trip(spark, tokenizer):
    out = bestfit.packed(docs(spark), buffer=5000)
    rows = out.collect()
    for r in rows:
        assert len(r["input_ids"]) == 2 * 4096 == len(r["position_ids"]) and r["cu_seqlens"][-1] == r["n_tokens"] <= 4096
        position = np.frombuffer(r["position_ids"], "<u2")
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (position[a:b] == np.arange(b - a)).all()
    back = {}
    for r in bestfit.unpacked(out).collect():
        back.setdefault(r["doc_id"], {})[r["piece"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, t in enumerate(TEXTS):
        assert [x for _, p in sorted(back[i].items()) for x in p] == ids(tokenizer, t)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert bestfit.packed(docs(spark).limit(0)).count() == 0


def test_equal_rows_have_places_of_their_own(spark):
    d = spark.createDataFrame([(1, "same text here", "")] * 3000 + [(2, "other", "")] * 10, DOC).repartition(5)
    got = exactfit.packed(d).toPandas()
    assert len(got) == 3010 and not got.duplicated(["sequence_id", "offset"]).any()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == s.length.cumsum().to_numpy() - s.length.to_numpy()).all() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 4096)


def test_ids_too_wide_for_the_matrix_are_an_error(spark):
    with pytest.raises(ValueError, match="wider kind"):
        bestfit.packed(docs(spark), kind="<u1")
    with pytest.raises(ValueError, match="wider kind"):
        bestfit.packed(docs(spark), width=1 << 17)


def test_plain_words_skip_the_search_for_words():
    enc = tokens.Encoder(tokens.default_path())
    assert enc.bare is not enc.tokenizer
    pick = random.Random(5)
    some = [*"abEJHtywß.,!#_1 \n\t\x0b'", "̌", "̱", "İ", "Σ", "σ", "²", "Ⅷ", "é", "É", "字", "ؤ", "'s", "  ", "\xa0", "　", "😀", "Ⓐ", "ǅ", "ﬁ", "ª", "µ", "Haus", "ÉTÉ,", "straße"]
    texts = ["".join(pick.choices(some, k=pick.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END_ID], repr(text)
