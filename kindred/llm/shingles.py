"""64-bit hashes of words and of runs of words, over whole texts, by numpy: a few passes over the bytes instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed in blocks of about so many bytes, which bounds memory whatever a text's length.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: Odd and without a pattern, so that the order of equal words in a run matters.
    _STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _table() -> dict[str, np.ndarray]:
    if not _tables:
        n = BLOCK + 8
        with np.errstate(over="ignore"):
            _tables["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
            for name, p in (("power", 0xD1342543DE82EF95), ("inverse", pow(0xD1342543DE82EF95, -1, 1 << 64))):
                _tables[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)]), dtype=np.uint64)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _tables["space"] = space
    return _tables


def _block_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in at most BLOCK bytes. A word's hash is a polynomial in random numbers for its bytes, from differences of one running sum."""
    t = _table()
    b = np.frombuffer(data, np.uint8)
    inner = np.concatenate([[True], t["space"][b], [True]])
    change = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = change[::2], change[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(t["byte"][b] * t["power"][: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * t["inverse"][starts] + (ends - starts).astype(np.uint64)
    return mix(h), starts


def word_hashes(texts: Iterable[str | bytes | None], lower: bool = True) -> Iterator[np.ndarray]:
    """For each text (null: empty; or its UTF-8 bytes) the hashes of its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased unless told otherwise."""
    waiting: list[bytes] = []
    size = 0

    def done() -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h, starts = _block_words(b"\n".join(waiting))
        cuts = np.cumsum([len(x) + 1 for x in waiting])
        yield from np.split(h, np.searchsorted(starts, cuts)[:-1])

    for text in texts:
        data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        data = data.lower() if lower else data  # bytes: A-Z alone
        if waiting and (size + len(data) + 1 > BLOCK or len(data) > BLOCK // 2):
            yield from done()
            waiting, size = [], 0
        if len(data) > BLOCK // 2:
            yield _long(data)
            continue
        waiting.append(data)
        size += len(data) + 1
    if waiting:
        yield from done()


def _long(data: bytes) -> np.ndarray:
    """A long text, block by block, cut at white space; a word longer than a block is hashed by its blocks' hashes in turn."""
    out, at = [], 0
    carried = None
    with np.errstate(over="ignore"):
        while at < len(data):
            end = min(len(data), at + BLOCK // 2)
            whole = end == len(data)
            if not whole:
                cut = max(data.rfind(bytes([c]), at, end) for c in (9, 10, 11, 12, 13, 32))
                whole = cut >= at
                end = cut + 1 if whole else end
            h, starts = _block_words(data[at:end])
            if carried is not None:
                if len(h) and starts[0] == 0:
                    h = np.concatenate([mix(carried * np.uint64(31) + h[:1]), h[1:]])
                else:
                    h = np.concatenate([carried, h])
            carried = None if whole else h[-1:]
            out.append(h if whole else h[:-1])
            at = end
        if carried is not None:
            out.append(carried)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each run of n words, in order; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out += words[k : len(words) - size + 1 + k] * _STEP[k]
            out = mix(out) if k == size - 1 else out
    return out
