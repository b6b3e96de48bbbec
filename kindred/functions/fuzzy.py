"""String similarities that Spark lacks: indel ratio, token-sort and token-set ratios, Jaro-Winkler. One crossing to Python a pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time in one number's bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / both lengths; 0 if either is empty."""
    if not a or not b:
        return 0.0
    return 100.0 if a == b else 200.0 * _common(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """100 if one side's words lie in the other's and any is shared; else the best of shared words against shared words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    shared = " ".join(sorted(both))
    left, right = (" ".join(filter(None, (shared, " ".join(sorted(s - both))))) for s in (x, y))
    best = ratio(left, right)
    if shared:
        best = max(best, *(200.0 * len(shared) / (len(shared) + len(s)) for s in (left, right)))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; the bonus for a common start of up to four letters counts above 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + 0.1 * start * (1 - jaro) if jaro > 0.7 else jaro


MEASURES = {"ratio": ratio, "set": token_set, "sort": token_sort, "jw": jaro_winkler}

# The same measures of many pairs at once: a step of the loops takes a letter of every pair, a text's places lie in the bits of 64-bit words.

_BITS = 64
#: Words of a text; pairs of longer texts are measured one by one.
_WORDS = 4
#: Cells (pairs times letters of the alphabet times words) of a table of places.
_TABLE = 200_000
_ALL = np.uint64(2**64 - 1)
_ONE = np.uint64(1)


def _coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Two arrays (pair, place) of the texts' letters, numbered from 1, with 0 after a text's end; and how many letters there are."""
    codes = np.frombuffer("".join((*a, *b)).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(codes.max(initial=0)) + 1, bool)
    known[codes] = True
    codes = known.cumsum(dtype=np.int64)[codes]
    size = np.array([*map(len, a), *map(len, b)])
    end = size.cumsum()
    out = []
    for n in (slice(0, len(a)), slice(len(a), None)):
        inside = np.arange(size[n].max(initial=0)) < size[n][:, None]
        letters = np.zeros(inside.shape, np.int64)
        letters[inside] = codes[end[n.start] - size[n.start] : end[n][-1]]
        out.append(letters)
    return *out, int(known.sum())


def _places(letters: np.ndarray, alphabet: int, words: int) -> np.ndarray:
    """(word, pair, letter): the places of a letter in a pair's text as bits."""
    rows = np.arange(len(letters))
    table = np.zeros((words, len(letters), alphabet + 1), np.uint64)
    for i in range(letters.shape[1]):
        table[i // _BITS, rows, letters[:, i]] |= _ONE << np.uint64(i % _BITS)
    table[:, :, 0] = 0
    return table


def _chunks(pairs: np.ndarray, alphabet: int, words: int):
    n = max(1, _TABLE // ((alphabet + 1) * words))
    return (pairs[i : i + n] for i in range(0, len(pairs), n))


def common_all(a: list[str], b: list[str]) -> np.ndarray:
    """_common of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [(x, y) if len(x) <= max(len(y), _BITS) else (y, x) for x, y in zip(a, b, strict=True)]  # a query's text comes in many pairs, and its table of places is made once
    size = np.array([len(x) for x, _ in short], np.int64)
    for k in np.flatnonzero(size > _BITS * _WORDS):
        out[k] = _common(*short[k])
    for words in range(1, _WORDS + 1):
        at = np.flatnonzero((size > _BITS * (words - 1)) & (size <= _BITS * words))
        if not len(at):
            continue
        at = at[np.argsort([-len(short[k][1]) for k in at], kind="stable")]  # texts that end take no further steps
        texts: dict[str, int] = {}
        own = np.array([texts.setdefault(short[k][0], len(texts)) for k in at], np.int64)
        x, y, alphabet = _coded(list(texts), [short[k][1] for k in at])
        for part in _chunks(np.arange(len(at)), alphabet, words):
            some, place = np.unique(own[part], return_inverse=True)
            table, right = _places(x[some], alphabet, words).reshape(words, -1), y[part]
            row = [np.full(len(part), _ALL) for _ in range(words)]
            base, still = place * (alphabet + 1), (right > 0).sum(0)
            for j, n in enumerate(still):
                if not n:
                    break
                where, carry = base[:n] + right[:n, j], None
                for w in range(words):
                    r = row[w][:n]
                    hit = r & table[w][where]
                    total = r + hit
                    over = total < r
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    row[w][:n] = total | (r ^ hit)
                    carry = over.astype(np.uint64)
            for w in range(words):
                left = np.clip(size[at[part]] - w * _BITS, 0, _BITS).astype(np.uint64)
                mask = np.where(left == _BITS, _ALL, (_ONE << np.minimum(left, np.uint64(_BITS - 1))) - _ONE)
                out[at[part]] += np.bitwise_count(~row[w] & mask).astype(np.int64)
    return out


def ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.array([100.0 if x and x == y else 0.0 for x, y in zip(a, b, strict=True)])
    at = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    out[at] = 200.0 * common_all([a[k] for k in at], [b[k] for k in at]) / size[at]
    return out


def token_sort_all(a: list[str], b: list[str]) -> np.ndarray:
    ordered = {s: " ".join(sorted(s.split())) for s in {*a, *b}}
    return ratio_all([ordered[x] for x in a], [ordered[y] for y in b])


def token_set_all(a: list[str], b: list[str]) -> np.ndarray:
    """The words that both share come first on either side, so the common subsequence is these and that of the rests."""
    words = {s: set(s.split()) for s in {*a, *b}}
    out, at, left, right, known = np.zeros(len(a)), [], [], [], []
    for k, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = words[s], words[t]
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[k] = 100.0
            continue
        at.append(k)
        left.append(" ".join(sorted(x - both)))
        right.append(" ".join(sorted(y - both)))
        known.append(sum(map(len, both)) + len(both) - 1 if both else 0)
    if at:
        shared, start = np.array(known), np.array(known) + (np.array(known) > 0)
        n, m = (start + np.array([len(x) for x in side]) for side in (left, right))
        best = 200.0 * (start + common_all(left, right)) / (n + m)
        for s in (n, m):
            best = np.where(shared > 0, np.maximum(best, 200.0 * shared / (shared + s)), best)
        out[at] = best
    return out


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    out = np.array([1.0 if x and x == y else 0.0 for x, y in zip(a, b, strict=True)])
    differ = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    for k in differ:
        if len(b[k]) > _BITS:
            out[k] = jaro_winkler(a[k], b[k])
    at = np.array(sorted((k for k in differ if len(b[k]) <= _BITS), key=lambda k: -len(a[k])), np.int64)
    if not len(at):
        return out
    x, y, alphabet = _coded([a[k] for k in at], [b[k] for k in at])
    size = lambda n: (_ONE << np.minimum(n, _BITS - 1).astype(np.uint64)) - _ONE
    below = lambda n: np.where(n >= _BITS, _ALL, size(np.maximum(n, 0)))  # noqa: E731  # the first n bits
    for part in _chunks(np.arange(len(at)), alphabet, 1):
        left, right = x[part], y[part]
        na, nb = (left > 0).sum(1), (right > 0).sum(1)
        reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
        table, base = _places(right, alphabet, 1).reshape(-1), np.arange(len(part)) * (alphabet + 1)
        free, matched = np.full(len(part), _ALL), np.zeros(left.shape, bool)
        for i, n in enumerate((left > 0).sum(0)):
            hit = table[base[:n] + left[:n, i]] & free[:n] & below(i + reach[:n] + 1) & ~below(i - reach[:n])
            low = hit & (~hit + _ONE)  # the first of them
            free[:n] ^= low
            matched[:n, i] = low > 0
        used = np.unpackbits((~free & below(nb)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : right.shape[1]].astype(bool)
        m = matched.sum(1)
        moved = np.bincount(np.nonzero(matched)[0], left[matched] != right[used], len(part)).astype(np.int64) // 2
        some = np.maximum(m, 1)
        jaro = (m / na + m / nb + (m - moved) / some) / 3
        start, same = np.zeros(len(part), np.int64), np.ones(len(part), bool)
        for i in range(min(4, left.shape[1], right.shape[1])):
            same = same & (left[:, i] > 0) & (left[:, i] == right[:, i])
            start += same
        out[at[part]] = np.where(m > 0, np.where(jaro > 0.7, jaro + 0.1 * start * (1 - jaro), jaro), 0.0)
    return out


#: The measures of lists of pairs.
OF_ALL = {"ratio": ratio_all, "set": token_set_all, "sort": token_sort_all, "jw": jaro_winkler_all}


def similarities(pairs: dict[str, tuple[Column, Column, str]]) -> Column:
    """A struct with a double for each name: (left, right, measures), where measures are some of MEASURES joined by commas; the field is name_measure. Equal pairs of a batch are measured once."""
    names, columns = [], []
    for name, (a, b, measures) in pairs.items():
        names.append((name, measures.split(",")))
        columns += [a, b]
    fields = [f"{name}_{m}" for name, ms in names for m in ms]

    def compute(*x: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], int] = {}
        at = {name: np.array([known.setdefault((p or "", q or ""), len(known)) for p, q in zip(x[2 * k], x[2 * k + 1], strict=True)], np.int64) for k, (name, _) in enumerate(names)}
        every, out = list(known), {}
        for m in MEASURES:
            those = [name for name, ms in names if m in ms]
            if those:
                which = np.unique(np.concatenate([at[name] for name in those]))
                values = np.zeros(len(every))
                values[which] = OF_ALL[m]([every[k][0] for k in which], [every[k][1] for k in which])
                out |= {f"{name}_{m}": values[at[name]] for name in those}
        return pd.DataFrame(out, columns=fields)

    compute.__annotations__ = {"return": pd.DataFrame}
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(compute, ", ".join(f"{f} double" for f in fields), PandasUDFType.SCALAR)(*columns)
