"""Token ids of whole texts by a public tokenizer, fast enough for a corpus: each distinct word is encoded once a worker."""

from __future__ import annotations

import json
import os

import numpy as np

END_ID = 1
#: Words whose ids a worker keeps (about 150 MB); beyond it the cache starts anew, which costs time only.
CACHE = 600_000
#: Marks that the tokenizer parts from the letters before them and keeps together.
_MARKS = ".,!?;:%&$#*|"
#: How the public tokenizer changes and parts a text. Lower-case words of letters up to U+00FF come through both unchanged and whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_LOADED: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian bytes. The tokenizer drops white space and never merges across it, so that a text's ids are those of its space-separated parts in a row."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = self.bare = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}):
            self.bare = Tokenizer.from_file(path)  # the same merges, without the search for words
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _each(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.asarray(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str], tokenizer) -> None:
        """Words of letters, encoded in one text and parted at the ids that end words; if their number is not that of the words, one by one."""
        if not words:
            return
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            data, at, known = ids.tobytes(), 0, self.known
            for word, cut in zip(words, (4 * cuts).tolist(), strict=True):
                known[word] = data[at:cut]
                at = cut
        else:
            self._each(words)

    def _learn(self, words: set[str]) -> None:
        known, plain, simple, letters, rest = self.known, [], set(), set(), set()
        for w in words:
            start = w.rstrip(_MARKS)
            if not start.isalpha():
                rest.add(w)
                continue
            marks, into = w[len(start) :], simple
            if start.isascii() or max(start) <= "\xff":
                start = start.lower()
            elif start.lower().isalpha():
                into = letters
            else:  # a letter that leaves a mark when lower-cased would join what follows
                rest.add(w)
                continue
            plain.append((w, start, marks))
            if start not in known:
                into.add(start)
            if marks not in known:
                rest.add(marks)
        self._letters(list(simple), self.bare)
        self._letters(list(letters), self.tokenizer)
        if rest:
            self._each(list(rest))
        for word, start, marks in plain:
            known[word] = known[start] + known[marks] if marks else known[start]

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text (null: none) and the end id, 4 bytes each."""
        parts = (text or "").replace("\n", " ").split(" ")
        found = list(map(self.known.get, parts))
        if None in found:
            new = {part for part, there in zip(parts, found) if there is None}
            if len(self.known) + len(new) > CACHE:
                self.known = {"": b""}
                self._learn(set(parts) - {""})
                found = list(map(self.known.__getitem__, parts))
            else:
                self._learn(new)
                found = [self.known[part] if there is None else there for part, there in zip(parts, found)]
        return b"".join(found) + END_ID.to_bytes(4, "little")


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def largest_id(path: str) -> int:
    """The largest id that the tokenizer, or the end of a document, can give."""
    return max(len(encoder(path).ends) - 1, END_ID)
