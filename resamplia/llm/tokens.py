"""Token ids of whole texts with a `tokenizers` file, each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

from resamplia.llm.shared import memories

# Distinct words that one Python worker remembers; beyond that it starts anew.
WORDS_KEPT = 400_000


class Lists:
    """Numbered lists of unsigned ids in one growing array."""

    def __init__(self):
        self.ids, self.begin, self.size = np.empty(1024, np.uint32), np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.used = self.count = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.used + len(flat), self.count + len(sizes)
        self.ids, self.begin, self.size = self._room(self.ids, n), self._room(self.begin, k), self._room(self.size, k)
        self.ids[self.used : n] = flat
        self.size[self.count : k] = sizes
        self.begin[self.count : k] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = n, k

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and their sizes."""
        size = self.size[numbers]
        total = np.cumsum(size)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.begin[numbers] - (total - size), size)
        return self.ids[at], size


# Fixed values of the word tokenizers that have the quick way below.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Below this code point texts are in normal form and lower case does not depend on context.
_SIMPLE = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_SIMPLE) if unicodedata.category(chr(i))[0] == kind)


_LETTERS, _DIGITS = _class("L"), _class("N")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
# Not simple, or counted as white space by only one of the two libraries.
_OTHER = re.compile(rf"[^\x00-{chr(_SIMPLE - 1)}]|[\x1c-\x1f\u0130]")


class _Numbers(dict):
    """Numbers strings in the order in which they are asked for, and lists the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number


class WordEncoder:
    """Ids of texts. With the pre-tokenizer named above, the ids of a text are those of its
    parts (words, digits, runs of signs), and each distinct part goes through the model once. Texts with unusual
    characters or strings of added tokens, and other tokenizers, are encoded as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.quick = normal == NORMALIZERS and splits == [PATTERN, None]
        # Added tokens are found in the text as it is or, if they are normalized ones, in its normal form.
        added = {y for x in form["added_tokens"] for y in (x["content"], x["content"].lower()) if y}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.clear()

    def _plain(self, text: str, lower: str) -> bool:
        """Must the text be encoded as it is?"""
        if not self.quick or _OTHER.search(text) or _OTHER.search(lower):
            return True
        return self.added is not None and bool(self.added.search(text) or self.added.search(lower))

    def clear(self) -> None:
        self.numbers, self.lists = _Numbers(), Lists()

    def _learn(self) -> None:
        fresh, model = self.numbers.fresh, self.tokenizer.model
        # The byte alphabet of the pre-tokenizer, as it writes single bytes.
        ids = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_byte_alphabet()))] for w in fresh]
        self.lists.add(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))
        self.numbers.fresh = []

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null is empty."""
        if len(self.numbers) > WORDS_KEPT:
            self.clear()
        at: list[np.ndarray | None] = []
        for x in texts:
            lower = (x or "").lower()
            if self._plain(x or "", lower):
                at.append(None)
                continue
            parts = _PARTS.findall(lower)
            at.append(np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts)))
        if self.numbers.fresh:
            self._learn()
        return [
            np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, np.uint32) if n is None else self.lists.take(n)[0]
            for x, n in zip(texts, at, strict=True)
        ]


@cache
def _byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_encoders: dict[str, WordEncoder] = {}
memories.append(_encoders.clear)


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
