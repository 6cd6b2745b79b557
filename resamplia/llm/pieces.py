"""Ids of whole texts for a SentencePiece BPE file, and texts of ids, by a table of prefixes.

A sequence of pieces is the encoding of its text exactly if each two neighbours are compatible, that is if
merging their joint text alone gives these two again: up to the first merge across a border, every piece grows as it
does alone, and which merge is next between two neighbours depends on nothing else. So each prefix of a text has
one last piece: the piece that ends there, found by an Aho-Corasick automaton, which is compatible with the last
piece of the prefix before it. The table of last pieces is filled from left to right; the ids are read off it backwards.

No merge joins two characters that stand side by side in no piece, so texts are cut there first, and each distinct
part goes through the table once per worker (some PARTS_KEPT are remembered). Null counts as an empty text, which has no
ids. Any Unicode text is allowed; characters outside the vocabulary become the pieces of their UTF-8 bytes.

Documents are independent: no shuffle, a row is work of one task, any number of equal rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from resamplia.llm.shared import memories
from resamplia.llm.shared import pieces as batches_of

# Distinct parts that one Python worker remembers, the longest of these, and remembered answers about pairs of pieces.
PARTS_KEPT, PART_CHARS, PAIRS_KEPT = 300_000, 64, 500_000

# Fixed values of the file format: the sign for a blank, field numbers, kinds of pieces, and the model type "BPE".
BLANK = "▁"
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BYTE_FALLBACK, BPE = 3, 35, 2
RULE_NAME, DUMMY_PREFIX, REMOVE_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a BPE model with byte fallback and without normalization; other models are a ValueError."""

    def __init__(self, data: bytes):
        import struct

        trainer, normalizer = {}, {}
        self.text: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        for field, value in _fields(data):
            if field == PIECES:
                piece = dict(_fields(value))
                self.text.append(piece.get(TEXT, b"").decode())
                self.kind.append(piece.get(KIND, NORMAL))
                score.append(struct.unpack("<f", piece.get(SCORE, bytes(4)))[0])
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        rules = (normalizer.get(RULE_NAME), normalizer.get(REMOVE_BLANKS, 1), normalizer.get(ESCAPE_BLANKS, 1))
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or rules != (b"identity", 0, 1):
            raise ValueError("a BPE model with byte fallback that neither changes characters nor removes blanks is needed")
        if not set(self.kind) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with unused or user-defined pieces are not supported")
        self.prefix = BLANK if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.score = {t: score[i] for t, i in self.id.items()}
        self.byte = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        #: What may be a symbol before any merge, and so part of a piece.
        self.letters = {c for t in self.id for c in t}


class PieceCoder:
    def __init__(self, data: bytes):
        import ahocorasick

        self.model = model = Vocabulary(data)
        self.merged = lru_cache(None)(self._merged)
        self.automaton = ahocorasick.Automaton()
        for text, number in model.id.items():
            if self._merged(text) == (text,):  # other pieces occur in no encoding
                self.automaton.add_word(text, (number, len(text)))
        for c in model.letters - model.id.keys():  # part of pieces, but none alone
            self.automaton.add_word(c, (-1 - ord(c), 1))
        self.automaton.make_automaton()
        self.parts = re.compile(self._cuts(), re.DOTALL).findall
        self.known: dict[str, tuple[str, str]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _cuts(self) -> str:
        """A pattern for parts that no merge crosses, as far as the vocabulary's neighbours allow."""
        pairs = {p for t in self.model.id for p in zip(t, t[1:], strict=False)}
        word = lambda c: unicodedata.category(c)[0] in "LM"
        some = self.model.letters - {BLANK}
        cls = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        if any(b == BLANK != a for a, b in pairs):
            return f"{cls(self.model.letters)}+|."
        if any(a != BLANK and word(a) != word(b) for a, b in pairs):
            return f"{BLANK}*{cls(some)}+|{BLANK}+|."
        words, signs = {c for c in some if word(c)}, {c for c in some if not word(c)}
        return "|".join([*(f"{BLANK}*{cls(x)}+" for x in (words, signs) if x), f"{BLANK}+", "."])

    def _merged(self, text: str) -> tuple[str, ...]:
        """Repeatedly join the neighbours that make the best piece, the first of equals."""
        parts, score = list(text), self.model.score
        while True:
            best, place = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, place = s, k
            if place < 0:
                return tuple(parts)
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def _string(self, number: int) -> str:
        return self.model.text[number] if number >= 0 else chr(-1 - number)

    def _fit(self, pair: tuple[int, int]) -> bool:
        """May the second piece follow the first?"""
        a, b = map(self._string, pair)
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        self.fits[pair] = answer = self._merged(a + b) == (a, b)
        return answer

    def _prefixes(self, part: str) -> list[tuple[int, int]]:
        """(last piece, its length) of each prefix of a part, by number of characters; the empty one first."""
        last: list[tuple[int, int] | None] = [None] * (len(part) + 1)
        fits = self.fits
        for end, found in self.automaton.iter(part):
            end += 1
            if last[end] is not None:
                continue
            start = end - found[1]
            if start:
                pair = (last[start][0], found[0])
                answer = fits.get(pair)
                if not (self._fit(pair) if answer is None else answer):
                    continue
            last[end] = found
        return last

    def _part_ids(self, part: str) -> list[int]:
        if part[0] not in self.model.letters:
            return [self.model.byte[b] for c in part for b in c.encode()]
        last, at, ids = self._prefixes(part), len(part), []
        while at:
            number, size = last[at]
            if number >= 0:
                ids.append(number)
            else:
                ids.extend(self.model.byte[b] for b in reversed(chr(-1 - number).encode()))
            at -= size
        ids.reverse()
        return ids

    def _text_parts(self, text: str | None) -> list[str]:
        return self.parts(self.model.prefix + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin and end."""
        return [i for part in self._text_parts(text) for i in self._part_ids(part)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: blanks for their sign, but for the prefix; control pieces are empty, bytes that are no UTF-8
        become U+FFFD one by one, the unknown piece is " ⁇ "."""
        return self._decode(ids, self.model.prefix)

    def _decode(self, ids: Sequence[int], prefix: str) -> str:
        kind, text, out, run, first = self.model.kind, self.model.text, [], bytearray(), bool(prefix)

        def close() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            if kind[i] == BYTE:
                run.append(int(text[i][1:-1], 16))
                first = False
                continue
            close()
            if kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif kind[i] == NORMAL:
                piece = text[i]
                out.append((piece.removeprefix(prefix) if first else piece).replace(BLANK, " "))
            else:
                continue
            first = False
        close()
        return "".join(out)

    def _learn(self, part: str) -> tuple[str, str]:
        ids = self._part_ids(part)
        both = ",".join(map(str, ids)), self._decode(ids, "")
        if len(part) <= PART_CHARS:
            self.known[part] = both
        return both

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids with commas, and the text that they decode to. Parts hold whole characters, so their
        texts join to that of all ids; the prefix is the first character."""
        if len(self.known) > PARTS_KEPT:
            self.known.clear()
        known, learn = self.known, self._learn
        both = [known.get(p) or learn(p) for p in self._text_parts(text)]
        if not both:
            return 0, "", ""
        ids = ",".join([x for x, _ in both])
        back = "".join([x for _, x in both])
        return ids.count(",") + 1, ids, back[len(self.model.prefix) :]


_coders: dict[bytes, PieceCoder] = {}
memories.append(_coders.clear)


def coder(data: bytes) -> PieceCoder:
    """One per Python worker and model."""
    key = hashlib.sha256(data).digest()
    if key not in _coders:
        _coders[key] = PieceCoder(data)
    return _coders[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _over(df: DataFrame, model: bytes, column: str, added: StructType, work: Callable[[PieceCoder, object], tuple]) -> DataFrame:
    """The columns of `df` but `column` and those that are added, then these."""
    names = added.fieldNames()
    keep = [f for f in df.schema.fields if f.name not in (column, *names)]
    own = "_value"
    while own in df.columns:
        own += "_"
    kept = df.select(*[df[f"`{f.name}`"] for f in keep], df[f"`{column}`"].alias(own))
    sent = df.sparkSession.sparkContext.broadcast(model)  # half a megabyte
    cut = batches_of if kept.schema[own].dataType == StringType() else lambda batches, _: batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, types = coder(sent.value), to_arrow_schema(added).types
        for batch in cut(batches, own):
            if not batch.num_rows:
                continue
            rows = [work(pieces, x.as_py()) for x in batch.columns[-1]]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *names])

    return kept.mapInArrow(run, StructType([*keep, *added.fields]))


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array of int) in place of the text."""
    added = StructType().add("ids", ArrayType(IntegerType()))
    return _over(docs, model, text, added, lambda own, t: (own.encode(t),))


def decode(coded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """`coded` with `text` in place of the ids; null ids are no ids."""
    return _over(coded, model, ids, StructType().add("text", StringType()), lambda own, x: (own.decode(x or []),))


def digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, ids_sha256 (of the decimal ids with commas) and decoded_sha256 (of the decoded text) in place of the
    text."""

    def work(own: PieceCoder, value: str | None) -> tuple[int, str, str]:
        n, ids, back = own.digest(value)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    added = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return _over(docs, model, text, added, work)


def _utf8(data: bytes) -> str:
    """Whole characters as they are; each other byte is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)
