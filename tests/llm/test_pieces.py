"""Piece ids and decoded texts against the sentencepiece library, and against plain merging."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from resamplia.llm import pieces, queries
from resamplia.llm.shared import table

ODD = [
    "", " ", "  a  b ", "a▁b", "▁", "▁▁a", "ﬁx ①", "a\x00b", "　x\xa0y", "é", "\t\n a", "<s> </s> <unk> <0x41>", "x�y", "​",
    "日本語テキスト。", "हिन्दी", "👩‍👩‍👧", "'''....!!!///", "l'eau qu'il 12345 3.14", "a" * 3000, "ab" * 2000, " " * 700, "ß" + "\r\n" * 40,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def own():
    return pieces.PieceCoder(pieces.read_model(queries.PIECES))


def check(own, library, text):
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)
    assert own.digest(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_odd_texts(own, library):
    for text in ODD:
        check(own, library, text)
    assert own.encode(None) == [] and own.digest(None) == (0, "", "")


def test_random_texts_and_ids(own, library):
    rng = random.Random(3)
    signs = sorted(own.model.letters) + list(" ▁\n\té한글") * 50 + list("abcdefghijklmnopqrstuvwxyz .,") * 100
    for _ in range(2000):
        check(own, library, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60))))
        ids = [rng.randrange(len(own.model.text)) for _ in range(rng.randint(0, 8))] + [rng.randrange(260) for _ in range(rng.randint(0, 6))]
        rng.shuffle(ids)
        assert own.decode(ids) == library.decode(ids)


def test_the_cache_may_run_full(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "PARTS_KEPT", 5)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 5)
    for text in ["one two three four five six seven", "eight, nine. ten! eleven? twelve", "one two three"]:
        check(own, library, text)


def test_each_prefix_ends_with_the_last_piece_of_its_own_encoding(own):
    for text in ["▁interoperability", "▁thererationing", "unbelievablely"]:
        last = own._prefixes(text)
        for n in range(1, len(text) + 1):
            assert own.model.text[last[n][0]] == own._merged(text[:n])[-1]


def test_parts_are_no_coarser_than_needed(own, library):
    """Without any cut the table gives the same ids."""
    for text in ["▁two▁words", "▁3.14▁it's▁(so)"]:
        whole = own._part_ids(text)
        assert whole == [i for p in own.parts(text) for i in own._part_ids(p)] == library.encode(text[1:].replace("▁", " "))


def _message(*fields) -> bytes:
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) if number < 16 else bytes([(number << 3) & 127 | 128, number >> 4])
            out += bytes([value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def model(pieces_of, normal=b"identity"):
    import struct

    rows = [(t, s, k) for t, s, k in [("<unk>", 0, 2), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], *pieces_of]]
    body = b"".join(_message((1, _message((1, t.encode())) + b"\x15" + struct.pack("<f", s) + _message((3, k)))) for t, s, k in rows)
    return body + _message((2, _message((3, 2), (35, 1)))) + _message((3, _message((1, normal), (3, 0), (4, 0), (5, 1))))


def test_other_vocabularies():
    """Pieces over several words, pieces of characters that are no piece, pieces that no merge reaches."""
    own = pieces.PieceCoder(model([("a", -9, 1), ("b", -9, 1), ("▁", -9, 1), ("a▁", -1, 1), ("a▁b", -2, 1), ("ac", -3, 1), ("bab", -4, 1)]))
    text = lambda ids: [own.model.text[i] for i in ids]
    assert text(own.encode("a b")) == ["a▁b"]
    assert text(own.encode("ba b")) == ["b", "a▁b"]
    assert text(own.encode("acc")) == ["ac", "<0x63>"]
    assert text(own.encode("bab")) == ["b", "a", "b"]
    assert own.decode(own.encode("acc é")) == "acc é"
    with pytest.raises(ValueError):
        pieces.PieceCoder(model([], normal=b"nmt_nfkc"))
    with pytest.raises(ValueError):
        pieces.PieceCoder(model([("x", 0, 4)]))


def test_query_equals_the_library(spark, folder, library):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_sentencepiece(spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in docs:
        ids = library.encode(text or "")
        assert got[doc] == (doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_nulls_clashing_columns_and_empty_tables(spark, library):
    rows = [(1, None), (None, "x y"), (None, "x y"), (3, ""), *[(10 + i, t) for i, t in enumerate(ODD)]]
    data = pieces.read_model(queries.PIECES)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("n"), "_value": F.lit(2.5), "a b": F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1)))})
    coded = pieces.encode(docs, data)
    assert coded.columns == ["doc_id", "n_tokens", "_value", "a b", "ids"]
    want = sorted(((d, library.encode(t or "")) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=repr) == want
    back = pieces.decode(coded, data)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((d, library.decode(library.encode(t or ""))) for d, t in rows), key=repr)
    assert pieces.digests(docs, data).columns == ["doc_id", "ids", "_value", "a b", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert pieces.digests(docs.limit(0), data).count() == 0 and pieces.encode(docs.limit(0), data).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), data).collect()[0]["text"] == ""
