"""What a worker holds: blocks of lines, filters of keys, and what it gives back when a task ends."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from resamplia.llm import linedup, neardup, postings, shared


def block(lines: list[bytes], bands: int, rows: int) -> pa.Table:
    """A list of lines that all meet in it, in two blocks, each line on its own."""
    keys, codes = linedup.band_keys(lines, 8, bands, rows)
    keys[:, 0], codes[:] = 7, 1
    n, ids = len(lines), [linedup.line_id(x) for x in lines]
    return pa.table({"key": pa.array([7] * n, pa.int64()), "rid": ids, "component": ids, "own": [i % 2 for i in range(n)], "a": [0] * n, "b": [1] * n, "words": lines,
                     "keys": linedup._lists(keys.view(np.int64).ravel(), bands), "codes": linedup._rows_of(codes)})


def test_two_full_blocks_are_compared_in_little_memory():
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghij klmnop", np.uint8)
    near = b"the line that all blocks have in common, but for its end: "
    lines = [bytes(rng.choice(letters, 60)) for _ in range(2000)] + [near + b"%02d" % k for k in range(48)]
    table = block(lines, 9, 4)
    compare = linedup._compare(8, 0.8, 1, 9)
    tracemalloc.start()
    out = compare(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    # Links unite the lines that are alike, and no others.
    alike = {linedup.line_id(x) for x in lines[2000:]}
    assert out.num_rows == 47
    assert {*out.column("u").to_pylist(), *out.column("v").to_pylist()} == alike


def test_the_filter_of_keys_is_one_of_bits(spark):
    own = [0, 5, 63, 64, -1, 1 << 40, (1 << 24) - 1]
    bits = postings.key_filter(spark.createDataFrame([(k,) for k in own], "key long"))
    assert bits.nbytes == postings.FILTER_BITS // 8
    keys = np.array([*own, 1, 62, 65, 127, 1 << 23], np.int64).view(np.uint64)
    assert postings.may_be_key(bits, keys).tolist() == [True] * len(own) + [False] * 5


def test_a_task_gives_back_what_is_free(monkeypatch):
    given = []
    monkeypatch.setattr(shared, "release", lambda: given.append(1))

    def run(batches):
        for batch in batches:
            yield batch

    batch = pa.record_batch({"x": [1]})
    task = shared.released(run)(iter([batch, batch]))
    assert next(task) == batch and not given
    assert list(task) == [batch] and given == [1]
    shared.forget()
    assert given == [1, 1]


def test_pieces_of_hashed_texts_do_not_change_signatures():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 500, 90_000))) for _ in range(5)] + ["one", "", None]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    sizes = [b.num_rows for b in shared.pieces(iter([batch]), "text", shared.HASHED_BYTES)]
    assert sum(sizes) == len(texts) and max(sizes) <= 4
    rows = [r for b in neardup._scan(3, 48, 208)(iter([batch])) for r in b.to_pylist()]
    alone = [r for k in range(len(texts)) for b in neardup._scan(3, 48, 208)(iter([batch.slice(k, 1)])) for r in b.to_pylist()]
    assert rows == alone
