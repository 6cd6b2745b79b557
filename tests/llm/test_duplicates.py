"""Near-duplicate documents, lines and components against plain Python."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resamplia.llm import linedup, neardup, queries
from resamplia.llm.components import components
from resamplia.llm.shared import table

LOWER = {c: c + 32 for c in range(65, 91)}


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.root(a)] = self.root(b)


def similar_sets(sets, percent):
    """Union-find over the given distinct sets, by an exact prefix join."""
    counts = collections.Counter(x for s in sets for x in s)
    union, index = Union(len(sets)), collections.defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        prefix = sorted(s, key=lambda x: (counts[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in prefix for j in index[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                union.join(i, j)
        for x in prefix:
            index[x].append(i)
    return union


def plain_duplicates(docs, n=3, percent=85):
    word, sets = re.compile("[^\x20\x09-\x0d]+"), []
    for _, text in docs:
        w = word.findall((text or "").translate(LOWER))
        sets.append(frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([" ".join(w)] if w else []))
    distinct = list(dict.fromkeys(s for s in sets if s))
    number, union = {s: i for i, s in enumerate(distinct)}, similar_sets(distinct, percent)
    least = {}
    for (doc, _), s in zip(docs, sets, strict=True):
        if s and doc is not None:
            c = union.root(number[s])
            least[c] = min(least.get(c, doc), doc)
    out = []
    for (doc, _), s in zip(docs, sets, strict=True):
        component = least.get(union.root(number[s])) if s else doc
        out.append((doc, len(s), component, component == doc))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_equal_plain_python(spark, sf):
    where = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in table(spark, where, "documents").select("doc_id", "text").collect()]
    got = queries.op3_near_duplicates(spark, where)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert order(got.collect()) == order(plain_duplicates(docs))


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_a_large_group_of_near_copies(spark):
    """Copies with up to 9 changed words: some are linked with the original, some with a copy only, most with nothing."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(1000 + i, edited(rng, words, rng.randrange(1, 10))) for i in range(700)]
    base = edited(rng, words, 9).split()
    docs += [(5000 + i, edited(rng, base, rng.randrange(0, 3))) for i in range(60)]
    docs += [(3, " ".join(words)), (9000, " ".join(words)), (9001, " ".join(words).upper())]
    chain = [f"c{k}" for k in range(100)]
    for i in range(40):
        chain = edited(rng, chain, 2).split()
        docs.append((7000 + i, " ".join(chain)))
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert order(neardup.near_duplicates(frame).collect()) == order(plain_duplicates(docs))
    got = neardup.near_duplicates(frame, shingle=5, percent=80)
    assert order(got.collect()) == order(plain_duplicates(docs, 5, 80))


def test_near_duplicates_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, " \t"), (None, "one two three"), (5, "One TWO three"), (4, "two words"), (9, "two\nwords"), (6, "x"), (6, "x"), (7, "y " * 200000), (8, "y " * 100000), (None, "nothing like it"), (3, "one two three")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("u", F.lit(1))
    got = order(neardup.near_duplicates(frame).collect())
    expected = [(d, n, c, True if d is None and c is None else (None if d is None else k)) for d, n, c, k in plain_duplicates(docs)]
    assert [r[:3] for r in got] == [r[:3] for r in order(expected)]
    assert {(r[0], r[2]): r[3] for r in got}[(None, 3)] is False and {(r[0], r[2]): r[3] for r in got}[(None, None)] is True
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_least_matches():
    assert neardup.least_matches(48, 85) == 30 and neardup.least_matches(128, 85) == 92


def test_shingle_sets_of_any_kind():
    """Sets of numbers and of texts agree on what is alike."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for letters in ["ab ", "aé ", "ab字", "ßÿab"] for _ in range(40)]
    texts += [t + "x" for t in texts[:80]] + ["", "a" * 7, "a" * 8, "a" * 9]
    lines = [t.encode() for t in texts if t]
    sets = linedup.Sets(lines, 8)
    for i in range(len(lines)):
        for j in rng.sample(range(len(lines)), 30):
            want = linedup.alike(linedup.shingle_set(lines[i], 8), linedup.shingle_set(lines[j], 8), 0.8)
            assert linedup.alike(*sets.pair(i, j), 0.8) == want == linedup.alike(*sets.pair(i, j, keep=False), 0.8)
    assert linedup.Sets([], 8).known == {} and linedup.alike(*linedup.Sets([b"abcd", b"abcd"], 3).pair(0, 1), 0.8)


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_groups_compared_together_or_alone(size, monkeypatch):
    """The links of a list are the same whether it is compared with others or alone, in batches cut anywhere."""
    import pyarrow as pa

    monkeypatch.setattr(linedup, "AT_ONCE", size)
    rng = random.Random(1)
    base = ["the quick brown fox jumps over it", "pack my box with five dozen jugs", "sphinx of black quartz judge my vow"]
    base = [" ".join(b + str(k) for k in range(4)) for b in base]
    lines = [x.encode() for x in dict.fromkeys(b[:k] + rng.choice("abc") + b[k + rng.randint(0, 1) :] for b in base for k in range(6, 60, 2))]
    keys, codes = linedup.band_keys(lines, 8, 9, 4)
    rows = []
    for key in sorted(set(keys.ravel().tolist())):
        members = [i for i in range(len(lines)) if key in keys[i]]
        if len(members) > 1:
            rows += [(np.uint64(key).view(np.int64).item(), 0, 0, i) for i in members]
    names = {i: linedup.line_id(x) for i, x in enumerate(lines)}
    table = pa.table({
        "key": [r[0] for r in rows], "a": pa.array([0] * len(rows), pa.int32()), "b": pa.array([0] * len(rows), pa.int32()), "own": pa.array([0] * len(rows), pa.int32()),
        "rid": [names[r[3]] for r in rows], "component": [names[r[3]] for r in rows], "keys": pa.array([keys[r[3]].view(np.int64) for r in rows]),
        "codes": [codes[r[3]].tobytes() for r in rows], "words": [lines[r[3]] for r in rows],
    })
    run = linedup._sets_at_once(8, 0.8, linedup.least_matches(36, 0.8), 9)
    found = set()
    for step in (1, 7, 10_000):
        union = Union(len(lines))
        back = {n: i for i, n in names.items()}
        for batch in run(iter(table.to_batches(step))):
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                assert linedup.alike(linedup.shingle_set(lines[back[u]], 8), linedup.shingle_set(lines[back[v]], 8), 0.8)
                union.join(back[u], back[v])
        found.add(tuple(union.root(i) == union.root(j) for i in range(len(lines)) for j in range(i)))
    assert len(found) == 1 and any(next(iter(found)))


@pytest.mark.parametrize("most", [4, 500_000])
def test_components_in_several_steps(spark, most):
    """Paths, stars and cycles whose links are united a few at a time."""
    rng = random.Random(most)
    links = [(k, k + 1) for k in range(150)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2000 + (k + 1) % 40) for k in range(40)] + [(1100, 150)]
    rng.shuffle(links)
    union = Union(3000)
    for a, b in links:
        union.join(a, b)
    least = {}
    for k in range(3000):
        least[union.root(k)] = min(k, least.get(union.root(k), k))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if most == 4 else before)
    try:
        got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long").repartition(6), most).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(k, least[union.root(k)]) for k in {x for link in links for x in link}}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    union = Union(3000)
    for a, b in links:
        union.join(a, b)
    least = {}
    for k in range(3000):
        least[union.root(k)] = min(k, least.get(union.root(k), k))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame([*links, (None, 7)], "u long, v long")
    assert {tuple(r) for r in components(frame).collect()} == {(k, least[union.root(k)]) for k in nodes}
    assert components(frame.limit(0)).count() == 0


def plain_lines(docs, n=8, percent=80):
    """Lines that go, by (doc_id, text)."""
    places = collections.defaultdict(list)
    for doc, text in docs:
        for k, raw in enumerate((text or "").split("\n")):
            line = b" ".join(raw.encode().split()).decode().translate(LOWER)
            if line:
                places[line].append(((doc is None, doc or 0, linedup.doc_key(doc, text.encode()), k), (doc, text, k)))
    lines = list(places)
    sets = [frozenset(x[i : i + n] for i in range(max(1, len(x) - n + 1))) for x in lines]
    union = similar_sets(sets, percent)
    groups = collections.defaultdict(list)
    for i, line in enumerate(lines):
        groups[union.root(i)] += places[line]
    gone = set()
    for group in groups.values():
        stays = min(p for p, _ in group)
        gone |= {where for p, where in group if p != stays}
    return gone


def check_lines(frame, docs, missing=0.0):
    gone = plain_lines(docs)
    expected, got = {}, {}
    for doc, text in docs:
        expected[doc, text] = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (doc, text, k) not in gone)
    for r in linedup.dedup_lines(frame.withColumn("_own", F.col("text"))).collect():
        got[r["doc_id"], r["_own"]] = r["text"]
        assert r["n_removed"] == len((r["_own"] or "").split("\n")) - len((r["text"] or "").split("\n")) or not r["text"]
    assert got.keys() == expected.keys()
    wrong = sum(got[k] != expected[k] for k in got)
    assert wrong <= missing * len(docs), (wrong, len(docs))
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_line_dedup_equals_plain_python(spark, sf):
    frame = table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text")
    check_lines(frame, [tuple(r) for r in frame.collect()], missing=0.01)


def test_many_lines_that_are_alike(spark):
    rng = random.Random(1)
    base = [f"word{rng.randrange(10**5)}" for _ in range(40)]
    docs = [(i, edited(rng, base, rng.randrange(0, 6)) + "\ncommon line\n" + f"own {rng.random()} {rng.random()} {rng.random()}") for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = check_lines(frame, docs, missing=0.01)
    assert sum("common line" in x for x in got.values()) == 1


def test_lines_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (5, "A  line\n\na LINE\nb"), (4, "a line"), (4, "a line\nother"), (None, "b\nnobody else's line"), (7, "é" * 200000 + "\nx"), (8, "é" * 200000), (9, "x\r"), (6, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = check_lines(frame, docs)
    assert got[5, "A  line\n\na LINE\nb"] == "\nb" and got[4, "a line\nother"] in ("other", "a line\nother") and got[6, "x"] == "x"
    wide = frame.withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("words", F.lit(1))
    out = linedup.dedup_lines(wide)
    assert out.columns == ["doc_id", "text", "line", "doc", "words", "n_lines", "n_removed"] and out.count() == len(docs)
    twice = linedup.dedup_lines(frame.unionByName(frame))
    assert order(twice.distinct().collect()) == order(linedup.dedup_lines(frame).distinct().collect()) and twice.count() == 2 * len(docs)
    assert linedup.dedup_lines(frame.limit(0)).count() == 0


def test_shingle_hashes_are_those_of_single_lines():
    rng = random.Random(2)
    lines = ["".join(rng.choice("abé😀 ") for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    together, begin = linedup.shingle_hashes([x.encode() for x in lines], 8)
    for line, a, b in zip(lines, begin, [*begin[1:], len(together)], strict=True):
        alone, _ = linedup.shingle_hashes([line.encode()], 8)
        assert (together[a:b] == alone).all()
        distinct = {line[i : i + 8] for i in range(max(1, len(line) - 7))}
        assert len(set(alone.tolist())) == len(distinct)


def test_scanned_lines_are_narrow():
    """A line goes to its group as four values of 16, 72, 29 and 8 bytes; its minima are made again where lines are compared."""
    import pyarrow as pa

    docs = [(3, "one line here\nand another line"), (None, "ONE  line here"), (-2, "one line here\none line here")]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    (out,) = linedup._scan(8, 9, 4)(iter([batch]))
    assert out.schema.names == ["rid", "keys", "first", "copies"]
    rows = {r["rid"]: r for r in out.to_pylist()}
    lines = [b"one line here", b"and another line"]
    assert set(rows) == {linedup.line_id(x) for x in lines} and all((len(r["rid"]), len(r["keys"]), len(r["first"])) == (16, 72, 29) for r in rows.values())
    assert [rows[linedup.line_id(x)]["copies"] for x in lines] == [4, 1]
    assert rows[linedup.line_id(lines[0])]["first"] == linedup.place_key(-2, linedup.doc_key(-2, docs[2][1].encode()), 0)
    keys, codes = linedup.band_keys(lines, 8, 9, 4)
    again = pa.RecordBatch.from_arrays([pa.array([linedup.line_id(x) for x in lines]), pa.array(lines)], ["rid", "words"])
    (made,) = linedup._bands(8, 9, 4)(iter([again]))
    assert [r["codes"] for r in made.to_pylist()] == [x.tobytes() for x in codes] and [r["keys"] for r in made.to_pylist()] == keys.view(np.int64).tolist()
    assert [rows[linedup.line_id(x)]["keys"] for x in lines] == [k.tobytes() for k in keys]


def test_places_stay_in_order_as_bytes():
    rng = random.Random(5)
    ids = [None, 0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**40), 2**40) for _ in range(40))]
    places = [(d, rng.randbytes(16), rng.randrange(10**6)) for d in ids for _ in range(4)]
    assert sorted(places, key=lambda p: (p[0] is None, p[0] or 0, *p[1:])) == sorted(places, key=lambda p: linedup.place_key(*p))


def test_sets_of_numbers_are_sorted_arrays():
    """Compared by one sort of both, without sets of Python's integers."""
    lines = [b"a line that repeats, a line that repeats, a line", b"a line that repeats, a line that repeats, a lime", "dünn und dünner".encode(), "ein ş hier drin".encode()]
    sets = linedup.Sets(lines, 8)
    for i, j in ((0, 1), (0, 2), (2, 2), (3, 3), (0, 3)):
        x, y = sets.pair(i, j)
        assert isinstance(x, set) == (3 in (i, j)) and len(x) == len(linedup.shingle_set(lines[i], 8)) and len(y) == len(linedup.shingle_set(lines[j], 8))
        for percent in (0.5, 0.8, 0.9, 0.99):
            assert linedup.alike(x, y, percent) == linedup.alike(linedup.shingle_set(lines[i], 8), linedup.shingle_set(lines[j], 8), percent)


def test_lines_are_dealt_in_packed_rows(monkeypatch):
    """A task sends a row per group, not one per line; merged, each distinct line has its keys, first place and count."""
    import pyarrow as pa

    rng = random.Random(7)
    docs = [(rng.choice([None, 5, -3, 2**40, i]), "\n".join(rng.choice(["common", f"line {rng.randrange(60)}", f"çé {rng.random()}", ""]) for _ in range(rng.randrange(6)))) for i in range(90)]
    tables = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs[k : k + 10]], pa.int64()), pa.array([t for _, t in docs[k : k + 10]])], ["doc_id", "text"]) for k in range(0, 90, 10)]
    plain: dict[bytes, list] = {}
    for table in tables:
        for doc_id, doc, k, line in linedup._lines(table):
            plain.setdefault(line, []).append(linedup.place_key(doc_id, doc, k))
    scan = linedup._scan(8, 9, 4)
    (dealt,) = linedup._deal(scan, 5, 9)(iter(tables))
    assert sorted(dealt.column("g").to_pylist()) == list(range(5)) and sum(b.num_rows for b in scan(iter(tables))) > len(plain) > 100
    monkeypatch.setattr(linedup, "HELD", 1)
    parts = list(linedup._deal(scan, 5, 9)(iter(tables)))
    assert len(parts) == 9
    monkeypatch.setattr(linedup, "TOGETHER", 7)
    found = {}
    for g in range(5):
        of = pa.Table.from_batches([p.filter(pa.array([x == g for x in p.column("g").to_pylist()])) for p in parts]).drop_columns(["g"])
        merged = linedup._merge(9)(of)
        values = [linedup._unpacked(merged.column(c), width) for c, width in (("rid", 16), ("keys", 72), ("first", 29), ("copies", 8))]
        assert merged.num_rows == -(-len(values[0]) // 7)
        for rid, keys, first, copies in zip(*values, strict=True):
            assert rid.tobytes() not in found
            found[rid.tobytes()] = keys.tobytes(), first.tobytes(), int(copies.view(np.int64)[0])
        again = linedup._occurrences()(iter(merged.to_batches()))
        assert {r["rid"] for b in again for r in b.to_pylist()} == {x.tobytes() for x, n in zip(values[0], values[3].view(np.int64).ravel(), strict=True) if n > 1}
    keys, _ = linedup.band_keys(list(plain), 8, 9, 4)
    assert found == {linedup.line_id(x): (k.tobytes(), min(p), len(p)) for (x, p), k in zip(plain.items(), keys, strict=True)}


def test_bands_do_not_depend_on_how_many_lines_are_hashed_at_once(monkeypatch):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abé😀 \0"[: rng.choice([2, 6])]) for _ in range(rng.randrange(1, 60))).encode() for _ in range(80)]
    whole = linedup.band_keys(lines, 8, 9, 4)
    for cached in (1, 100, 700):
        monkeypatch.setattr(linedup, "CACHED", cached)
        for x, y in zip(whole, linedup.band_keys(lines, 8, 9, 4), strict=True):
            assert x.dtype == y.dtype and (x == y).all()


def test_only_listed_lines_send_their_text():
    """Lines that merely occur again need their places, not their text."""
    from types import SimpleNamespace

    import pyarrow as pa

    from resamplia.llm import postings

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["listed\nagain\nother", "again\nlisted"])], ["doc_id", "text"])
    slots = {x: int.from_bytes(linedup.line_id(x)[:8], "little") % postings.FILTER_BITS for x in (b"listed", b"again", b"other")}
    listed, either = (np.zeros(postings.FILTER_BITS // 8, np.uint8) for _ in range(2))
    for name, bits in ((b"listed", listed), (b"listed", either), (b"again", either)):
        bits[slots[name] >> 3] |= 1 << (slots[name] & 7)
    (out,) = linedup._chosen(SimpleNamespace(value=(listed, either)))(iter([batch]))
    got = [(r["rid"], r["line"], r["words"]) for r in out.to_pylist()]
    assert got == [(linedup.line_id(x), k, w) for x, k, w in ((b"listed", 0, b"listed"), (b"again", 1, None), (b"again", 0, None), (b"listed", 1, None))]
