"""Manifests against a plain recursive tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from resamplia.llm import merkle, queries
from resamplia.llm.shared import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels


def path(levels, k):
    out = []
    for now in levels[:-1]:
        out.append((now[k ^ 1], k ^ 1 > k) if k ^ 1 < len(now) else None)
        k //= 2
    return out


def fold(x, steps):
    for s in steps:
        x = h(x) if s is None else h(x, s[0]) if s[1] else h(s[0], x)
    return x


def plain(rows, by=2):
    """As the contract puts it; rows are tuples of FIELDS."""
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else 0 if v is None else v)
    groups = {}
    for r in rows:
        groups.setdefault(r[by], []).append(r)
    names = sorted(groups, key=null_first)
    trees = {g: levels_of(leaf(r) for r in sorted(groups[g], key=lambda r: (null_first(r[0]), leaf(r)))) for g in names}
    tops = levels_of(trees[g][-1][0] for g in names)
    root = tops[-1][0] if tops[-1] else None
    out = []
    for n, g in enumerate(names):
        for k, r in enumerate(sorted(groups[g], key=lambda r: (null_first(r[0]), leaf(r)))):
            steps = path(trees[g], k) + path(tops, n)
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            claim = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            end = fold(claim, steps)
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*(s[0] for s in steps if s)), end, end == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def got(docs, levels=merkle.LEVELS):
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    out = merkle.Manifest(docs, "lang", "doc_id", FIELDS, F.when(queries.remainder(7) == 0, merkle.digest(changed)), levels).verified()
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_query_equals_plain_trees(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select(*FIELDS).collect()]
    out = sorted(map(tuple, queries.op11_manifest(spark, folder).collect()), key=repr)
    assert out == plain(rows)
    tampered = {d for d, *_ in out if zlib.crc32(str(d).encode()) % 7 == 0}
    assert {r[0] for r in out if not r[-1]} == tampered


def some_rows(n, langs):
    rng = random.Random(n)
    rows = [(rng.randrange(3 * n), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5, 9]), rng.choice([None, "", "é☃", "x" * 9])) for _ in range(n)]
    return rows + rows[: n // 4] + [(None, None, "de", None, None), (None, None, "de", 1, "null key"), (-5, "", "", 0, ""), (7, "s", "Ω", 2, "t" * 300_000)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_many_tiers_nulls_ties_and_long_texts(spark, levels):
    rows = some_rows(60, ["de"] * 6 + ["a", "ab", "é", "\U0001f600", "￿", None])
    docs = frame(spark, rows).withColumns({c: F.lit(k) for k, c in enumerate(["tree", "key", "digest", "rank", "leaves", "block", "_row"])})
    assert got(docs.repartition(3), levels) == plain(rows)


def test_one_row_one_tree_and_none(spark):
    one = [(3, None, None, 4, "x")]
    assert got(frame(spark, one)) == plain(one)
    assert got(frame(spark, one).limit(0)) == []
    assert merkle.Manifest(frame(spark, []), "lang", "doc_id", FIELDS).root() is None
    every = [(k, None, str(k), 4, "x") for k in range(9)]
    assert got(frame(spark, every), 2) == plain(every)


def test_equal_rows_only(spark):
    rows = [(1, "s", "de", 1, "same")] * 37
    assert got(frame(spark, rows).repartition(5), 2) == plain(rows)


def test_log_is_postorder_and_positions_are_closed_form(spark):
    rows = some_rows(40, ["de"] * 9 + ["fr"])
    docs = frame(spark, rows)
    manifest = merkle.Manifest(docs, "lang", "doc_id", FIELDS, levels=2)
    log = {}
    for r in manifest.forest.log().collect():
        assert (r["tree"], r["place"]) not in log
        log[r["tree"], r["place"]] = r["node"]
    null_first = lambda v: (v is not None, v or 0)
    for lang in {r[2] for r in rows}:
        leaves = [leaf(r) for r in sorted((r for r in rows if r[2] == lang), key=lambda r: (null_first(r[0]), leaf(r)))]
        levels, order = levels_of(leaves), []

        def visit(level, k, levels=levels, order=order):
            if level:
                for child in (2 * k, 2 * k + 1):
                    if child < len(levels[level - 1]):
                        visit(level - 1, child)
            order.append(levels[level][k])
            assert merkle.position(level, k, len(levels[0]), len(levels) - 1) == len(order) - 1

        visit(len(levels) - 1, 0)
        assert [log[lang, k] for k in range(len(order))] == order
        assert (lang, len(order)) not in log


def test_a_changed_leaf_or_sibling_does_not_verify():
    levels = levels_of([h(str(k)) for k in range(11)])
    for k in range(11):
        steps = path(levels, k)
        siblings, sides = [s[0].encode() for s in steps if s], [0 if s is None else 1 if s[1] else -1 for s in steps]
        root = levels[-1][0].encode()
        assert merkle.folded(h(str(k)).encode(), siblings, sides) == root
        assert merkle.folded(h("other").encode(), siblings, sides) != root
        for n in range(len(siblings)):
            assert merkle.folded(h(str(k)).encode(), [*siblings[:n], h("x").encode(), *siblings[n + 1 :]], sides) != root


def test_partitions_do_not_matter(spark):
    rows = some_rows(30, ["de", "fr"])
    docs = frame(spark, rows)
    assert got(docs.repartition(1), 2) == got(docs.repartition(7), 3)
