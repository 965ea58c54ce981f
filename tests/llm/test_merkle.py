"""Manifest and proofs against a tree built in one piece."""

import zlib
from hashlib import sha256

import pytest

from cuewise.llm import merkle
from tests.llm import plain

FIELDS = ["doc_id", "source", "lang", "text"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, i):
    """Siblings of place `i` as (before, after), and the root."""
    out = []
    while len(level) > 1:
        run = i // 16 * 16
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        level, i = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)], i // 16
    return out, level[0]


def whole(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r, leaf((r[0], r[3], r[2], r[1]))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subroots = {s: climb([x[1] for x in by[s]], 0)[1] for s in names}
    out = []
    for k, s in enumerate(names):
        leaves = [x[1] for x in by[s]]
        top, root = climb([subroots[x] for x in names], k)
        for i, (r, own) in enumerate(by[s]):
            steps = climb(leaves, i)[0] + top
            x = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = leaf((r[0], s, r[2], None if r[1] is None else plain.low(r[1])))
            for a, b in steps:
                x = h(a + x + b)
            out.append((r[0], own, subroots[s], root, h("".join(a + b for a, b in steps)), x, x == root))
    return sorted(out, key=str)


def made(spark, rows):
    docs = plain.table(spark, rows).selectExpr("*", *[f"'x' AS `{c}`" for c in ("tree", "pos", "leaf", "root", "src", "range", "at", "level", "doc")])
    changed, when = merkle.tampered(docs)
    got = merkle.manifest(docs, FIELDS, changed=changed, when=when)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def upper(rows):
    return [(i, text and text.capitalize(), lang, source) for i, text, lang, source in rows]


def test_edges(spark):
    """Nulls in every column, an empty source beside the null one, repeated ids and rows, a very long text."""
    rows = upper(plain.corpus()) + [(3, "Other text", "en", "src3"), (3, "Other text", "en", "src3"), (None, "A", None, ""), (901, None, None, "lone")]
    got = made(spark, rows)
    assert got == whole(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (4097,), (300, 4096, 1), (1,) * 40])
def test_sizes(spark, sizes):
    """Full and broken runs, partitions beyond the first, one and many sources."""
    rows = [(k * 10_000 + i, f"Text {i}", "en", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    assert made(spark, rows) == whole(rows)


def test_many_sources(spark):
    """More sources than one partition holds, so the tree over them has fetched nodes of its own."""
    rows = [(i, f"T{i}", None, f"s{i:05d}") for i in range(4200)]
    assert made(spark, rows) == whole(rows)


def test_large_levels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 0)
    rows = [(i, f"Text {i}", "en", f"s{i % 2}") for i in range(9000)]
    assert made(spark, rows) == whole(rows)


def test_missing_is_minimal():
    """For any stretch of leaves: what is fetched and what is derived together make the root, and nothing is fetched that could be derived."""
    for size in (1, 2, 15, 16, 17, 40, 257, 600):
        level, tree = [str(i) for i in range(size)], []
        while True:
            tree.append(level)
            if len(level) == 1:
                break
            level = merkle.parents(level)
        for first in range(0, size, 7):
            for end in {first + 1, min(size, first + 5), min(size, first + 40), size}:
                want = merkle.missing(size, first, end)
                assert len(set(want)) == len(want)
                assert all(not first // 16**l <= i <= (end - 1) // 16**l for l, i in want)
                _, root = merkle.climbed(0, size, first, tree[0][first:end], {(0, l, i): tree[l][i] for l, i in want})
                assert root == tree[-1][0]


def test_empty(spark):
    assert made(spark, []) == []
