from __future__ import annotations

import random
import re

import xxhash
from tests.llm.cases import documents, frame

from tidemark.llm import simhash_dedup as m


def plain(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes: list[int], linked) -> dict[int, int]:
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def test_fingerprint():
    for text in [None, "", "A b", "One two three four FIVE É", "x y z  q", "a b c " * 70_000]:
        assert m.simhash(text) % 2**64 == plain(text)


def test_masks_cover_every_pair_within_two():
    masks = m.covering_masks()
    for i in range(64):
        for j in range(i, 64):
            assert any(not (k >> i & 1) and not (k >> j & 1) for k in masks)


def test_links_match_brute_force(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10]:
        at = b
        for _ in range(30):
            fps.add(at := at ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps = {x - 2**64 if x >> 63 else x for x in fps}
    want = roots(sorted(fps), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    for pair_bucket in (1, 8):
        found = m.links(spark.createDataFrame([(x,) for x in fps], "fp long"), pair_bucket)
        assert all(((r.u ^ r.v) % 2**64).bit_count() <= 2 for r in found.collect())
        got = {x: x for x in fps} | {r.node: r.root for r in m.components(found).collect()}
        assert got == want


def test_query_on_odd_rows(spark):
    rows = documents()
    got = m.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = roots(list(range(len(rows))), lambda a, b: (plain(rows[a][1]) ^ plain(rows[b][1])).bit_count() <= 2)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[want[i]] = min(least.get(want[i], r[0]), r[0])
    whole = [(r[0], plain(r[1]), least.get(want[i])) for i, r in enumerate(rows)]
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(whole, key=str)


def test_keep_one_row_of_each_component(spark):
    a, b = "one two three four five", "six seven eight nine ten eleven"
    rows = [(5, a, "p"), (5, b, "q"), (3, a, "r"), (7, b, "s"), (7, b, "s"), (7, b, "t"), (None, a, "u"), (None, "quite another text here", "v"), (9, None, "w"), (8, "", "w")]
    for similarity in (None, 0.8):
        kept = m.keep_one(spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(4), size=3, similarity=similarity)
        assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(3, a, "r"), (5, b, "q"), (None, "quite another text here", "v"), (8, "", "w")], key=str)
    again = spark.createDataFrame([(7, a, "x"), (7, a, "x"), (None, b, "y"), (None, b, "y")], "doc_id long, text string, rest string")
    assert sorted(r.doc_id or 0 for r in m.keep_one(again).collect()) == [0, 7]


def test_keep_one_of_odd_rows_and_empty(spark):
    rows = documents()
    docs = frame(spark, rows)
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    want = roots(list(range(len(rows))), lambda a, b: (plain(rows[a][1]) ^ plain(rows[b][1])).bit_count() <= 2)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(want[i], []).append(r)
    got = kept.collect()
    assert len(got) == len(groups)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(min((r[0] is None, r[0] or 0) for r in g) for g in groups.values())
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
    assert m.near_duplicates(docs.limit(0)).count() == 0 and m.keep_one(docs.limit(0)).count() == 0
