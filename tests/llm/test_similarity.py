from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
from tests.llm.cases import documents, frame
from tests.llm.test_simhash import roots

from tidemark.llm import simhash_dedup as m


def grams(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a: str | None, b: str | None) -> bool:
    x, y = grams(a), grams(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def planted() -> list[tuple]:
    """Odd rows, and texts with one to twelve words changed, a shared passage at each end."""
    draw = random.Random(5)
    rows = documents()
    for group in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([30, 120, 400]))] + "the same passage stands at the end of each of these texts".split()
        for copy in range(6):
            changed = list(words)
            for _ in range(copy * draw.choice([1, 2])):
                changed[draw.randrange(len(changed))] = f"x{draw.randrange(4000)}"
            rows.append((1000 + 10 * group + copy, " ".join(changed), *rows[0][2:]))
    return rows


def test_stage_removes_all_near_copies(spark):
    rows = planted()
    near = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[1] != b[1] and alike(a[1], b[1])]
    assert sum(((m.simhash(a[1], 5) ^ m.simhash(b[1], 5)) % 2**64).bit_count() > 2 for a, b in near) > 20
    root = roots(list(range(len(rows))), lambda a, b: alike(rows[a][1], rows[b][1]))
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    got = m.near_duplicates(frame(spark, rows), size=5, similarity=0.8).collect()
    want = [(r[0], m.simhash(r[1], 5), least.get(root[i])) for i, r in enumerate(rows)]
    assert sorted(((r.id, r.fp, r.component_id) for r in got), key=str) == sorted(want, key=str)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()]
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i], []).append(r)
    assert set(kept) <= set(rows) and len(kept) == len(groups)
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(min((r[0] is None, r[0] or 0) for r in g) for g in groups.values())


def test_prefixes_of_similar_sets_meet():
    draw, least = random.Random(6), Fraction("0.8")
    common = np.arange(0, 90, 2, dtype=np.uint64)
    rank = np.array(draw.sample(range(45), 45))
    for _ in range(3000):
        a = set(draw.sample(range(100), draw.randrange(1, 40)))
        b = (a - set(draw.sample(sorted(a), draw.randrange(len(a) // 4 + 1)))) | set(draw.sample(range(100), draw.randrange(4)))
        x, y = (m.prefix(np.array(sorted(s), np.uint64), common, rank, least) for s in (a, b))
        assert len(x) == len(a) - -(-4 * len(a) // 5) + 1
        if 5 * len(a & b) >= 4 * len(a | b):
            assert set(x.tolist()) & set(y.tolist())


def test_empty(spark):
    assert m.near_duplicates(frame(spark, documents()).limit(0), size=5, similarity=0.8).count() == 0


def test_members_meet_across_components_alone(spark):
    """One posting of thousands in one component and one foreign set; others of several components of unequal sizes."""
    draw = random.Random(8)
    rows = [(1, c, 20, 0, 5) for c in range(5000)] + [(1, 9999, 20, 0, 9999)]
    rows += [(h, 10_000 + draw.randrange(10**6), draw.randrange(18, 24), draw.randrange(4), draw.randrange(5)) for h in (2, 3, 4) for _ in range(60)]
    rows += [(5, c, 20, 0, 7) for c in range(30)] + [(6, 1, 20, 0, 1)]
    rooted = m.written(spark.createDataFrame(rows, "h long, c long, n long, i int, root long"), "test-rooted")
    fits = lambda a, b: 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2]) and 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2])
    want = sorted(tuple(sorted((a[1], b[1]))) for i, a in enumerate(rows) for b in rows[: i if a[0] > 1 else 0] if a[0] == b[0] and a[4] != b[4] and fits(a, b))
    want = sorted(want + [(c, 9999) for c in range(5000)])
    for chunk in (4096, 7):
        if chunk == 7:
            rooted, want = rooted.where("h > 1"), [p for p in want if p[1] != 9999]
        got = m.unlike(rooted, Fraction("0.8"), chunk).collect()
        assert sorted(tuple(sorted((r.u, r.v))) for r in got) == want


def test_pairs_of_a_group_of_edited_copies_grow_with_its_members(spark, monkeypatch):
    """Copies of one text with none to eight words changed, of which half are similar to no other."""
    draw, formed, hopeful = random.Random(1), [], m.hopeful
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    rows = []
    for doc_id in range(300):
        words = list(base)
        for place in draw.sample(range(150), draw.randrange(9)):
            words[place] = f"x{draw.randrange(10**9)}"
        rows.append((doc_id, " ".join(words)))

    def counted(pairs, *rest):
        formed.append(pairs.selectExpr("least(u, v)", "greatest(u, v)").where("u != v").distinct().count())
        return hopeful(pairs, *rest)

    monkeypatch.setattr(m, "hopeful", counted)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=5, similarity=0.8).collect()
    sets = [grams(text) for _, text in rows]
    assert {r.id: r.component_id for r in got} == roots(list(range(len(rows))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert len(formed) == 2 and sum(formed) <= 4 * len(rows), formed
