from __future__ import annotations

import math
import random

import numpy as np
from tests.llm.test_simhash import roots

from tidemark.llm import embedding_dedup as m


def vectors() -> list[tuple]:
    draw = np.random.default_rng(4)
    rows: list[tuple] = []
    for _ in range(12):
        at = draw.standard_normal(16)
        for _ in range(25):
            rows.append((len(rows), (at + draw.standard_normal(16) * draw.choice([0.05, 0.3, 0.45])).tolist()))
    rows += [(len(rows) + i, draw.standard_normal(16).tolist()) for i in range(300)]
    rows += [(1000 + i, v) for i, v in enumerate([None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1e300] * 16, [1e-300] * 16, [1.0] * 8])]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(None, rows[3][1]), (None, None), (7, rows[200][1]), (2005, [2 * x for x in rows[3][1]])]
    random.Random(2).shuffle(rows)
    return rows


def good(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b) -> float:
    x, y = (np.array(v) / np.abs(v).max() for v in (a, b))
    return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors()
    linked = lambda i, j: good(rows[i][1]) and good(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.9
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    root = roots(list(range(len(rows))), linked)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = sorted(((r[0], n[i], least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows)), key=str)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for chunk in (m.CHUNK, 10):
        monkeypatch.setattr(m, "CHUNK", chunk)
        got = m.near_duplicates(df).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(9)
    for dim in (64, 100):
        x, side = (m.unit(draw.standard_normal((500, dim))) for _ in range(2))
        side = m.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        for cosine_ in (0.0, 0.5, 0.9):
            y = cosine_ * x + math.sqrt(1 - cosine_**2) * side
            both = m.Codes(m.stored(np.concatenate((x, y)), m.rotation(dim)), dim)
            i, j = np.arange(500), np.arange(500, 1000)
            off = np.diag(both.estimates(i, j)) - cosine_
            assert abs(off.mean()) < 0.02 and off.std() < 0.13
            if cosine_ == 0.9:
                assert (off + 0.9 >= both.bounds(i, j)).all()
                assert (both.bounds(i, j) > 0.5).all()


def test_few_pairs_are_computed_again():
    draw = np.random.default_rng(2)
    x = m.unit(draw.standard_normal((1500, 64)))
    codes = m.Codes(m.stored(x, m.rotation(64)), 64)
    every = np.arange(len(x))
    near = sum(int((i < j).sum()) for i, j in m.hopeful(codes, every, every, 0.9))
    assert near < 0.001 * len(x) ** 2 / 2


def test_recall_of_tables():
    draw = np.random.default_rng(6)
    x = m.unit(draw.standard_normal((3000, 64)))
    side = draw.standard_normal((3000, 64))
    side = m.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * side
    for n in (50_000, 10_000_000):
        keys = [m.keys_for(v, *m.tables_for(n)) for v in (x, y)]
        assert (keys[0] == keys[1]).any(axis=1).mean() > 0.999


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, [0.0]), (2, [1.0, 2.1], 5, None), (3, [-1.0, 2.0], 5, [1.0])], "vec_id long, embedding array<float>, n long, Embedding array<double>")
    assert sorted(tuple(r) for r in m.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
