from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import vector_search as m

SCHEMA = "vec_id long, embedding array<double>, score double, row string"


def vectors() -> list[tuple]:
    draw = np.random.default_rng(3)
    middle = draw.standard_normal((6, 12)) / 4
    rows = [(i, (middle[i % 6] + draw.standard_normal(12) * 0.05).tolist()) for i in range(400)]
    rows += [(500 + i, (np.round(draw.random(12)) * (draw.random(12) < 0.2)).tolist()) for i in range(60)]
    odd = [None, [math.nan] * 12, [math.inf] + [0.0] * 11, [None] * 12, [], [0.0] * 12, [1.0, -1.0], [0.5] * 30]
    rows += [(600 + 50 * i, v) for i, v in enumerate(odd)] + [(50, rows[50][1]), (1000, rows[7][1]), (1001, rows[7][1]), (None, rows[7][1])]
    return [(*r, 0.5, "clash") for r in rows]


def plain(rows: list[tuple], k: int) -> list[tuple]:
    held = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, q) in enumerate(held):
        if query is not None and query % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for j, (i, v) in enumerate(held) if j != at)[:k]
            out += [(query, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scores)]
    return sorted(out, key=str)


def found(df, k: int) -> list[tuple]:
    index = m.components(df)
    got = m.search(m.shards(index), index.where("id % 50 = 0"), k)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, shard, block, wave in ((5, m.SHARD, m.BLOCK, m.WAVE), (5, 60, 7, 4), (1000, 100, 64, 9)):
        for name, value in (("SHARD", shard), ("BLOCK", block), ("WAVE", wave)):
            monkeypatch.setattr(m, name, value)
        monkeypatch.setattr(m.shards, "__defaults__", (shard,))
        assert found(df, k) == plain(rows, k)


def test_empty_tables(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    assert found(df.limit(0), 5) == []
    assert found(df.where("vec_id = 50"), 5) == plain([r for r in vectors() if r[0] == 50], 5)
    assert found(df.where("vec_id = 1000"), 5) == []


def test_large_components_raise(spark):
    df = spark.createDataFrame([(50, [1e9, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        found(df, 5)


def test_terms_are_left_out_once_the_kth_best_is_known():
    draw = np.random.default_rng(8)
    n, dim = 4096, 64
    v = draw.standard_normal((n, dim)) / 8 * np.r_[np.ones(16) * 1.8, np.ones(48) * 0.3]
    v[:40] = v[0] + draw.standard_normal((40, dim)) * 0.01
    whole = np.floor(256 * v).astype(np.int64)
    lists = m.Lists({
        "rows": np.arange(n).tobytes(), "ids": np.arange(n).tobytes(), "no_id": np.zeros(n, bool).tobytes(), "terms": list(range(dim)),
        "low": np.minimum(whole.min(axis=0), 0).tolist(), "high": np.maximum(whole.max(axis=0), 0).tolist(), "places": [None] * dim,
        "parts": [b"\x08" + whole[:, d].tobytes() for d in range(dim)],
    })
    best = m.Best(5)
    looked = m.maxscore(whole[0].astype(float), 0, lists, best)
    scores = whole @ whole[0]
    assert best.kept[0].tolist() == sorted(scores[1:].tolist(), reverse=True)[:5]
    assert looked < 0.7 * n * dim
