from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import pytest
from tests.llm.cases import documents, frame

from tidemark.llm import mixing, sharding


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [0.5, 0.25, 0.125, 0.125], [7, 1, 1, 1, 1, 1, 1], [1e-9, 1]])
def test_pfair_stays_within_one_block(weights):
    q = mixing.parts(weights, 100)
    assert sum(q) == 100 and min(q) >= 1
    slots = mixing.pfair(q)
    assert sorted(x for s in slots for x in s) == list(range(100))
    for s, k in zip(slots, q):
        for t in range(101):
            assert abs(sum(x < t for x in s) - k * t / 100) < 1


@pytest.mark.parametrize("sizes", [[2000] + [5] * 19, [3000] * 3 + [1], [40_000, 7, 7, 7000, 123]])
def test_mix_stays_near_its_target_weights(sizes):
    weights = [n**0.7 for n in sizes]
    period = mixing.period_for(sizes, weights, 8)
    q = mixing.parts(weights, period)
    slots = max(-(-n // 8) * sum(weights) / w for n, w in zip(sizes, weights))
    assert period >= 4 * slots and sum(q) == period
    for s, w in zip(mixing.pfair(q), weights):
        at = [x for x in s if x < slots]
        assert all(abs(i - w / sum(weights) * x) < 1.26 and abs(i + 1 - w / sum(weights) * (x + 1)) < 1.26 for i, x in enumerate(at))


def test_mix_is_whole_and_follows_weights(spark):
    rows = documents(200)
    got = mixing.mix(frame(spark, rows), {"a": 1.0, "b": 2.0, "c": 1.0, None: 0.5}, block=2, period=90).collect()
    assert sorted(r.pos for r in got) == list(range(len(got)))
    assert Counter(r.source for r in got if r.epoch == 0) == Counter(r[3] for r in rows)
    assert {(r.source, r.row) for r in got} == {(r.source, r.row) for r in got if r.epoch == 0}
    placed = sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    period = mixing.period_for([sum(r[3] == s for r in rows) for s in (None, "a", "b", "c")], [0.5, 1, 2, 1], 2, 90)
    share = {s: w / 4.5 * 90 for s, w in ((None, 0.5), ("a", 1), ("b", 2), ("c", 1))}
    assert period >= 4 * len(placed)
    seen = Counter()
    for t, (slot, source) in enumerate(placed, 1):
        assert slot == t - 1
        seen[source] += 1
        assert all(abs(seen[s] - q * t / 90) < 1.26 for s, q in share.items())
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), {"a": 0.0, "b": 1, "c": 1, None: 1})
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(frame(spark, rows), {"a": 1.0})


def test_mix_matches_sql(spark, tmp_path):
    rows = [(r[0], r[3]) for r in documents(150) if r[0] is not None and r[0] < 150]
    docs = spark.createDataFrame(sorted(set(rows)), "doc_id long, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    mixing.op1(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = "doc_id, source, row, epoch, block, slot, pos"
    got = con.execute(f"SELECT {columns} FROM read_parquet('{tmp_path}/out/*.parquet') ORDER BY pos").fetchall()
    assert got == con.execute(f"SELECT {columns} FROM ({mixing.OP1_SQL}) ORDER BY pos").fetchall()


def test_mixed_rows(spark):
    docs = frame(spark, documents())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == [*docs.columns, mixing.POSITION]
    got = [tuple(r) for r in mixed.collect()]
    assert sorted(r[-1] for r in got) == list(range(len(got)))
    once, more = Counter(map(tuple, docs.collect())), Counter(r[:-1] for r in got)
    assert set(once) == set(more) and all(more[k] >= n for k, n in once.items())
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n)).collect()]
    assert sorted(got) == list(range(n))
    rows = {r[0]: r[1] for r in spark.range(n).select(sharding.permuted("id", n).alias("p"), "id").collect()}
    assert all(sharding.inverse(p, n) == i for p, i in rows.items())


def place(row: int, n: int, seed: int = sharding.SEED) -> int:
    """The network with cycle walking, in plain numbers."""
    a, b = sharding.sides(n)
    while True:
        left, right = divmod(row, b)
        for i, (m, c, k) in enumerate(sharding.constants(seed)):
            if i % 2 == 0:
                left = (left + (right * m + c) % sharding.P * k % sharding.Q) % a
            else:
                right = (right + (left * m + c) % sharding.P * k % sharding.Q) % b
        row = left * b + right
        if row < n:
            return row


def test_shard_numbered(spark):
    rows = [(i, None if i == 3 else f"t\u00e9xt {i}", "x", 9) for i in range(41)]
    docs = spark.createDataFrame(rows, "pos long, text string, Text string, slot int").repartition(3)
    got = sharding.shard_numbered(docs, "pos", 5)
    assert got.columns == ["text", "Text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = [(t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), place(i, 41) % 5, place(i, 41) // 5) for i, t, *_ in rows]
    assert sorted(((r[0], r[2], r[3], r[5], r[6]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sharding.shard_numbered(docs.limit(0), "pos").count() == 0
    with pytest.raises(ValueError, match="gapless"):
        sharding.shard_numbered(docs.where("pos <> 7"), "pos")


def test_shard_follows_sorted_rows(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 7).collect()
    assert {(r.id, r.shard, r.slot) for r in got} == {(i, place(i, 101) % 7, place(i, 101) // 7) for i in range(101)}


def test_shard(spark):
    rows = documents()
    got = sharding.shard(frame(spark, rows), 5).collect()
    assert sorted((r.id or -1, r.size, r.text_crc32) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = Counter(r.shard for r in got)
    assert len(by) == 5 and max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = sharding.shard(frame(spark, rows[::-1]), 5).collect()
    assert sorted((r.id or -1, r.shard, r.slot) for r in got if r.id != 2) == sorted((r.id or -1, r.shard, r.slot) for r in again if r.id != 2)
    assert sharding.shard(frame(spark, rows).limit(0)).count() == 0
