from __future__ import annotations

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import prefix_trie as m


def plain(found: dict[int, list[tuple]]) -> list[tuple]:
    """found: conversation to turns (name, size); rows as ``trie`` has them."""
    members: dict[tuple, list[int]] = {}
    for conv, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * x[-1][1] for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(found[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(name: str) -> bytes:
    return hashlib.sha256(name.encode()).digest()


def assembled(found: dict[int, list[tuple]], cuts: list[int]) -> list[tuple]:
    """Sweeps of the ranges between the cuts, stitched, without Spark."""
    rows = sorted((b"".join(digest(n) for n, _ in t), [s for _, s in t], c) for c, t in found.items())
    bounds = sorted({0, len(rows), *(c % (len(rows) + 1) for c in cuts)})
    names = [c.split()[0] for c in f"{m.NODE}, {m.PART}".split(", ")]
    swept = [dict(zip(names, r)) for part, (a, b) in enumerate(zip(bounds, bounds[1:])) for r in m.sweep(rows[a:b], part)]
    partial = sorted((r for r in swept if r["edge"] in (1, 2)), key=lambda r: (r["part"], r["edge"], r["depth"]))
    pieces = sorted((r for r in swept if r["edge"] == 3), key=lambda r: (r["id"], r["part"], r["seq"]))
    digests = dict(m.streamed_digests(pieces))
    whole = [tuple(r[n] for n in names[:9]) for r in swept if r["edge"] == 0] + list(m.stitch(partial))
    conv = {r[0]: r[3] for r in whole}
    assert len(conv) == len(whole)
    return sorted(((r[3], r[2], None if r[1] is None else conv[r[1]], *r[4:8], r[8] or digests.get(r[0], m.NOTHING)) for r in whole), key=str)


turn = st.sampled_from([("a", 3), ("b", 0), ("c", 7)])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.lists(turn, max_size=5), max_size=40), st.lists(st.integers(0, 50), max_size=8))
def test_any_cut_gives_the_same_trie(found, cuts):
    assert assembled(found, cuts) == plain(found)


def test_pieces_of_long_runs(monkeypatch):
    monkeypatch.setattr(m, "PIECE", 7)
    found = {c: [("a", 3)] * (c % 7 != 0) for c in range(400)} | {1000: [("a", 3), ("b", 1)]}
    assert assembled(found, [5, 100, 101, 250]) == plain(found)


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    own: dict[int, list] = {}
    for conv, turn_, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn_ is not None, turn_ or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [((r, t), len(t)) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + t[h:]
    return out


def conversations() -> list[tuple]:
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 130), *range(250, 290), 5000, 5001]:
        texts = ["hi", "é 𝄞", None, "", "long " * 50]
        rows += [(c, t, draw.choice(["user", None]), draw.choice(texts)) for t in range(draw.choice([1, 2, 3, 6, 9]))]
    rows += [(c, t, "user", "the same " * t) for c in range(300, 700) for t in range(7)]
    rows += [(None, 0, "user", "nobody"), (3, None, "user", "first"), (3, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "a", "tie")]
    rows += [(6000, t, "user", str(t % 3)) for t in range(3000)]
    draw.shuffle(rows)
    return [(*r, "clash", 1) for r in rows]


def test_conversations_match_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Text string, id int").repartition(3)
    want = rebuilt([r[:4] for r in rows])
    deep = {c: t for c, t in want.items() if c != 6000}
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    old = [spark.conf.get(n) for n in names]
    try:
        for parts in ("1", "13"):
            spark.conf.set(names[0], "false")
            spark.conf.set(names[1], parts)
            found = m.with_shared_heads(m.sequences(df))
            got = sorted((tuple(r) for r in m.trie(found.where("conv <> 6000")).collect()), key=str)
            assert got == plain(deep)
            chain = m.trie(found.where("conv = 6000")).orderBy("depth").collect()
            assert [r["depth"] for r in chain] == list(range(len(want[6000]) + 1)) and all(r["n_leaves"] == 1 for r in chain)
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    assert m.trie(m.with_shared_heads(m.sequences(df.limit(0)))).count() == 0
